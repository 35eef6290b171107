"""A deterministic coin for every k-mer occurrence.

The coin depends only on where the k-mer occurs, so a sample does not change with
the partitioning, on a retry, or between engines. It is a permutation polynomial
over a prime field: x -> x**5 is one to one modulo 2**31 - 1.
"""

from __future__ import annotations

import numpy as np

PRIME = 2**31 - 1
READ_STEP, POS_STEP, FILE_STEP, SHIFT = 1_103_515_245, 1_640_531_527, 668_265_263, 17


def coin_limit(alpha: float) -> int:
    """Occurrences whose coin is below this limit are kept."""
    return int(alpha * PRIME)


def coin(file_ind: np.ndarray, read_idx: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Coins in [0, PRIME) for 0-based window starts ``pos``."""
    p = np.int64(PRIME)
    x = (read_idx % p) * np.int64(READ_STEP) % p
    x = x + pos % p * np.int64(POS_STEP) % p + file_ind * np.int64(FILE_STEP) % p + SHIFT
    x %= p
    square = x * x % p
    return square * square % p * x % p


def coin_sql(file_ind: str, read_idx: str, pos: str) -> str:
    """The same coin as an SQL expression over BIGINT operands."""
    p = PRIME
    x = (f"((({read_idx}) % {p} * {READ_STEP} % {p} + ({pos}) % {p} * {POS_STEP} % {p} "
         f"+ ({file_ind}) * {FILE_STEP} % {p} + {SHIFT}) % {p})")
    square = f"({x} * {x} % {p})"
    return f"({square} * {square} % {p} * {x} % {p})"
