"""Schemas and parameters shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

KEYS = ["file_ind", "read_idx"]

READ_SCHEMA = T.StructType([
    T.StructField("file_ind", T.IntegerType(), False),
    T.StructField("read_idx", T.LongType(), False),
    T.StructField("id", T.StringType(), True),
    T.StructField("seq", T.StringType(), True),
    T.StructField("qual", T.StringType(), True),
])

# The reasons a read, or one end of it, could not be corrected.
INFO_NONE, INFO_OVER_CORRECTED, INFO_AMBIGUOUS, INFO_LOW_COVERAGE = 0, 1, 2, 3

# Longest k-mer whose 2-bit code fits a signed BIGINT; longer ones are strings.
MAX_PACKED_K = 31

# A k-mer set is broadcast only after its rows were counted and found to take no
# more than this, and its index, which packed k-mers make smaller, no more than the
# second; a larger one is joined.
MAX_BROADCAST_BYTES = 1 << 30
MAX_INDEX_BYTES = 256 << 20


def kmer_type(k: int) -> T.DataType:
    return T.LongType() if k <= MAX_PACKED_K else T.StringType()


def kmer_schema(k: int) -> T.StructType:
    return T.StructType([T.StructField("kmer", kmer_type(k), False)])


@dataclass(frozen=True)
class CorrectionParams:
    """What the corrector needs besides the reads and the trusted k-mers."""

    k: int
    cutoff: int = 0
    max_corrections: int = 4
    trim: bool = False
    new_quality: str | None = None


def check_k(k: int) -> None:
    if k < 2:
        raise ValueError(f"k must be at least 2, not {k}")


def check_alpha(alpha: float) -> None:
    if not 0.0 < alpha < 1.0:
        raise ValueError(f"alpha must lie between 0 and 1, not {alpha}")
