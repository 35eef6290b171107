"""Nodes of a k-mer set: the k-1 bases a k-mer begins with, on the strand as it is read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from mendseq.functions import ragged
from mendseq.functions.ragged import LETTERS
from mendseq.model import MAX_PACKED_K

# Bases of the longest walk kept with a node.
WALK = 64


class Nodes:
    """Numpy arithmetic of oriented runs of ``size`` bases, packed or as letters."""

    def __init__(self, k: int):
        self.k, self.size, self.packed = k, k - 1, k <= MAX_PACKED_K

    def none(self) -> np.ndarray:
        return np.zeros(0, np.int64 if self.packed else f"S{self.size}")

    def _letters(self, codes: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(codes).view(np.uint8).reshape(len(codes), -1)

    def of_bases(self, base: np.ndarray) -> np.ndarray:
        """Nodes of rows of ``size`` base codes."""
        if not self.packed:
            return np.ascontiguousarray(LETTERS[base]).view(f"S{self.size}").ravel()
        out = np.zeros(len(base), np.int64)
        for column in base.T:
            out = out << 2 | column
        return out

    def ends(self, kmers: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """The node each k-mer begins with and its last base, on both strands."""
        if self.packed:
            back, rest = np.zeros(len(kmers), np.int64), kmers.copy()
            for _ in range(self.k):
                back, rest = back << 2 | 3 - (rest & 3), rest >> 2
            return (kmers >> 2, kmers & 3), (back >> 2, back & 3)
        if not len(kmers):
            return ((self.none(), np.zeros(0, np.int64)),) * 2
        code = ragged.CODES[self._letters(kmers)].astype(np.int64)
        back = 3 - code[:, ::-1]
        return (self.of_bases(code[:, :-1]), code[:, -1]), (self.of_bases(back[:, :-1]), back[:, -1])

    def moved(self, nodes: np.ndarray, base: np.ndarray) -> np.ndarray:
        """The nodes one base further."""
        if self.packed:
            return (nodes << 2 | base) & np.int64((1 << 2 * self.size) - 1)
        return np.ascontiguousarray(np.concatenate([self._letters(nodes)[:, 1:], LETTERS[base][:, None]], axis=1)).view(f"S{self.size}").ravel()

    def from_arrow(self, column: pa.Array) -> np.ndarray:
        return ragged.kmers_from_arrow(column, self.k) if self.packed else np.array(column.to_pylist(), f"S{self.size}")

    def walked(self, nodes: np.ndarray, exts: np.ndarray, walks: list[str], last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, exts) of what is asked and of all nodes on the walks from there."""
        length = np.array([len(w) for w in walks], np.int64)
        every = [nodes], [exts]
        at, here = np.flatnonzero(length > 0), nodes[length > 0]
        base = np.frombuffer("".join(w.ljust(WALK, "A") for w in walks).encode(), np.uint8).reshape(len(walks), WALK)
        for i in range(WALK):
            going = length[at] > i
            at, here = at[going], here[going]
            if not len(at):
                break
            here = self.moved(here, ragged.CODES[base[at, i]].astype(np.int64))
            further = length[at] > i + 1
            follows = np.left_shift(1, ragged.CODES[base[at, min(i + 1, WALK - 1)]].astype(np.int64))
            every[0].append(here)
            every[1].append(np.where(further, follows, last[at]))
        return np.concatenate(every[0]), np.concatenate(every[1])
