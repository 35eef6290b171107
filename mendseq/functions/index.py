"""A k-mer set as a task holds it: whole batches of k-mers are looked up at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np

SPREAD = np.uint64(0x9E3779B97F4A7C15)
# Buckets of an index that share one full offset; each has its own within those.
STRIDE = 64
# Bytes of the largest filter; a set too large for it lets more k-mers pass.
MAX_FILTER_BYTES = 128 << 20
# Bits a k-mer sets in each of its two words of a filter, and words of a cache line, which has both.
FILTER_BITS = 4
LINE = 8
# k-mers looked up at once: what lies between stays in the cache.
BLOCK = 1 << 14


def in_blocks(look_up: Callable[[np.ndarray], np.ndarray], kmers: np.ndarray) -> np.ndarray:
    out = np.empty(len(kmers), dtype=bool)
    for begin in range(0, len(kmers), BLOCK):
        out[begin:begin + BLOCK] = look_up(kmers[begin:begin + BLOCK])
    return out


def spread_codes(kmers: np.ndarray) -> np.ndarray:
    """Non-negative numbers in another order than the k-mers, one for each."""
    return ((kmers.view(np.uint64) * SPREAD) >> np.uint64(1)).astype(np.int64)


def hashed(kmers: np.ndarray) -> np.ndarray:
    """64 bits for each k-mer, packed or of letters."""
    if kmers.dtype.kind == "S":
        h = np.zeros(len(kmers), np.uint64)
        for column in np.ascontiguousarray(kmers).view(np.uint8).reshape(len(kmers), kmers.dtype.itemsize).T:
            h = (h ^ column) * SPREAD
            h ^= h >> np.uint64(29)
    else:
        h = np.ascontiguousarray(kmers).view(np.uint64) * SPREAD
    h = (h ^ h >> np.uint64(32)) * SPREAD
    return h ^ h >> np.uint64(29)


@dataclass(frozen=True)
class Layout:
    """How ``rows`` packed k-mers below 2 ** bits are kept: by buckets of about one or two, sorted inside."""

    rows: int
    bits: int

    @property
    def bucket_bits(self) -> int:
        return min(self.bits, max(STRIDE.bit_length() - 1, self.rows.bit_length() - 1))

    @property
    def rest_bits(self) -> int:
        return self.bits - self.bucket_bits

    @property
    def rest(self) -> np.dtype:
        """What a k-mer has besides its bucket."""
        return np.dtype(next(t for t in ("u1", "u2", "u4", "u8") if self.rest_bits <= 8 * np.dtype(t).itemsize))

    @property
    def bytes(self) -> int:
        return (2 << self.bucket_bits) + self.rows * self.rest.itemsize

    def mixed(self, kmers: np.ndarray) -> np.ndarray:
        """The k-mers as other numbers below 2 ** bits, one to one."""
        mask, half = np.uint64((1 << self.bits) - 1), np.uint64(self.bits // 2)
        v = np.ascontiguousarray(kmers).view(np.uint64) & mask
        for _ in range(2):
            v = (v ^ v >> half) * SPREAD & mask
        return v ^ v >> half

    def part(self, mixed: np.ndarray, parts: int) -> np.ndarray:
        """Which of ``parts`` runs of buckets, a power of two, each belongs to."""
        return (mixed >> np.uint64(self.bits - parts.bit_length() + 1)).astype(np.int64)

    def piece(self, mixed: np.ndarray, part: int = 0, parts: int = 1) -> Piece:
        mixed = np.sort(mixed)
        buckets = (1 << self.bucket_bits) // parts
        sizes = np.bincount((mixed >> np.uint64(self.rest_bits)).astype(np.int64) - part * buckets, minlength=buckets)
        starts = np.cumsum(sizes) - sizes
        coarse = starts[::STRIDE]
        fine = starts - np.repeat(coarse, STRIDE)
        if len(fine) and fine.max() > np.iinfo(np.uint16).max:
            raise ValueError("the k-mers of a set are not distinct")
        rest = mixed & np.uint64((1 << self.rest_bits) - 1)
        return Piece(len(mixed), coarse, fine.astype(np.uint16), rest.astype(self.rest))


@dataclass
class Piece:
    """The buckets of one part: k-mers, offsets of every 64th bucket, of each within those, and what k-mers have besides."""

    rows: int
    coarse: np.ndarray
    fine: np.ndarray
    rest: np.ndarray


class PackedIndex:
    """Packed k-mers in buckets, some three bytes each where k is 17."""

    def __init__(self, layout: Layout, pieces: Iterable[Piece]):
        """The pieces of all parts in their order."""
        pieces = list(pieces)
        self.layout = layout
        rows = np.array([p.rows for p in pieces])
        total = int(rows.sum())
        self.coarse = np.concatenate([p.coarse + b for p, b in zip(pieces, np.cumsum(rows) - rows)] + [[total]]).astype(np.int64)
        self.fine = np.concatenate([p.fine for p in pieces] + [np.zeros(1, np.uint16)])
        self.rest = np.concatenate([p.rest for p in pieces])

    def _start(self, bucket: np.ndarray) -> np.ndarray:
        return self.coarse[bucket // STRIDE] + self.fine[bucket]

    def contains(self, kmers: np.ndarray) -> np.ndarray:
        return in_blocks(self._contains, kmers)

    def _contains(self, kmers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(kmers), dtype=bool)
        mixed = self.layout.mixed(kmers)
        bucket = (mixed >> np.uint64(self.layout.rest_bits)).astype(np.int64)
        rest = (mixed & np.uint64((1 << self.layout.rest_bits) - 1)).astype(self.rest.dtype)
        at, end = self._start(bucket), self._start(bucket + 1)
        # Codes beyond the largest possible k-mer would be taken for others.
        open_ = np.flatnonzero((at < end) & (kmers >> self.layout.bits == 0))
        at, end, rest = at[open_], end[open_], rest[open_]
        while len(open_):
            there = self.rest[at]
            out[open_[there == rest]] = True
            at += 1
            left = (there < rest) & (at < end)
            open_, at, end, rest = open_[left], at[left], end[left], rest[left]
        return out


class LetteredIndex:
    """Longer k-mers as sorted letters."""

    def __init__(self, kmers: np.ndarray):
        self.kmers = np.sort(kmers)

    def contains(self, kmers: np.ndarray) -> np.ndarray:
        if not len(self.kmers):
            return np.zeros(len(kmers), dtype=bool)
        at = np.searchsorted(self.kmers, kmers)
        at[at == len(self.kmers)] = 0
        return self.kmers[at] == kmers


def packed_bits(k: int) -> int:
    """Bits of a packed k-mer, as an index counts them."""
    return max(2 * k, STRIDE.bit_length() - 1)


def build_index(kmers: np.ndarray) -> PackedIndex | LetteredIndex:
    if kmers.dtype.kind == "S":
        return LetteredIndex(kmers)
    layout = Layout(len(kmers), max(int(kmers.max()).bit_length() if len(kmers) else 0, packed_bits(2)))
    return PackedIndex(layout, [layout.piece(layout.mixed(kmers))])


class Filter:
    """Which k-mers may be in a set; of others nearly all are told at once, none of the set is missed."""

    def __init__(self, words: np.ndarray, both: bool = True):
        """A power of two of 64-bit words; a k-mer has its bits in two of a line, or in one where there are few for a k-mer."""
        self.words, self.both = words, both

    @staticmethod
    def size(rows: int) -> int:
        """Words for a set: 16 to 32 bits a k-mer as long as that is within the bound."""
        return min(1 << max(6, (max(rows, 1) - 1).bit_length() - 2), MAX_FILTER_BYTES // 8)

    @staticmethod
    def place(h: np.ndarray, words: int) -> np.ndarray:
        return (h >> np.uint64(65 - words.bit_length())).astype(np.int64)

    @classmethod
    def second(cls, h: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Another word of the line, and the bits there."""
        h = h * SPREAD
        h ^= h >> np.uint64(32)
        return place ^ 1 + ((h >> np.uint64(24) & np.uint64(255)).astype(np.int64) * (LINE - 1) >> 8), cls.bits(h)

    @staticmethod
    def bits(h: np.ndarray) -> np.ndarray:
        mask = np.zeros(len(h), np.uint64)
        for i in range(FILTER_BITS):
            mask |= np.uint64(1) << (h >> np.uint64(6 * i) & np.uint64(63))
        return mask

    @classmethod
    def piece(cls, h: np.ndarray, words: int, part: int = 0, parts: int = 1, both: bool = True) -> np.ndarray:
        """The words of one of ``parts`` equal runs."""
        size = words // parts
        out = np.zeros(size, np.uint64)
        place = cls.place(h, words)
        np.bitwise_or.at(out, place - part * size, cls.bits(h))
        if both:
            place, bits = cls.second(h, place)
            np.bitwise_or.at(out, place - part * size, bits)
        return out

    def contains(self, kmers: np.ndarray) -> np.ndarray:
        return in_blocks(self._contains, kmers)

    def _contains(self, kmers: np.ndarray) -> np.ndarray:
        h = hashed(kmers)
        place, mask = self.place(h, len(self.words)), self.bits(h)
        out = self.words[place] & mask == mask
        if not self.both:
            return out
        open_ = np.flatnonzero(out)
        place, mask = self.second(h[open_], place[open_])
        out[open_] = self.words[place] & mask == mask
        return out
