"""Whole Arrow batches of sequences as flat numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view

from mendseq.model import MAX_PACKED_K

# Bases worked on at once; a single longer read makes a batch of its own.
MAX_BASES = 4_000_000
# Windows of one text made at once: what lies between stays in the cache.
BLOCK = 1 << 14

LETTERS = np.frombuffer(b"ACGT", dtype=np.uint8)
OTHER = 4
CODES = np.full(256, OTHER, dtype=np.uint8)
CODES[LETTERS] = np.arange(4, dtype=np.uint8)
# Codes of the other strand.
COMPLEMENT = np.array([3, 2, 1, 0, OTHER], dtype=np.uint8)


@dataclass
class Ragged:
    """Rows of bytes: row r is flat[start[r] : start[r] + length[r]]."""

    flat: np.ndarray
    start: np.ndarray
    length: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.start)

    def row_ids(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.length)


def from_arrow(column: pa.Array | pa.ChunkedArray) -> Ragged:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    ends = ends[column.offset:column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    flat = flat[ends[0]:ends[-1]]
    return Ragged(flat, ends[:-1] - ends[0], np.diff(ends))


def to_arrow(flat: np.ndarray, length: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """Contiguous rows of ``flat`` as strings; rows marked in ``null`` become NULL."""
    ends = np.concatenate([[0], np.cumsum(length)])
    text = pa.LargeStringArray.from_buffers(
        len(length), pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes()))
    text = text.cast(pa.string())
    if null is not None and null.any():
        text = pa.compute.if_else(pa.array(null), pa.scalar(None, pa.string()), text)
    return text


def slices(batches: Iterator[pa.RecordBatch], max_bases: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with no more than about ``max_bases`` bases."""
    limit = max_bases or MAX_BASES
    for batch in batches:
        if not batch.num_rows:
            continue
        total = np.cumsum(from_arrow(batch["seq"]).length)
        edges = np.flatnonzero(np.diff(total // limit)) + 1
        for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            yield batch.slice(begin, end - begin)


def within(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for every c in ``counts``, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def starts(counts: np.ndarray) -> np.ndarray:
    """Where each of ``counts`` begins when they lie one after the other."""
    return np.cumsum(counts) - counts


def _joined(piece: np.ndarray, k: int, left_first: bool) -> np.ndarray:
    """Windows of k 2-bit values along the last axis, joined by repeated doubling."""
    done, done_len, power, power_len, rest = None, 0, piece, 1, k
    while True:
        if rest & 1:
            done = power if done is None else _append(done, done_len, power, power_len, left_first)
            done_len += power_len
        rest >>= 1
        if not rest:
            return done
        power = _append(power, power_len, power, power_len, left_first)
        power_len *= 2


def _append(a: np.ndarray, a_len: int, b: np.ndarray, b_len: int, left_first: bool) -> np.ndarray:
    b = b[..., a_len:]
    a = a[..., :b.shape[-1]]
    if left_first:
        return (a << np.int64(2 * b_len)) | b
    return a | (b << np.int64(2 * a_len))


def canonical_windows(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Canonical k-mers of all windows along the last axis, and which are valid.

    A window is valid when it has only A, C, G and T; the value of one that is
    not means nothing.
    """
    width = codes.shape[-1] - k + 1
    if width <= 0:
        shape = codes.shape[:-1] + (0,)
        return np.zeros(shape, _kmer_dtype(k)), np.zeros(shape, bool)
    if k <= MAX_PACKED_K and codes.ndim > 1:
        return _rolled(codes, k)
    valid = others(codes, k) == 0
    if k <= MAX_PACKED_K:
        kmers = np.empty(width, np.int64)
        for begin, forward, backward in _blocks(codes, k):
            np.minimum(forward, backward, out=kmers[begin:begin + len(forward)])
        return kmers, valid
    base = codes & 3
    forward = _lettered(LETTERS[base], k)
    backward = _lettered(LETTERS[3 - base][..., ::-1], k)[..., ::-1]
    return np.where(forward <= backward, forward, backward), valid


def others(codes: np.ndarray, k: int) -> np.ndarray:
    """How many bases of each window are none of A, C, G and T."""
    bad = np.cumsum(codes >= OTHER, axis=-1, dtype=np.int32)
    out = bad[..., k - 1:].copy()
    out[..., 1:] -= bad[..., :-k]
    return out


def _blocks(codes: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Both strands of the windows of one text."""
    for begin in range(0, len(codes) - k + 1, BLOCK):
        wide = (codes[begin:begin + BLOCK + k - 1] & 3).astype(np.int64)
        yield begin, _joined(wide, k, left_first=True), _joined(3 - wide, k, left_first=False)


def _rolled(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of many short texts, which take their next base all at once."""
    columns = np.ascontiguousarray(np.moveaxis(codes, -1, 0))
    shape, many = (len(columns) - k + 1, *columns.shape[1:]), columns.shape[1:]
    kmers, valid = np.empty(shape, np.int64), np.empty(shape, bool)
    forward, backward, clean = np.zeros(many, np.int64), np.zeros(many, np.int64), np.zeros(many, np.int32)
    for i, column in enumerate(columns):
        base = (column & 3).astype(np.int64)
        forward <<= 2
        forward |= base
        forward &= (1 << 2 * k) - 1
        backward >>= 2
        backward |= (3 - base) << 2 * (k - 1)
        clean += 1
        clean *= column < OTHER
        if i >= k - 1:
            np.minimum(forward, backward, out=kmers[i - k + 1])
            valid[i - k + 1] = clean >= k
    return (np.ascontiguousarray(np.moveaxis(v, 0, -1)) for v in (kmers, valid))


def next_kmers(ahead: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Canonical k-mers of the four bases that may follow each k - 1 bases, and where those are valid."""
    clean = (ahead < OTHER).all(axis=-1)
    if k > MAX_PACKED_K:
        last = np.broadcast_to(np.arange(4, dtype=np.uint8), (*ahead.shape[:-1], 4))
        codes = np.concatenate([np.repeat(ahead[..., None, :], 4, axis=-2), last[..., None]], axis=-1)
        return canonical_windows(codes, k)[0][..., 0], clean
    forward, backward = np.zeros(ahead.shape[:-1], np.int64), np.zeros(ahead.shape[:-1], np.int64)
    for i, column in enumerate(np.ascontiguousarray(np.moveaxis(ahead, -1, 0))):
        base = (column & 3).astype(np.int64)
        forward <<= 2
        forward |= base
        backward |= (3 - base) << 2 * i
    base = np.arange(4)
    return np.minimum(forward[..., None] << 2 | base, backward[..., None] | (3 - base) << 2 * (k - 1)), clean


class Changing:
    """The windows of a text, of which one base may be put in the place of its own."""

    def __init__(self, codes: np.ndarray, k: int):
        self.codes, self.k, self.others = codes, k, others(codes, k)
        if k <= MAX_PACKED_K:
            parts = [strands for _, *strands in _blocks(codes, k)]
            self.forward, self.backward = (np.concatenate(v) for v in zip(*parts))

    def kmers(self, start: np.ndarray, at: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Canonical k-mers of the windows at ``start`` with ``base`` in their place ``at``, and which are valid."""
        k = self.k
        valid = self.others[start] == (self.codes[start + at] >= OTHER)
        if k <= MAX_PACKED_K:
            up, down = 2 * (k - 1 - at), 2 * at
            forward, backward = self.forward[start] & ~(3 << up), self.backward[start] & ~(3 << down)
            kmers = np.minimum(forward | base << up, backward | (3 - base) << down)
        else:
            start, at, base = np.broadcast_arrays(start, at, base)
            window = self.codes[start[..., None] + np.arange(k)]
            np.put_along_axis(window, at[..., None], base[..., None].astype(np.uint8), axis=-1)
            kmers = canonical_windows(window, k)[0][..., 0]
        return kmers, np.broadcast_to(valid, kmers.shape)


def _kmer_dtype(k: int) -> np.dtype:
    return np.dtype(np.int64) if k <= MAX_PACKED_K else np.dtype(f"S{k}")


def _lettered(letters: np.ndarray, k: int) -> np.ndarray:
    cut = np.ascontiguousarray(sliding_window_view(letters, k, axis=-1))
    return cut.view(f"S{k}")[..., 0]


@dataclass
class Windows:
    """All windows of a batch: their read, 0-based start, k-mer and validity."""

    row: np.ndarray
    pos: np.ndarray
    kmer: np.ndarray
    valid: np.ndarray
    count: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.count) - self.count


def read_windows(seq: Ragged, k: int) -> Windows:
    count = np.maximum(seq.length - k + 1, 0)
    row = np.repeat(np.arange(seq.rows), count)
    pos = within(count)
    at = seq.start[row] + pos
    kmer, valid = canonical_windows(CODES[seq.flat], k)
    return Windows(row, pos, kmer[at], valid[at], count)


def no_kmers(k: int) -> np.ndarray:
    return np.zeros(0, dtype=_kmer_dtype(k))


def kmers_to_arrow(kmers: np.ndarray) -> pa.Array:
    if kmers.dtype.kind == "S":
        # From the letters themselves: pyarrow makes chunks of longer arrays of numpy strings.
        letters = np.ascontiguousarray(kmers).view(np.uint8)
        return to_arrow(letters, np.full(len(kmers), kmers.dtype.itemsize))
    return pa.array(kmers, type=pa.int64())


def kmers_from_arrow(column: pa.ChunkedArray | pa.Array, k: int) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    return values.astype(_kmer_dtype(k))
