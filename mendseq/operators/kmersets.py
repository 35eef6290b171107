"""The two k-mer sets: sampled k-mers (A) and trusted k-mers (B)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendseq.functions import ragged
from mendseq.functions.sampling import coin, coin_limit
from mendseq.model import KEYS, MAX_BROADCAST_BYTES, check_alpha, check_k, kmer_schema, kmer_type
from mendseq.operators.membership import KmerSet, solve


# Windows of one piece of a long sequence.
PIECE = 1 << 20


def in_pieces(reads: DataFrame, k: int) -> DataFrame:
    """(seq): the same windows of length ``k`` in sequences of bounded length, overlapping by k - 1."""
    last = F.greatest(F.length("seq") - k, F.lit(0))
    start = F.explode(F.sequence(F.lit(0), last, F.lit(PIECE))).alias("start")
    return reads.where(F.col("seq").isNotNull()).select("seq", start).select(
        F.substring(F.col("seq"), F.col("start") + 1, F.lit(PIECE + k - 1)).alias("seq"))


def _batches_of_kmers(df: DataFrame, k: int, pick) -> DataFrame:
    """k-mers of the windows ``pick`` keeps, distinct in each batch."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ragged.slices(batches):
            kept = np.unique(pick(batch, ragged.read_windows(ragged.from_arrow(batch["seq"]), k)))
            yield pa.RecordBatch.from_arrays([ragged.kmers_to_arrow(kept)], names=["kmer"])

    return df.mapInArrow(task, kmer_schema(k))


def batch_kmers(reads: DataFrame, k: int) -> DataFrame:
    """Canonical k-mers of all reads, distinct in each batch."""
    check_k(k)
    return _batches_of_kmers(in_pieces(reads, k), k, lambda _, w: w.kmer[w.valid])


def all_kmers(reads: DataFrame, k: int) -> DataFrame:
    """Distinct canonical k-mers of all reads."""
    return batch_kmers(reads, k).distinct()


def kmer_counts(reads: DataFrame, k: int) -> DataFrame:
    """Occurrences of each k-mer, counted per batch before anything is shuffled."""
    check_k(k)
    schema = T.StructType([*kmer_schema(k), T.StructField("n", T.LongType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ragged.slices(batches):
            w = ragged.read_windows(ragged.from_arrow(batch["seq"]), k)
            kmers, n = np.unique(w.kmer[w.valid], return_counts=True)
            yield pa.RecordBatch.from_arrays([ragged.kmers_to_arrow(kmers), pa.array(n)], names=schema.names)

    return in_pieces(reads, k).mapInArrow(task, schema).groupBy("kmer").agg(F.sum("n").alias("n_occurrences"))


def _sampled(batch: pa.RecordBatch, w: ragged.Windows, limit: int) -> np.ndarray:
    file_ind = batch["file_ind"].to_numpy().astype(np.int64)
    read_idx = batch["read_idx"].to_numpy()
    return w.valid & (coin(file_ind[w.row], read_idx[w.row], w.pos) < limit)


def sampled_kmers(reads: DataFrame, k: int, alpha: float) -> DataFrame:
    """Set A: every occurrence of a k-mer is drawn with probability ``alpha``."""
    check_k(k)
    check_alpha(alpha)
    limit = coin_limit(alpha)
    return _batches_of_kmers(reads.select(*KEYS, "seq"), k,
                             lambda batch, w: w.kmer[_sampled(batch, w, limit)]).distinct()


def kmer_occurrences(reads: DataFrame, k: int, alpha: float | None = None) -> DataFrame:
    """One row per valid window (pos is its 0-based start); only drawn ones with ``alpha``."""
    check_k(k)
    limit = None if alpha is None else coin_limit(alpha)
    schema = T.StructType([
        T.StructField("file_ind", T.IntegerType()), T.StructField("read_idx", T.LongType()),
        T.StructField("pos", T.IntegerType()), T.StructField("kmer", kmer_type(k))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ragged.slices(batches):
            w = ragged.read_windows(ragged.from_arrow(batch["seq"]), k)
            kept = np.flatnonzero(w.valid if limit is None else _sampled(batch, w, limit))
            row = pa.array(w.row[kept])
            yield pa.RecordBatch.from_arrays(
                [batch["file_ind"].take(row), batch["read_idx"].take(row),
                 pa.array(w.pos[kept].astype(np.int32)), ragged.kmers_to_arrow(w.kmer[kept])],
                names=schema.names)

    return reads.select(*KEYS, "seq").mapInArrow(task, schema)


def window_stats(reads: DataFrame, k: int) -> DataFrame:
    """Per read: windows, valid ones, and where the first and the last of those start."""
    check_k(k)
    schema = T.StructType([
        T.StructField("file_ind", T.IntegerType()), T.StructField("read_idx", T.LongType()),
        T.StructField("n_windows", T.LongType()), T.StructField("n_valid", T.LongType()),
        T.StructField("first_pos", T.IntegerType()), T.StructField("last_pos", T.IntegerType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ragged.slices(batches):
            w = ragged.read_windows(ragged.from_arrow(batch["seq"]), k)
            row, pos, rows = w.row[w.valid], w.pos[w.valid].astype(np.int32), batch.num_rows
            n_valid, first, last = np.bincount(row, minlength=rows), np.full(rows, np.iinfo(np.int32).max, np.int32), np.full(rows, -1, np.int32)
            np.minimum.at(first, row, pos)
            np.maximum.at(last, row, pos)
            none = n_valid == 0
            yield pa.RecordBatch.from_arrays(
                [batch["file_ind"], batch["read_idx"], pa.array(w.count), pa.array(n_valid),
                 pa.array(first, mask=none), pa.array(last, mask=none)], names=schema.names)

    return reads.select(*KEYS, "seq").mapInArrow(task, schema)


class Coverage:
    """Which bases and k-mers of a batch set A vouches for."""

    def __init__(self, seq: ragged.Ragged, qual: ragged.Ragged, w: ragged.Windows,
                 hit: np.ndarray, k: int, table: np.ndarray, cutoff: int):
        self.seq, size = seq, len(seq.flat)
        begin = ragged.starts(seq.length)
        at = np.repeat(begin, w.count) + w.pos
        # No window starts at the last k - 1 bases of a read, so none is counted for the read after it.
        starts, hits = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        starts[at], hits[at] = True, hit
        self.n_windows, self.n_hits = (self._latest(v, k) for v in (starts, hits))
        self.trusted = (self.n_windows > 0) & (self.n_hits > table[self.n_windows])
        self.trusted &= ~self._bad(qual, cutoff)
        runs = np.concatenate([[0], np.cumsum(self.trusted, dtype=np.int32)])
        self.kmer_trusted = w.valid & (runs[k:] - runs[:-k] == k)[at] if size >= k else w.valid

    @staticmethod
    def _latest(marks: np.ndarray, k: int) -> np.ndarray:
        """How many of each base and the k - 1 before it are marked."""
        out = np.cumsum(marks, dtype=np.int32)
        out[k:] -= out[:-k].copy()
        return out

    @cached_property
    def row(self) -> np.ndarray:
        return self.seq.row_ids()

    @cached_property
    def pos(self) -> np.ndarray:
        return ragged.within(self.seq.length)

    def _bad(self, qual: ragged.Ragged, cutoff: int) -> np.ndarray:
        """Bases whose quality says that they don't count."""
        if not len(qual.flat):
            return np.zeros(len(self.seq.flat), dtype=bool)
        if (qual.length == self.seq.length).all():
            return qual.flat <= cutoff
        at = np.minimum(qual.start[self.row] + self.pos, len(qual.flat) - 1)
        return (qual.length[self.row] > 0) & (qual.flat[at] <= cutoff)


def _coverage_kernel(k: int, table: list[int], cutoff: int, output):
    table = np.asarray(table)

    def kernel(batch: pa.RecordBatch, alive: np.ndarray):
        seq, qual = ragged.from_arrow(batch["seq"]), ragged.from_arrow(batch["qual"])
        w = ragged.read_windows(seq, k)
        hit = w.valid.copy()
        hit[w.valid] = yield w.row[w.valid], w.kmer[w.valid]
        return output(batch, w, hit, Coverage(seq, qual, w, hit, k, table, cutoff), alive)

    return kernel


def trusted_kmers(reads: DataFrame, sampled: KmerSet, table: list[int], cutoff: int,
                  max_broadcast: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Set B: k-mers of which every base is trusted in some read."""
    k = sampled.k

    def output(batch, w, hit, coverage, alive):
        kept = np.unique(w.kmer[coverage.kmer_trusted & alive[w.row]])
        return pa.RecordBatch.from_arrays([ragged.kmers_to_arrow(kept)], names=["kmer"])

    kernel = _coverage_kernel(k, table, cutoff, output)
    source = reads.select(*KEYS, "seq", "qual")
    return solve(source, kernel, sampled, kmer_schema(k), max_broadcast).distinct()


def position_profile(reads: DataFrame, sampled: KmerSet, table: list[int], cutoff: int,
                     max_broadcast: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Per read, arrays over its bases: windows covering it, those in A, and trust."""
    schema = T.StructType([
        T.StructField("file_ind", T.IntegerType()), T.StructField("read_idx", T.LongType()),
        T.StructField("n_windows", T.ArrayType(T.IntegerType())),
        T.StructField("n_hits", T.ArrayType(T.IntegerType())),
        T.StructField("trusted", T.ArrayType(T.BooleanType()))])

    def output(batch, w, hit, coverage, alive):
        bases = alive[coverage.row]
        sizes = np.bincount(coverage.row[bases], minlength=batch.num_rows)[alive]
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        arrays = [pa.ListArray.from_arrays(ends, pa.array(v[bases])) for v in (
            coverage.n_windows.astype(np.int32), coverage.n_hits.astype(np.int32), coverage.trusted)]
        rows = pa.array(np.flatnonzero(alive))
        return pa.RecordBatch.from_arrays(
            [batch["file_ind"].take(rows), batch["read_idx"].take(rows), *arrays], names=schema.names)

    kernel = _coverage_kernel(sampled.k, table, cutoff, output)
    return solve(reads.select(*KEYS, "seq", "qual"), kernel, sampled, schema, max_broadcast)


def coverage_counts(reads: DataFrame, sampled: KmerSet, table: list[int], cutoff: int,
                    max_broadcast: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Bases by the windows covering them and those in A, counted per batch first."""
    fields, k = ["n_windows", "n_hits", "n_positions", "pos_sum"], sampled.k
    schema = T.StructType([T.StructField(n, T.LongType()) for n in fields])

    def output(batch, w, hit, coverage, alive):
        kept = alive[coverage.row] & (coverage.n_windows > 0)
        # At most k windows cover a base, so both numbers are one small number.
        place = coverage.n_windows[kept].astype(np.int64) * (k + 1) + coverage.n_hits[kept]
        counts, sums = np.bincount(place), np.bincount(place, coverage.pos[kept])
        met = np.flatnonzero(counts)
        columns = met // (k + 1), met % (k + 1), counts[met], sums[met]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=fields)

    kernel = _coverage_kernel(sampled.k, table, cutoff, output)
    found = solve(reads.select(*KEYS, "seq", "qual"), kernel, sampled, schema, max_broadcast)
    return found.groupBy(*[F.col(n).cast("int").alias(n) for n in fields[:2]]).agg(*[F.sum(n).alias(n) for n in fields[2:]])


def window_hits(reads: DataFrame, kmers: KmerSet,
                max_broadcast: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Per read: number of windows, the starts of those in the set and their runs."""
    k = kmers.k
    run = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("size", T.IntegerType())])
    schema = T.StructType([
        T.StructField("file_ind", T.IntegerType()), T.StructField("read_idx", T.LongType()),
        T.StructField("n_windows", T.IntegerType()),
        T.StructField("solid", T.ArrayType(T.IntegerType())),
        T.StructField("runs", T.ArrayType(run))])

    def lists(rows, alive, values):
        sizes = np.bincount(rows, minlength=len(alive))[alive]
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), values)

    def kernel(batch: pa.RecordBatch, alive: np.ndarray):
        w = ragged.read_windows(ragged.from_arrow(batch["seq"]), k)
        hit = w.valid.copy()
        hit[w.valid] = yield w.row[w.valid], w.kmer[w.valid]
        hit &= alive[w.row]
        row, start, size = hit_runs(w, hit)
        rows = pa.array(np.flatnonzero(alive))
        runs = pa.StructArray.from_arrays(
            [pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))], names=["start", "size"])
        return pa.RecordBatch.from_arrays(
            [batch["file_ind"].take(rows), batch["read_idx"].take(rows),
             pa.array(w.count[alive].astype(np.int32)),
             lists(w.row[hit], alive, pa.array(w.pos[hit].astype(np.int32))),
             lists(row, alive, runs)], names=schema.names)

    return solve(reads.select(*KEYS, "seq"), kernel, kmers, schema, max_broadcast)


def hit_runs(w: ragged.Windows, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of consecutive hits: their read, first window and size."""
    opens = hit & ((w.pos == 0) | ~np.concatenate([[False], hit[:-1]]))
    closes = hit & ((w.pos == w.count[w.row] - 1) | ~np.concatenate([hit[1:], [False]]))
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    return w.row[first], w.pos[first], last - first + 1
