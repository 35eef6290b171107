"""What the trusted k-mers say about each read before any correction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendseq.functions import ragged
from mendseq.functions.ragged import LETTERS
from mendseq.model import KEYS, MAX_BROADCAST_BYTES
from mendseq.operators.anchors import find_anchors
from mendseq.operators.anchors import longest_run as run_size
from mendseq.operators.kmersets import kmer_counts
from mendseq.operators.membership import KmerSet, solve


def longest_run(hits: DataFrame) -> DataFrame:
    """The longest run of trusted k-mers of each read that has one; the first wins ties."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["size"].alias("size"), (-r["start"]).alias("minus_start"))))
    return (hits.select(*KEYS, best.alias("best")).where(F.col("best").isNotNull())
            .select(*KEYS, (-F.col("best.minus_start")).alias("start"), F.col("best.size").alias("size")))


def trusted_spans(hits: DataFrame, k: int) -> DataFrame:
    """Bases under a run that an untrusted k-mer follows, as [start, end)."""
    return (hits.select(*KEYS, "n_windows", F.explode("runs").alias("r"))
            .where(F.col("r.start") + F.col("r.size") < F.col("n_windows"))
            .select(*KEYS, F.col("r.start").alias("span_start"),
                    (F.col("r.start") + F.col("r.size") + k - 1).alias("span_end")))


def anchor_class(hits: DataFrame, k: int) -> DataFrame:
    """Reads by what a correction starts from."""
    largest = F.array_max(F.transform("runs", lambda r: r["size"]))
    kind = (F.when(F.col("n_windows") == 0, "too_short")
            .when(F.size("runs") == 0, "no_anchor")
            .when(largest == F.col("n_windows"), "all_trusted")
            .when(largest >= k, "long_anchor").otherwise("short_anchor"))
    return hits.select(kind.alias("anchor")).groupBy("anchor").agg(F.count("*").alias("n_reads"))


def solid_kmers(reads: DataFrame, trusted: KmerSet) -> DataFrame:
    """Occurrences of the k-mers of the reads that are trusted."""
    return kmer_counts(reads, trusted.k).join(trusted.df, "kmer", "left_semi")


def untrusted_kmers(reads: DataFrame, trusted: KmerSet) -> DataFrame:
    return kmer_counts(reads, trusted.k).join(trusted.df, "kmer", "left_anti")


def compare_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every k-mer of two sets, and whether it is in both or in only one; one shuffle."""
    sides = F.element_at(F.array(*map(F.lit, ("only_a", "only_b", "both"))), F.col("mark"))
    marked = a.withColumn("mark", F.lit(1)).unionByName(b.withColumn("mark", F.lit(2)))
    return marked.groupBy("kmer").agg(F.bit_or("mark").alias("mark")).select("kmer", sides.alias("side"))


def created_anchors(reads: DataFrame, trusted: KmerSet,
                    max_broadcast: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """For reads without a trusted k-mer, the change that creates the longest run."""
    k = trusted.k
    schema = T.StructType([
        T.StructField("file_ind", T.IntegerType()), T.StructField("read_idx", T.LongType()),
        T.StructField("pos", T.IntegerType()), T.StructField("base", T.StringType()),
        T.StructField("run", T.IntegerType())])
    letters = np.array([chr(c) for c in LETTERS])

    def kernel(batch: pa.RecordBatch, alive: np.ndarray):
        seq, qual = ragged.from_arrow(batch["seq"]), ragged.from_arrow(batch["qual"])
        w = ragged.read_windows(seq, k)
        hit = w.valid.copy()
        hit[w.valid] = yield w.row[w.valid], w.kmer[w.valid]
        none = np.bincount(w.row, weights=hit, minlength=seq.rows) == 0
        lost = np.flatnonzero((w.count > 0) & none & alive)
        codes = ragged.Ragged(ragged.CODES[seq.flat], seq.start, seq.length)
        row, pos, base, hits = yield from find_anchors(k, codes, qual, np.arange(seq.rows), alive, lost)
        taken = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [batch["file_ind"].take(taken), batch["read_idx"].take(taken), pa.array(pos.astype(np.int32)),
             pa.array(letters[base]), pa.array(run_size(hits).astype(np.int32))], names=schema.names)

    return solve(reads.select(*KEYS, "seq", "qual"), kernel, trusted, schema, max_broadcast)
