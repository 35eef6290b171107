"""Statistics over all reads: size, coverage, sampling rate, quality cutoffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendseq.functions.columns import is_valid
from mendseq.model import KEYS

# Fixed values.
BAD_SHARE, GOOD_SHARE = 0.05, 0.25
SAMPLED_COVERAGE = 7.0
NO_GOOD_QUALITY = 127


def read_stats(reads: DataFrame, k: int) -> DataFrame:
    """Reads, bases, reads with other letters and reads too short for a k-mer."""
    size = F.length("seq")
    return reads.groupBy("file_ind").agg(
        F.count("*").alias("n_reads"),
        F.sum(size).alias("n_bases"),
        F.count_if(~is_valid(F.col("seq"))).alias("n_with_other"),
        F.count_if(size < k).alias("n_short"),
        F.min(size).alias("min_length"),
        F.max(size).alias("max_length"))


def infer_alpha(reads: DataFrame, genome_size: Column | int) -> DataFrame:
    """One row: coverage and the rate that samples every k-mer about seven times."""
    size = genome_size if isinstance(genome_size, Column) else F.lit(genome_size)
    bases = reads.agg(F.sum(F.length("seq")).alias("n_bases"))
    return (bases.withColumn("coverage", F.col("n_bases") / size)
            .withColumn("alpha", F.lit(SAMPLED_COVERAGE) / F.col("coverage")))


def quality_histogram(reads: DataFrame) -> DataFrame:
    """(score, n_first, n_last): records by quality of their first and last base."""
    ends = reads.where(F.col("qual").isNotNull() & (F.length("seq") > 0)).select(
        F.ascii("qual").alias("first_score"),
        F.ascii(F.substring(F.col("qual"), F.length("seq"), F.lit(1))).alias("last_score"))
    scores = ends.select(F.explode(F.array(
        F.struct(F.col("first_score").alias("score"), F.lit(1).alias("is_first")),
        F.struct(F.col("last_score").alias("score"), F.lit(0).alias("is_first")))).alias("e"))
    return scores.groupBy("e.score").agg(
        F.sum("e.is_first").alias("n_first"), F.sum(1 - F.col("e.is_first")).alias("n_last"))


def _percentiles(histogram: DataFrame, share: float) -> DataFrame:
    """One row: the least score below which more than ``share`` of the records lie."""
    so_far = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    # At most one row per quality code.
    marked = histogram.select(
        "score",
        (F.sum("n_first").over(so_far) > share * F.sum("n_first").over(everything)).alias("first_over"),
        (F.sum("n_last").over(so_far) > share * F.sum("n_last").over(everything)).alias("last_over"))
    return marked.agg(
        F.min(F.when(F.col("first_over"), F.col("score"))).alias("first_pct"),
        F.min(F.when(F.col("last_over"), F.col("score"))).alias("last_pct"))


def _cutoff(reads: DataFrame, share: float, value: Column, without: int) -> DataFrame:
    """One row; ``without`` unless the first record of all has qualities."""
    has_quality = reads.agg(F.min_by(F.col("qual").isNotNull(), F.struct(*KEYS))).scalar()
    return _percentiles(quality_histogram(reads), share).select(
        F.when(has_quality, F.coalesce(value, F.lit(without))).otherwise(without).alias("cutoff"))


def bad_quality_cutoff(reads: DataFrame) -> DataFrame:
    """One row: bases of this quality or less are not to be relied on; 0 means none."""
    return _cutoff(reads, BAD_SHARE, F.least("last_pct", F.col("first_pct") - 1), 0)


def good_quality_cutoff(reads: DataFrame) -> DataFrame:
    """One row: the lower quartile of the first base's quality."""
    return _cutoff(reads, GOOD_SHARE, F.col("first_pct"), NO_GOOD_QUALITY)
