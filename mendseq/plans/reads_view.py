"""Sequencing reads derived from the driver's ``orders`` table.

Every order is one read of a genome whose blocks are md5 digests, so the same
reads can be written down in SQL. ``true_seq`` is the read without its errors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mendseq.session import spread

READ_LENGTH, BLOCK, SHORT_LENGTH = 100, 32, 12
BLOCKS_PER_READ = 5
ORDERS_PER_BLOCK = 22


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def genome_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row with ``genome_size``."""
    return orders(spark, sf_dir).agg((BLOCK * F.floor(F.count("*") / ORDERS_PER_BLOCK)).alias("genome_size"))


def genome_length(spark: SparkSession, sf_dir: str) -> int:
    return genome_table(spark, sf_dir).first()["genome_size"]


def _block(index: Column) -> Column:
    digest = F.md5(F.concat(F.lit("g"), index.cast("string")).cast("binary"))
    return F.translate(digest, "0123456789abcdef", "ACGTACGTACGTACGT")


def _put(text: Column, at: Column, letter: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), at), letter, F.substring(text, at + 2, F.lit(READ_LENGTH)))


def synthetic_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.lit(genome_length(spark, sf_dir) - READ_LENGTH)
    rid, h = F.col("rid"), F.col("h")
    source = spread(orders(spark, sf_dir).select("o_orderkey", "o_custkey"), "o_orderkey")
    placed = source.select(
        F.col("o_orderkey").alias("rid"),
        (F.col("o_orderkey") * 7919 + F.col("o_custkey") * 104729).alias("h"),
    ).select(
        "rid", (h % size).alias("st"),
        (F.floor(h / 7) % 100).cast("int").alias("ep"),
        (F.floor(h / 11) % 100).cast("int").alias("np"))
    block = F.floor(F.col("st") / BLOCK)
    stretch = F.concat(*[_block(block + i) for i in range(BLOCKS_PER_READ)])
    clean = placed.withColumn(
        "f0", F.substring(stretch, (F.col("st") % BLOCK + 1).cast("int"), F.lit(READ_LENGTH)))
    ep, np_ = F.col("ep"), F.col("np")
    swapped = F.translate(F.substring(F.col("f0"), ep + 1, F.lit(1)), "ACGT", "CGTA")
    good = F.repeat(F.lit("I"), READ_LENGTH)
    with_error = clean.select(
        "rid", "f0", "np",
        F.when(rid % 3 == 0, _put(F.col("f0"), ep, swapped)).otherwise(F.col("f0")).alias("f1"),
        F.when(rid % 3 == 0, _put(good, ep, F.lit("#"))).otherwise(good).alias("q1"))
    unknown = with_error.withColumn(
        "f2", F.when(rid % 50 == 7, _put(F.col("f1"), np_, F.lit("N"))).otherwise(F.col("f1")))

    def finish(text: str, complement: bool = True) -> Column:
        column = F.col(text)
        other = F.reverse(F.translate(column, "ACGT", "TGCA") if complement else column)
        both = F.when(rid % 2 == 1, other).otherwise(column)
        return F.when(rid % 97 == 5, F.substring(both, 1, SHORT_LENGTH)).otherwise(both)

    return unknown.select(
        F.lit(0).alias("file_ind"), rid.cast("bigint").alias("read_idx"),
        F.concat(F.lit("@r"), rid.cast("string")).alias("id"),
        finish("f2").alias("seq"), finish("q1", complement=False).alias("qual"),
        finish("f0").alias("true_seq"))


def noisy_reads(spark: SparkSession, sf_dir: str, reads: DataFrame) -> DataFrame:
    """The same reads with further errors placed by ``lineitem``.

    Every line item of an order is one error, so a read has from none to a dozen of
    them, some next to each other; every third position is of bad quality as well.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    at = (F.col("l_partkey") * 7 + F.col("l_suppkey") * 13 + F.col("l_linenumber") * 17) % READ_LENGTH
    # At most READ_LENGTH positions per order, however many line items it has.
    errors = (lines
              .select(F.col("l_orderkey").alias("read_idx"), at.cast("int").alias("at"))
              .groupBy("read_idx").agg(F.collect_set("at").alias("errors")))

    def changed(text: str, other: Callable[[Column, Column], Column]) -> Column:
        def put(line: Column, at: Column) -> Column:
            here = F.substring(line, at + 1, F.lit(1))
            return F.when((at >= 0) & (at < F.length(line)), F.overlay(line, other(here, at + 1), at + 1, F.lit(1))).otherwise(line)

        return F.when(F.col("errors").isNull(), F.col(text)).otherwise(F.aggregate("errors", F.col(text), put)).alias(text)

    return reads.join(errors, "read_idx", "left").select(
        "file_ind", "read_idx", "id",
        changed("seq", lambda c, i: F.translate(c, "ACGT", "GTAC")),
        changed("qual", lambda c, i: F.when(i % 3 == 0, F.lit("#")).otherwise(c)))
