"""Trusted k-mers on disk: a Parquet table that says what it was made with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendseq.model import kmer_type
from mendseq.operators.membership import KmerSet

LABELS = ("k", "alpha", "genome_size")


def save_trusted(trusted: DataFrame, path: str, k: int, alpha: float, genome_size: int,
                 mode: str = "errorifexists") -> None:
    labels = {"k": k, "alpha": alpha, "genome_size": genome_size}
    labelled = trusted.select(F.col("kmer").alias("kmer", metadata=labels))
    labelled.write.mode(mode).parquet(path)


def load_trusted(spark: SparkSession, path: str, k: int | None = None,
                 genome_size: int | None = None) -> KmerSet:
    """Read saved k-mers; they must have been made with the given ``k`` and size."""
    table = spark.read.parquet(path)
    labels = table.schema["kmer"].metadata
    if not all(name in labels for name in LABELS):
        raise ValueError(f"{path} does not hold saved trusted k-mers")
    for name, wanted in (("k", k), ("genome_size", genome_size)):
        if wanted is not None and labels[name] != wanted:
            raise ValueError(f"{path} was made with {name} = {labels[name]}, not {wanted}")
    if table.schema["kmer"].dataType != kmer_type(labels["k"]):
        raise ValueError(f"{path} holds k-mers of an unexpected type")
    return KmerSet(table, labels["k"], table.count())
