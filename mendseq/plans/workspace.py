"""Intermediate results that several queries over the same tables share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendseq.model import CorrectionParams
from mendseq.operators.correct import correct
from mendseq.operators.membership import KmerSet, gathered
from mendseq.plans.pipeline import DEFAULT_MAX_CORRECTIONS, EXACT, Sample, Settings, Trust, sample_kmers, sampling_rate, trust_from
from mendseq.plans.reads_view import genome_length, noisy_reads, synthetic_reads
from mendseq.session import materialize

DEFAULT_K = 17

# Other kinds of input, made of the same reads.
VIEWS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "fasta": lambda reads: reads.withColumns({"id": F.translate("id", "@", ">"), "qual": F.lit(None).cast("string")}),
    "two_files": lambda reads: reads.withColumn("file_ind", (F.col("read_idx") % 2).cast("int")),
}
# Those in which file, read and letters stay the same, so that set A does too.
SAME_LETTERS = {"fasta"}
# Settings that set A does not depend on.
SAME_SAMPLE = {"use_quality", "max_broadcast"}


class Workspace:
    """Reads of one data folder and what is derived from them, each computed once.

    The steps are those of ``pipeline``.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, k: int = DEFAULT_K, reads: DataFrame | None = None,
                 like: Workspace | None = None, **changes):
        """``like``: the workspace that draws the same set A."""
        self.spark, self.sf_dir, self.k, self.like, self.changes = spark, sf_dir, k, like, changes
        if reads is not None:
            self.reads = reads

    @cached_property
    def reads(self) -> DataFrame:
        return materialize(gathered(synthetic_reads(self.spark, self.sf_dir), self.k), "reads")

    @cached_property
    def noisy(self) -> DataFrame:
        return materialize(noisy_reads(self.spark, self.sf_dir, self.reads), "noisy")

    @cached_property
    def genome_size(self) -> int:
        return genome_length(self.spark, self.sf_dir)

    @cached_property
    def settings(self) -> Settings:
        plain = {"genome_size": self.genome_size, "false_positives": EXACT, "max_corrections": DEFAULT_MAX_CORRECTIONS}
        return Settings(k=self.k, **(plain | self.changes))

    @cached_property
    def alpha(self) -> float:
        return sampling_rate(self.reads, self.settings)

    @cached_property
    def sample(self) -> Sample:
        return sample_kmers(self.reads, replace(self.settings, alpha=self.alpha), self.like.sampled if self.like else None)

    @cached_property
    def trust(self) -> Trust:
        return trust_from(self.reads, self.sample, self.settings)

    @property
    def cutoff(self) -> int:
        return self.sample.cutoff

    @property
    def thresholds(self) -> list[int]:
        return self.sample.thresholds

    @property
    def sampled(self) -> KmerSet:
        return self.sample.kmers

    @property
    def trusted(self) -> KmerSet:
        return self.trust.kmers

    def view(self, name: str) -> Workspace:
        """The same tables as another kind of input."""
        return workspace(self.spark, self.sf_dir, name, lambda: Workspace(
            self.spark, self.sf_dir, self.k, VIEWS[name](self.reads), self if name in SAME_LETTERS else None))

    def changed(self, name: str, **changes) -> Workspace:
        """The same reads with other settings."""
        return workspace(self.spark, self.sf_dir, name, lambda: Workspace(
            self.spark, self.sf_dir, self.k, self.reads, self if changes.keys() <= SAME_SAMPLE else None, **changes))

    def params(self, **changes) -> CorrectionParams:
        return CorrectionParams(**({"k": self.k, "cutoff": self.trust.cutoff,
                                    "max_corrections": self.trust.max_corrections} | changes))

    def corrected(self, **changes) -> DataFrame:
        return correct(self.reads.drop("true_seq"), self.trusted, self.params(**changes), self.settings.max_broadcast)

    def corrected_noisy(self, **changes) -> DataFrame:
        """The noisy reads against the k-mers the other reads made trusted."""
        return correct(self.noisy, self.trusted, self.params(**changes), self.settings.max_broadcast)


_open: dict[tuple[str, str, str], Workspace] = {}


def workspace(spark: SparkSession, sf_dir: str, name: str = "", make: Callable[[], Workspace] | None = None) -> Workspace:
    """The workspace of this Spark application for ``sf_dir``."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _open:
        _open[key] = make() if make else Workspace(spark, sf_dir)
    return _open[key]
