"""The whole run: from reads to corrected reads and a summary."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame

from mendseq.functions.binomial import thresholds
from mendseq.model import MAX_BROADCAST_BYTES, CorrectionParams, check_alpha, check_k
from mendseq.operators import kmersets, stats
from mendseq.operators.bloom import SAMPLED_FP, BloomSize, adapt_to_errors
from mendseq.operators.correct import correct
from mendseq.operators.membership import KmerSet

log = logging.getLogger("mendseq")

# Fixed values.
DEFAULT_MAX_CORRECTIONS = 4
EXACT, MODELLED = "exact", "modelled"


@dataclass
class Settings:
    k: int
    genome_size: int
    alpha: float | None = None
    max_corrections: int | None = None
    trim: bool = False
    use_quality: bool = True
    new_quality: str | None = None
    # "modelled": thresholds and the adaptation to many errors as if set A were a
    # Bloom filter for genome_size. "exact": set A has no false positives.
    false_positives: str = MODELLED
    max_broadcast: int = MAX_BROADCAST_BYTES

    def __post_init__(self):
        check_k(self.k)
        if self.genome_size < 1:
            raise ValueError(f"genome size must be positive, not {self.genome_size}")
        if self.alpha is not None:
            check_alpha(self.alpha)
        if self.false_positives not in (EXACT, MODELLED):
            raise ValueError(f"unknown mode {self.false_positives!r}")


@dataclass
class Sample:
    """What pass 1 finds, and the limits that follow from it."""

    kmers: KmerSet
    alpha: float
    cutoff: int
    max_corrections: int
    thresholds: list[int]


@dataclass
class Trust:
    """Trusted k-mers and the two limits that may change on the way to them."""

    kmers: KmerSet
    cutoff: int
    max_corrections: int
    alpha: float | None


def quality_cutoff(reads: DataFrame, settings: Settings) -> int:
    cutoff = stats.bad_quality_cutoff(reads).first()["cutoff"] if settings.use_quality else 0
    log.info("Bases up to quality %r don't count", chr(cutoff)) if cutoff else log.info("Qualities are not used")
    return cutoff


# The sampling rate where coverage is so low that every k-mer should be drawn.
MOST_ALPHA = 0.999


def sampling_rate(reads: DataFrame, settings: Settings) -> float:
    """The given rate, or the one that samples every k-mer about seven times."""
    if settings.alpha is not None:
        return settings.alpha
    found = stats.infer_alpha(reads, settings.genome_size).first()
    # No bases at all: any rate samples nothing.
    alpha = min(found["alpha"] or MOST_ALPHA, MOST_ALPHA)
    log.info("Reads cover the genome %.3f times; k-mers are sampled at a rate of %.3f", found["coverage"] or 0.0, alpha)
    return alpha


def sample_kmers(reads: DataFrame, settings: Settings, sampled: KmerSet | None = None) -> Sample:
    """Pass 1: set A, and what its size says about errors.

    ``sampled``: set A, if it was already drawn of the same letters at the same rate.
    """
    alpha = sampling_rate(reads, settings)
    cutoff = quality_cutoff(reads, settings)
    if sampled is None:
        sampled = KmerSet.store(kmersets.sampled_kmers(reads, settings.k, alpha), settings.k, "sampled")
    rate = 0.0
    if settings.false_positives == MODELLED:
        rate = BloomSize.for_genome(settings.genome_size, SAMPLED_FP).modelled_fp(sampled.rows)
    log.info("%d distinct k-mers sampled, %f of others taken for sampled", sampled.rows, rate)
    max_corrections = settings.max_corrections
    if max_corrections is None:
        max_corrections, cutoff = adapt_to_errors(rate, DEFAULT_MAX_CORRECTIONS, cutoff)
    return Sample(sampled, alpha, cutoff, max_corrections, thresholds(alpha, settings.k, rate))


def trust_from(reads: DataFrame, sample: Sample, settings: Settings) -> Trust:
    """Pass 2: set B, k-mers whose every base is supported by the sample."""
    trusted = kmersets.trusted_kmers(reads, sample.kmers, sample.thresholds, sample.cutoff, settings.max_broadcast)
    kmers = KmerSet.store(trusted, settings.k, "trusted")
    log.info("%d k-mers are trusted", kmers.rows)
    return Trust(kmers, sample.cutoff, sample.max_corrections, sample.alpha)


def build_trusted(reads: DataFrame, settings: Settings) -> Trust:
    """Passes 1 and 2: sample k-mers, then keep those whose every base is supported."""
    return trust_from(reads, sample_kmers(reads, settings), settings)


def loaded_trust(reads: DataFrame, kmers: KmerSet, settings: Settings) -> Trust:
    """Saved k-mers stand in for passes 1 and 2; only the cutoff is found anew."""
    wanted = settings.max_corrections
    return Trust(kmers, quality_cutoff(reads, settings),
                 DEFAULT_MAX_CORRECTIONS if wanted is None else wanted, None)


def correct_reads(reads: DataFrame, trust: Trust, settings: Settings) -> DataFrame:
    """Pass 3: every read on its own against the trusted k-mers."""
    params = CorrectionParams(settings.k, trust.cutoff, trust.max_corrections,
                              settings.trim, settings.new_quality)
    return correct(reads, trust.kmers, params, settings.max_broadcast)
