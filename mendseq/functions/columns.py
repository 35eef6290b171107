"""k-mer expressions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mendseq.model import MAX_PACKED_K


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement, in A < C < G < T order."""
    return F.least(kmer, reverse_complement(kmer))


def is_valid(seq: Column) -> Column:
    return seq.rlike("^[ACGT]+$")


def windows(seq: Column, k: int) -> Column:
    """All windows of length k, left to right; an empty array for a shorter read."""
    starts = F.sequence(F.lit(1), F.length(seq) - (k - 1))
    cut = F.transform(starts, lambda s: F.substring(seq, s, F.lit(k)))
    return F.when(F.length(seq) >= k, cut).otherwise(F.array().cast("array<string>"))


def pack(kmer: Column, k: int) -> Column:
    """A valid k-mer as the value stored in k-mer tables."""
    if k > MAX_PACKED_K:
        return kmer
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("bigint")


def unpack(code: Column, k: int) -> Column:
    """The letters of a stored k-mer."""
    if k > MAX_PACKED_K:
        return code
    digits = F.lpad(F.conv(code.cast("string"), 10, 4), k, "0")
    return F.translate(digits, "0123", "ACGT")
