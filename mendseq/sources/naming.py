"""Names of output files, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions dropped together with ".gz".
SEQUENCE_EXTENSIONS = ("fastq", "fasta", "fq", "fa")


def base_name(path: Column) -> Column:
    """The last part of a path without its extension.

    ``.gz`` goes together with a sequence extension before it, any other
    extension before ``.gz`` stays.
    """
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    known = "|".join(SEQUENCE_EXTENSIONS)
    bare_gz = F.regexp_replace(F.regexp_replace(name, r"\.gz$", ""), rf"\.({known})$", "")
    return F.when(name.endswith(".gz"), bare_gz).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


def is_compressed(path: Column, level: int = 1) -> Column:
    return path.endswith("gz") & F.lit(level > 0)


def output_name(path: Column, has_quality: Column, level: int = 1) -> Column:
    kind = F.when(has_quality, ".cor.fq").otherwise(".cor.fa")
    suffix = F.when(is_compressed(path, level), ".gz").otherwise("")
    return F.concat(base_name(path), kind, suffix)
