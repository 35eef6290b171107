"""What is written about each read, and the summary of a run."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from mendseq.functions import ragged
from mendseq.model import KEYS, INFO_AMBIGUOUS, INFO_LOW_COVERAGE, INFO_OVER_CORRECTED

# Words of the header annotation.
CORRECTED, UNFIXABLE = " cor", " unfixable_error"
BAD_PREFIX, BAD_SUFFIX, TRIMMED = " bad_prefix=", " bad_suffix=", " trimmed="
REASONS = {INFO_OVER_CORRECTED: " oc", INFO_AMBIGUOUS: " ak", INFO_LOW_COVERAGE: " lc"}


def _number_if(label: str, name: str) -> Column:
    return F.when(F.col(name) > 0, F.concat(F.lit(label), F.col(name).cast("string"))).otherwise("")


def annotated_id(trim: bool = False) -> Column:
    reason = F.lit("")
    for code, word in REASONS.items():
        reason = F.when(F.col("info") == code, word).otherwise(reason)
    clean = (F.col("correction") == 0) & (F.col("bad_prefix") == 0) & (F.col("bad_suffix") == 0)
    return (F.when(clean, F.col("id"))
            .when(F.col("correction") == -1, F.concat("id", F.lit(UNFIXABLE), reason))
            .otherwise(F.concat(
                "id", F.when(F.col("correction") > 0, CORRECTED).otherwise(""),
                _number_if(BAD_PREFIX, "bad_prefix"),
                _number_if(TRIMMED if trim else BAD_SUFFIX, "bad_suffix"), reason)))


def annotate(corrected: DataFrame, trim: bool = False, discard: bool = False) -> DataFrame:
    """Corrected reads with the result in their header; ``discard`` drops the unfixable."""
    kept = corrected.where(F.col("correction") >= 0) if discard else corrected
    return kept.withColumn("id", annotated_id(trim))


def totals(trim: bool = False, discard: bool = False) -> list[Column]:
    """What is counted over the corrected reads. A read with bad ends but no correction counts as error-free."""
    trimmed = (F.col("bad_suffix") > 0) & F.lit(trim)
    total = F.coalesce(F.sum(F.lit(1)), F.lit(0))

    def count(condition: Column, value: Column = F.lit(1)) -> Column:
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("bigint")

    return [
        count(F.col("correction") > 0, F.col("correction")).alias("corr_cnt"),
        count(trimmed).alias("trim_reads_cnt"),
        count(trimmed, F.col("bad_suffix")).alias("trim_base_cnt"),
        count((F.col("correction") < 0) & F.lit(discard)).alias("discard_reads_cnt"),
        total.cast("bigint").alias("total_reads"),
        count(F.col("correction") == 0).alias("error_free_reads_cnt"),
    ]


def with_ratios(counted: DataFrame) -> DataFrame:
    return counted.withColumn(
        "corrections_per_read",
        F.coalesce(F.try_divide("corr_cnt", F.col("total_reads") - F.col("error_free_reads_cnt")), F.lit(0.0))
    ).withColumn(
        "bases_per_trim", F.coalesce(F.try_divide("trim_base_cnt", "trim_reads_cnt"), F.lit(0.0)))


def summary(corrected: DataFrame, trim: bool = False, discard: bool = False) -> DataFrame:
    """One row of totals, by a scan of the corrected reads."""
    return with_ratios(corrected.agg(*totals(trim, discard)))


def observed(corrected: DataFrame, trim: bool = False, discard: bool = False) -> tuple[DataFrame, Callable[[], Row]]:
    """The same reads, and a function that gives the row of ``summary`` once they were written.

    The totals are counted while the reads pass, so no further scan is needed.
    """
    seen = Observation()
    counted = corrected.observe(seen, *totals(trim, discard))

    def row() -> Row:
        found = seen.get
        schema = ", ".join(f"{name} bigint" for name in found)
        return with_ratios(corrected.sparkSession.createDataFrame([tuple(found.values())], schema)).first()

    return counted, row


def summary_text(row) -> str:
    lines = [("reads", row.total_reads), ("reads without errors", row.error_free_reads_cnt),
             ("bases corrected", row.corr_cnt), ("corrections per read with errors", f"{row.corrections_per_read:.6f}"),
             ("reads trimmed", row.trim_reads_cnt), ("bases cut off per trimmed read", f"{row.bases_per_trim:.6f}"),
             ("reads dropped", row.discard_reads_cnt)]
    return "".join(f"{name:<34}{value}\n" for name, value in lines)


def accuracy(truth: DataFrame, corrected: DataFrame) -> DataFrame:
    """One row: wrong bases of ``truth`` (seq against true_seq), how many of them were mended, and how many made.

    Only reads of unchanged length are compared; ``gain`` is null without errors.
    """
    known = truth.select(*KEYS, F.col("seq").alias("was"), "true_seq")
    # Rows are sorted by the first key, so that is the one with many values; lengths written so are none.
    both = known.join(corrected.select(*KEYS, "seq"), KEYS[::-1]).where(F.length("seq") - F.length("true_seq") == 0)
    wrong = both.where((F.col("was") != F.col("true_seq")) | (F.col("was").isNotNull() & (F.col("seq") != F.col("true_seq"))))
    names = ["n_errors", "n_mended", "n_made"]
    counted = wrong.select("was", "true_seq", "seq").mapInArrow(_compared, ", ".join(f"{n} bigint" for n in names))
    return counted.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).withColumn(
        "gain", F.try_divide(F.col("n_mended") - F.col("n_made"), F.col("n_errors")))


def _letters(column: pa.Array) -> ragged.Ragged:
    """Code points of all rows."""
    length = pc.utf8_length(column).to_numpy().astype(np.int64)
    flat = np.frombuffer("".join(column.to_pylist()).encode("utf-32-le"), np.uint32)
    return ragged.Ragged(flat, np.cumsum(length) - length, length)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letters that were wrong, were and no longer are, and only now are, in each batch."""
    for batch in batches:
        was, true, seq = (_letters(batch[name]) for name in ("was", "true_seq", "seq"))
        # Beyond its end a shorter sequence has no letter, which is wrong.
        row, pos = true.row_ids(), ragged.within(true.length)
        there = pos < was.length[row]
        was_wrong = np.ones(len(pos), bool)
        was_wrong[there] = was.flat[(was.start[row] + pos)[there]] != true.flat[there]
        is_wrong = seq.flat != true.flat
        found = [was_wrong, was_wrong & ~is_wrong, ~was_wrong & is_wrong]
        yield pa.RecordBatch.from_arrays([pa.array([int(f.sum())]) for f in found], names=["n_errors", "n_mended", "n_made"])
