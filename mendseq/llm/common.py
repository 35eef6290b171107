"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mendseq.session import materialize

BATCH_ROWS = 1000
# Bits of a filter: 16 for each number, between these bounds.
FILTER_BITS = 1 << 12, 1 << 28

__all__ = ["HashFilter", "arrow_map", "edges_to_roots", "fold_of", "hash_filter", "hashed_sample", "keep_rows", "row_numbers", "rows_of", "small_batches", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key as text modulo ``folds``; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def hashed_sample(df: DataFrame, key: str, n: int, total: int) -> DataFrame:
    """``n`` of the ``total`` rows of ``df`` by a hash of ``key``, or all if there are fewer.

    Rows are thinned to about twice as many where they lie, so that only those meet.
    """
    share = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / (1 << 30)
    return df.where(share * total < 2 * n).orderBy(F.xxhash64(key, F.lit(7)), key).limit(n)


class HashFilter:
    """Hashed numbers as bits; some that are not among them pass by chance."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 64 - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.view(np.uint64) & self.mask
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def hash_filter(df: DataFrame, name: str) -> HashFilter:
    """The filter of a column of hashes; at most 32 MiB, beyond some 16 million of them more pass by chance."""
    least, most = FILTER_BITS
    size = min(most, max(least, 1 << (16 * df.count()).bit_length()))
    at = F.col(name).bitwiseAND(F.lit(size - 1))
    blocks = df.select(F.shiftright(at, 6).alias("block"), F.expr(f"shiftleft(1L, cast(`{name}` & 63 as int))").alias("bits")) \
        .groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[blocks.column("block").to_numpy()] = blocks.column("bits").to_numpy().view(np.uint64)
    return HashFilter(bits)


def small_batches(spark: SparkSession) -> None:
    """Rows of text and of ids are long: lets Python workers get few of them at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def arrow_map(df: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], dict | None]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch that ``start`` makes once per task.

    It returns a dict of columns in the order of ``schema``, or None for no rows.
    """
    small_batches(df.sparkSession)
    fields = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            out = work(batch)
            if out is not None:
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(out.values(), arrow)],
                    schema=arrow)

    return df.mapInArrow(run, fields)


def rows_of(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(n).to_pylist() for n in names]


def row_numbers() -> Callable[[int], list[int]]:
    """Numbers no other row of the job has; keep them by writing the job's result."""
    task, used = TaskContext.get(), 0
    base = (task.partitionId() if task else 0) << 36

    def take(n: int) -> list[int]:
        nonlocal used
        used += n
        return list(range(base + used - n, base + used))

    return take


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of the alternating star algorithm; edges have ``a`` > ``b``."""
    flipped = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    seen = edges.union(flipped) if large else edges
    least = seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = seen.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .union(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def edges_to_roots(edges: DataFrame) -> DataFrame:
    """(node, root): every node of an edge and the least node it can reach.

    ``edges`` has two bigint columns ``a`` and ``b`` in any order, repeats and loops
    included. Large and small stars alternate (Kiveris et al., 2014); each round is a
    written table, only its row count and checksum come to the driver.
    """
    a, b = F.col("a"), F.col("b")
    now = materialize(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(),
                      "edges")
    before = None
    while True:
        now = materialize(_star(_star(now, large=True), large=False), "stars")
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
    return now.select(a.alias("node"), b.alias("root")).union(
        now.select(b.alias("node"), b.alias("root")).distinct())


def keep_rows(df: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """The rows of ``df`` for which the function of a batch says true; all columns stay."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            yield batch.filter(pa.array(work(batch), pa.bool_()))

    return df.mapInArrow(run, df.schema)
