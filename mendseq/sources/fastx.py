"""FASTA and FASTQ files, plain or gzip, as DataFrames and back.

Lines are read by Spark's text source, so splitting, codecs and remote storage are
Spark's. A record is a fixed number of lines (2 or 4). The lines of every split
are counted first; joined with the number of lines before its split, each line knows
which record it belongs to, and only the few records cut by a split boundary are put
together by a shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendseq.model import KEYS, READ_SCHEMA
from mendseq.session import materialize
from mendseq.sources.gzip_members import FORMAT, SCHEMES, GzipMembers
from mendseq.sources.naming import output_name

# First byte and lines per record of each format.
FASTA, FASTQ = ">", "@"
RECORD_LINES = {FASTA: 2, FASTQ: 4}

SPLIT = ["file_path", "block_start"]

_PARSED = T.StructType([*READ_SCHEMA.fields, T.StructField("slot", T.IntegerType()),
                        T.StructField("line", T.StringType())])


def _inputs(spark: SparkSession, paths: Sequence[str]) -> list[tuple[int, str]]:
    """(file_ind, file_path): the files each path stands for, from one listing."""
    hadoop, files = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.read.text(list(dict.fromkeys(paths))).inputFiles()
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    given: dict[str, list[int]] = {}
    for i, path in enumerate(paths):
        place = hadoop.Path(path)
        system = place.getFileSystem(conf)
        found = [s.getPath() for s in system.globStatus(place) or []] if set(path) & set("*?[{") else [system.makeQualified(place)]
        for p in found:
            given.setdefault(p.toUri().getPath().rstrip("/"), []).append(i)
    rows = []
    for file in dict.fromkeys(files):
        above = unquote(urlparse(file).path)
        while above not in given and "/" in above.strip("/"):
            above = above.rsplit("/", 1)[0]
        # The scan names local files with one slash.
        rows += [(i, re.sub("^file:/+", "file:/", file)) for i in given.get(above, [])]
    return rows


def _large_gzip(spark: SparkSession, files: Sequence[str], range_bytes: int) -> list[tuple[str, str, int]]:
    """(file_path, URI, bytes) of the gzip files of more than one range that tasks can open."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for file in files:
        # A name with escapes could mean another file there.
        if not file.endswith(".gz") or not file.startswith(tuple(f"{s}:" for s in SCHEMES)) or "%" in file:
            continue
        place = hadoop.Path(file)
        size = place.getFileSystem(conf).getFileStatus(place).getLen()
        if size > range_bytes:
            found.append((file, re.sub("^file:/+", "file:///", file), size))
    return found


def _lines(spark: SparkSession, paths: Sequence[str], range_bytes: int | None) -> DataFrame:
    """All lines of all paths; the files of a path are known by the driver anyway.

    Spark's text source reads whatever it can cut into splits, or need not cut; large
    gzip files are read in ranges by their members.
    """
    inputs = _inputs(spark, paths)
    # The setting is read by Spark as bytes with a unit.
    most = range_bytes or spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    files = list(dict.fromkeys(f for _, f in inputs))
    large = _large_gzip(spark, files, most)
    text = spark.read.text(list(dict.fromkeys(paths))).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block_start"), "value")
    parts = [text]
    if large:
        # By that, files are left out before the scan lists its tasks.
        parts = [text.where(~F.col("file_path").isin([name for name, _, _ in large]))] if len(large) < len(files) else []
        spark.dataSource.register(GzipMembers)
        parts.append(spark.read.format(FORMAT).option("files", json.dumps(large)).option("range", str(most)).load())
    read = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return read.select("file_path", "block_start", F.rtrim(F.col("value"), F.lit("\r")).alias("line")).join(
        F.broadcast(spark.createDataFrame(inputs, "file_ind int, file_path string")), "file_path")


def _splits(lines: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Per split, in a written table: lines before it in its input, and lines per record."""
    first_byte = F.coalesce(*[F.when(F.col("first") == ord(kind), kind) for kind in RECORD_LINES], F.lit(""))
    counted = materialize(lines.withColumn("at", F.monotonically_increasing_id()).groupBy("file_ind", *SPLIT).agg(
        F.count("*").alias("n_lines"),
        # As a number: strings would have Spark sort all lines for this.
        F.min_by(F.ascii("line"), "at").alias("first")).withColumn("first_byte", first_byte).drop("first"), "splits")
    before = lambda w: F.coalesce(F.sum("n_lines").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_input = Window.partitionBy("file_ind").orderBy("file_path")
    files = counted.groupBy("file_ind", "file_path").agg(
        F.sum("n_lines").alias("n_lines"), F.min_by("first_byte", "block_start").alias("first_byte")).select(
        "file_ind", "file_path", before(of_input).alias("ahead"), F.first("first_byte").over(of_input).alias("kind"))
    in_file = Window.partitionBy("file_ind", "file_path").orderBy("block_start")
    placed = counted.withColumn("before", before(in_file)).join(files, ["file_ind", "file_path"])
    wrong = placed.where(~F.col("kind").isin(*RECORD_LINES)).select("file_ind").first()
    if wrong:
        raise ValueError(f"{paths[wrong.file_ind]} starts with neither '>' nor '@'")
    step = F.when(F.col("kind") == FASTA, RECORD_LINES[FASTA]).otherwise(RECORD_LINES[FASTQ])
    return placed.select("file_ind", *SPLIT, (F.col("before") + F.col("ahead")).alias("before"), step.alias("step"))


class _Split:
    """Turns the lines of one split, as they come, into records and fragments."""

    def __init__(self, file_ind: int, before: int, step: int):
        self.file_ind, self.line, self.step = file_ind, before, step
        self.waiting = pa.array([], pa.string())

    def add(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        head = min(-self.line % self.step, len(lines)) if not len(self.waiting) else 0
        if head:
            yield self._fragments(lines[:head])
            lines = lines[head:]
        lines = pa.concat_arrays([self.waiting, lines])
        n = len(lines) // self.step
        if n:
            yield self._records(lines, n)
        self.waiting = lines[n * self.step:]

    def end(self) -> Iterator[pa.RecordBatch]:
        if len(self.waiting):
            yield self._fragments(self.waiting)
            self.waiting = self.waiting[:0]

    def _records(self, lines: pa.Array, n: int) -> pa.RecordBatch:
        def every(slot: int) -> pa.Array:
            return lines.take(pa.array(np.arange(n) * self.step + slot))

        none = pa.nulls(n, pa.string())
        return self._batch(n, self.line // self.step + np.arange(n), every(0), every(1),
                           every(3) if self.step == 4 else none, pa.nulls(n, pa.int32()), none,
                           n * self.step)

    def _fragments(self, lines: pa.Array) -> pa.RecordBatch:
        n, none = len(lines), pa.nulls(len(lines), pa.string())
        at = self.line + np.arange(n)
        return self._batch(n, at // self.step, none, none, none,
                           pa.array((at % self.step).astype(np.int32)), lines, n)

    def _batch(self, n, read_idx, name, seq, qual, slot, line, used) -> pa.RecordBatch:
        self.line += used
        file_ind = pa.array(np.full(n, self.file_ind, dtype=np.int32))
        return pa.RecordBatch.from_arrays(
            [file_ind, pa.array(read_idx.astype(np.int64)), name, seq, qual, slot, line],
            names=_PARSED.names)


def read_fastx(spark: SparkSession, paths: Sequence[str] | str, range_bytes: int | None = None) -> DataFrame:
    """Reads of the given files, in their order; ``qual`` is NULL for FASTA.

    The parsed reads are written once to the shared folder: every later pass is a
    scan of columns instead of text. A path may also be a folder of part files.
    ``range_bytes``: what a task reads of a gzip file of many members; by default what
    one reads of other files.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = _lines(spark, paths, range_bytes)
    # One row for each split, like the scan's own list of tasks.
    placed = lines.join(F.broadcast(_splits(lines, paths)), ["file_ind", *SPLIT])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A path given twice has its lines twice, side by side: one state for each input.
        now, open_ = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            where = batch["before"].to_numpy(), batch["file_ind"].to_numpy(), batch["block_start"].to_numpy()
            if all((w == w[0]).all() for w in where):  # one split of one input, as a rule
                parts = [np.arange(batch.num_rows)]
            else:
                _, first, inverse = np.unique(np.stack(where), axis=1, return_index=True, return_inverse=True)
                # As they come: a task may read a later file first.
                parts = [np.flatnonzero(inverse.ravel() == c) for c in np.argsort(first)]
            for rows in parts:
                before, file_ind, start = (int(w[rows[0]]) for w in where)
                key = (batch["file_path"][int(rows[0])].as_py(), start)
                if key != now:
                    for split in open_.values():
                        yield from split.end()
                    now, open_ = key, {}
                if file_ind not in open_:
                    open_[file_ind] = _Split(file_ind, before, batch["step"][int(rows[0])].as_py())
                yield from open_[file_ind].add(batch["line"].take(pa.array(rows)))
        for split in open_.values():
            yield from split.end()

    parsed = materialize(placed.mapInArrow(task, _PARSED), "parsed")

    def piece(slot: int) -> F.Column:
        return F.max(F.when(F.col("slot") == slot, F.col("line")))

    cut = (parsed.where(F.col("slot").isNotNull()).groupBy(*KEYS)
           .agg(piece(0).alias("id"), piece(1).alias("seq"), piece(3).alias("qual"))
           .where(F.length("id") > 0))
    whole = parsed.where(F.col("slot").isNull() & (F.length("id") > 0))
    return whole.select(*READ_SCHEMA.names).unionByName(cut.select(*READ_SCHEMA.names))


def record_text(reads: DataFrame) -> DataFrame:
    """One ``value`` per read: its lines, without the last line end."""
    quality = F.when(F.col("qual").isNull(), "").otherwise(F.concat(F.lit("\n+\n"), "qual"))
    return reads.withColumn("value", F.concat("id", F.lit("\n"), "seq", quality))


# Gzip levels by the names the codec knows.
ZLIB_LEVELS = ("NO_COMPRESSION", "BEST_SPEED", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN",
               "EIGHT", "BEST_COMPRESSION")


# Reads that one task sorts and writes, where their number is given.
PART_READS = 100_000


def _in_order(text: DataFrame, rows: int | None) -> DataFrame:
    """Ranges of reads; of many given rows in as many ranges as keep each to about ``PART_READS``."""
    ranges = -(-(rows or 0) // PART_READS)
    if ranges > text.sparkSession.sparkContext.defaultParallelism:
        return text.repartitionByRange(ranges, *KEYS)
    return text.repartitionByRange(*KEYS)


def write_fastx(reads: DataFrame, paths: Sequence[str], folder: str, level: int = 1, rows: int | None = None) -> None:
    """Write each input's reads, in order, under ``folder``; ``rows``: about how many there are.

    Each input becomes one folder ``output=<name>`` of part files whose names sort in
    read order: written one after the other they are the file of that name. (gzip
    members may follow each other in one file.) What the folder of an output held
    before is replaced; other outputs stay.
    """
    if not 0 <= level <= 9:
        raise ValueError(f"compression level must be 0 to 9, not {level}")
    spark = reads.sparkSession
    named = spark.createDataFrame(list(enumerate(paths)), "file_ind int, path string")
    # One row per input file.
    placed = reads.join(F.broadcast(named), "file_ind")
    text = record_text(placed).select(
        *KEYS, "value", output_name(F.col("path"), F.col("qual").isNotNull(), level).alias("output"))
    # The writer needs rows grouped by output; with that first, it does not sort again.
    ordered = _in_order(text, rows).sortWithinPartitions("output", *KEYS)
    zipped = {path.endswith("gz") and level > 0 for path in paths}
    for compressed in sorted(zipped):
        part = ordered if len(zipped) == 1 else ordered.where(F.col("output").endswith(".gz") == compressed)
        (part.select("value", "output").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("output").option("compression", "gzip" if compressed else "none")
         .option("zlib.compress.level", ZLIB_LEVELS[level]).text(folder))
