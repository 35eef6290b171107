"""Intermediate tables that survive the loss of executors."""

from __future__ import annotations

import logging
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


log = logging.getLogger(__name__)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local one only under a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if not sc.master.startswith("local") and not shared_scheme(spark, named):
            log.warning("spark.checkpoint.dir %s is a local path: every executor must see the same folder there", named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="mendseq-"))
    return sc.getCheckpointDir()


def shared_scheme(spark: SparkSession, path: str) -> bool:
    """Whether a path names another file system than that of each machine."""
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(sc._jsc.hadoopConfiguration()).getScheme() != "file"


def new_table_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/mendseq-{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table."""
    spark = df.sparkSession
    path = new_table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Rows in one bucket of a written table, more or less.
BUCKET_ROWS = 4_000_000


@dataclass
class Bucketed:
    """A table written in sorted buckets by one column, which is then joined by it without being moved."""

    path: str
    columns: str
    key: str
    buckets: int

    @classmethod
    def write(cls, df: DataFrame, key: str, rows: int) -> Bucketed:
        """``rows``: about how many there are, which sets the number of buckets."""
        spark = df.sparkSession
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))
        name, path = f"mendseq_{uuid.uuid4().hex}", new_table_path(spark, "buckets")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
        spark.sql(f"drop table {name}")
        return cls(path, columns, key, n)

    @contextmanager
    def opened(self, spark: SparkSession) -> Iterator[DataFrame]:
        """The table; in the catalogue, which knows of its buckets, only as long as this lasts."""
        name = f"mendseq_{uuid.uuid4().hex}"
        spark.sql(f"create table {name} ({self.columns}) using parquet clustered by ({self.key}) sorted by ({self.key}) "
                  f"into {self.buckets} buckets location '{self.path}'")
        try:
            yield spark.table(name)
        finally:
            spark.sql(f"drop table {name}")


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partition a source that arrives in fewer splits than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(2 * cores, *cols)
