"""Intermediate tables in the folder that all executors share.

Iterative jobs cut their lineage here: a table is written as Parquet below ``spark.checkpoint.dir`` and read
again, so an executor that is lost costs the tasks it held and nothing before the last write.
"""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that go to Python at a time at most, and of a row group, so that a task's memory doesn't grow with the length of texts.
MOST_BYTES = 8 << 20
#: The same for operators that take texts run by run: a worker holds little more than a run, and so does the JVM on both of its sides.
RUN_BYTES = 2 << 20


def small_batches(spark: SparkSession, most: int = MOST_BYTES) -> None:
    """Bounds the session's Arrow batches by bytes, where they aren't yet; rows are only dealt differently."""
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_BYTES))
    if not 0 < now <= most:
        spark.conf.set(BATCH_BYTES, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; only where a local session names none (tests) is one made and set."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"{KEY} must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="stereolith-")
        spark.conf.set(KEY, found)
    return found.rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the default file system where it names none."""
    if urlparse(path).scheme:
        return path
    jvm = spark.sparkContext._jvm
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    return str(jvm.org.apache.hadoop.fs.Path(path).getFileSystem(hadoop).getUri()).rstrip("/") + path


class Scratch:
    """A folder of tables for one run of one job; ``drop`` removes tables that no returned frame reads."""

    def __init__(self, spark: SparkSession, job: str, batch_bytes: int = MOST_BYTES):
        small_batches(spark, batch_bytes)
        self.spark = spark
        self.root = qualified(spark, f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex}")
        self.made: list[str] = []

    def path(self, name: str) -> str:
        at = f"{self.root}/{len(self.made):03d}-{name}"
        self.made.append(at)
        return at

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, written and read again."""
        at = self.path(name)
        df.write.option("parquet.block.size", MOST_BYTES).parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, keep: tuple[str, ...] = ()) -> None:
        jvm = self.spark.sparkContext._jvm
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        for at in self.made:
            if not at.endswith(tuple(f"-{k}" for k in keep) or ("\0",)):
                p = jvm.org.apache.hadoop.fs.Path(at)
                p.getFileSystem(hadoop).delete(p, True)
