"""Cutting a plan: a table written once, as Parquet, to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only on one machine (a local master), where it is unset, a temporary one is made."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if have := spark.sparkContext.getCheckpointDir():
        return have.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    at = tempfile.mkdtemp(prefix="spark-scratch-")
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(at)
    return f"file://{at}"


#: Spark's own setting that a statement's shuffle files go when it ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Of what is written inside, the shuffle files go as soon as it is written; else they stay until the driver happens to collect its garbage."""
    was = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.unset(TIDY) if was is None else spark.conf.set(TIDY, was)


class Cut:
    """cut(df) writes df to the shared folder and reads it back; what the file says of its size is true.

    (A DataFrame.checkpoint keeps the estimate of the plan it cuts; in a loop of joins that estimate's digits double with every round.)
    With `codec`, files are compressed so.
    """

    def __init__(self, spark: SparkSession, codec: str | None = None):
        self.spark, self.at, self.codec = spark, folder(spark), codec
        self._paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
        self._there: set[str] = set()

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.at}/cut-{uuid.uuid4().hex}"
        with tidied(df.sparkSession):
            df.write.parquet(path, compression=self.codec)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[out] = path
        self._there.add(path)
        return out

    def counted(self, df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
        """The written table, and aggregates of it that the job which writes it takes along."""
        seen = Observation()
        out = self(df.observe(seen, *[c.alias(n) for n, c in counts.items()]))
        return out, {n: seen.get[n] or 0 for n in counts}

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that this made and nobody reads any more; others are left alone."""
        for df in tables:
            if path := self._paths.pop(df, None):
                self._delete(path)

    def clear(self) -> None:
        """Removes all tables that this made."""
        for path in list(self._there):
            self._delete(path)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        self._there.discard(path)


def checkpointed(spark: SparkSession, codec: str | None = None) -> Cut:
    return Cut(spark, codec)
