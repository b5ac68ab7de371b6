"""Folders that driver and executors share, and versioned records in them."""

from __future__ import annotations

import json
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder serves where it is unset on a single machine only."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="corpusloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: With this setting Spark deletes a query's shuffle files as the query ends; else they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession):
    """Within it the shuffle files of a query go as it ends; for queries that are not run again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)


def cut(df: DataFrame) -> DataFrame:
    """Write a DataFrame to the shared checkpoint folder and go on from the written rows."""
    checkpoint_folder(df.sparkSession)
    with cleaned(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a query of its own, so that no shuffle is shared with later ones


def written(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """Write a DataFrame as Parquet and go on from the written rows."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    with cleaned(df.sparkSession):
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in any store that Spark writes to."""
    store, where = _path(spark, path)
    store.delete(where, True)


class Record:
    """A small record with versions: each publish writes the next one, and readers take the latest that is complete.

    A version is a folder with one line of JSON; it counts once Spark's writer has marked it as done, so a reader sees
    the old or the new one, never a part, and a version that exists is never written again: of two writers at once the
    slower one fails."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def versions(self) -> list[int]:
        store, where = _path(self.spark, self.path)
        if not store.exists(where):
            return []
        names = [s.getPath().getName() for s in store.listStatus(where)]
        done = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and store.exists(_path(self.spark, f"{self.path}/{n}/_SUCCESS")[1])]
        return sorted(done)

    def read(self, version: int | None = None) -> dict | None:
        known = self.versions()
        if not known:
            return None
        return json.loads(self.spark.read.text(f"{self.path}/v{known[-1] if version is None else version}").first()[0])

    def publish(self, content: dict, after: int | None = None) -> int:
        """Write the next version; `after` names the version that the content was made from, if that matters."""
        latest = (self.versions() or [0])[-1]
        if after is not None and after != latest:
            raise ValueError(f"version {latest} of {self.path} came in between")
        self.spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.mode("error").text(f"{self.path}/v{latest + 1}")
        return latest + 1
