"""What the operators share: reading tables, cutting lineage, joins on checked sizes, words."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Ids that a broadcast may hold: 16 bytes each in a hashed relation, so 32 MB at most.
BROADCAST_IDS = 2_000_000


#: With this setting Spark deletes a query's shuffle files as the query ends; else they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows that go to a Python worker at a time; texts may be long, and both sides hold several copies of a batch.
ROWS_PER_BATCH = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; sets the session's Arrow batches to a size that suits whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir, which driver and executors share.

    Where it is unset a temporary folder serves on a single machine; on a cluster that would be one which the executors
    cannot see, so it is an error there."""
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


def cut(df: DataFrame) -> DataFrame:
    """Write a DataFrame to the shared checkpoint folder and go on from the written rows."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables that a query writes as Parquet under the shared folder, each dropped once no later step reads it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.top, self.paths = spark, shared_folder(spark, name), {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Write a DataFrame and go on from the written rows; its lineage ends here."""
        self.paths[name] = f"{self.top}/{name}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(self.paths[name])
        finally:
            self.spark.conf.set(CLEANUP, before) if before is not None else self.spark.conf.unset(CLEANUP)
        return self.spark.read.schema(df.schema).parquet(self.paths[name])

    def drop(self, *names: str) -> None:
        """Delete tables; shuffle files whose queries are over go with them."""
        for name in names:
            remove(self.spark, self.paths.pop(name))
        release(self.spark)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in any store that Spark writes to."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Have Spark's cleaner delete the shuffle files of queries that are over; it acts when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lean(rows):
    """A map over Arrow batches that gives its memory back to the system when its task ends, as workers live on."""

    def run(batches):
        yield from rows(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library keeps its own account
            pass

    return run


def let(value, body):
    """body(value) with the value computed once a row: inside a lambda Spark evaluates an outer expression for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def by_ids(df: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """left_semi or left_anti on a column of ids: broadcast when their number is counted and small, else shuffled."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, key, how)


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8: bytes.split() parts at exactly the bytes that WORD excludes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


SPACE = re.compile(r"[\x20\x09-\x0D]+")
