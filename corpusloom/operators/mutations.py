"""Store operations as rewrites: upsert, delete, snapshots, batches, sweeps."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def clear_pointers(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Pointers to deleted documents become null."""
    lost = gone.select(F.col("document_id").alias("_gone")).distinct()
    joined = docs.join(lost, F.col("superseded_by") == F.col("_gone"), "left")
    return joined.withColumn("superseded_by", F.when(F.col("_gone").isNull(), F.col("superseded_by"))).drop("_gone")


def boosts(rows: DataFrame) -> DataFrame:
    """Boosts clamped to [-1, 1]; a zero deletes."""
    return rows.withColumn("boost", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("boost").cast("double")))).filter("boost <> 0")


def contacts(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct().groupBy("address").agg(F.countDistinct("share").alias("shares"))


def sweep(rows: DataFrame, ts: str, now: datetime.datetime, days: int) -> DataFrame:
    """Rows that are not older than a number of days."""
    return rows.filter(F.col(ts) >= F.lit(now - datetime.timedelta(days=days)))


def snapshot_diff(previous: DataFrame, current: DataFrame, superseded: DataFrame) -> DataFrame:
    """(id, name, change): added, replaced (known name, new id), superseded, removed."""
    p, n = previous.withColumn("_p", F.lit(1)), current.withColumn("_n", F.lit(1))
    added = n.join(p.select("id", "_p"), "id", "left").filter("_p is null").join(p.select("name", F.lit(1).alias("_same")).distinct(), "name", "left")
    added = added.select("id", "name", F.when(F.col("_same").isNotNull(), "replaced").otherwise("added").alias("change"))
    lost = p.join(n.select("id", "_n"), "id", "left").filter("_n is null").join(n.select("name").distinct(), "name", "left_anti")
    lost = lost.join(superseded.select("id", F.lit(1).alias("_s")), "id", "left").select("id", "name", F.when(F.col("_s").isNotNull(), "superseded").otherwise("removed").alias("change"))
    return added.unionByName(lost)


def split_unchanged(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files with a flag whether their content is known already."""
    have = known.select("content_hash", F.lit(True).alias("_have")).distinct()
    return files.join(have, "content_hash", "left").select("document_id", F.coalesce("_have", F.lit(False)).alias("unchanged"))


def document_batches(docs: DataFrame, group: str, order: str, weight: str, size: int) -> DataFrame:
    """Whole documents dealt into consecutive batches of about `size` chunks, group by group."""
    before = F.sum(weight).over(Window.partitionBy(group).orderBy(order)) - F.col(weight)
    return docs.withColumn("batch", F.floor(before / size).cast("long"))


def supersede_check(pointers: DataFrame, most: int = 50) -> DataFrame:
    """(document_id, rejected): pointers to oneself, to unknown documents or into a cycle are rejected.

    Chains are followed by pointer jumping: each round doubles how far every pointer sees."""
    ids = pointers.select(F.col("document_id").alias("_id"))
    live = pointers.filter("superseded_by is not null")
    known = live.join(ids, F.col("superseded_by") == F.col("_id"), "left").withColumn("bad", F.col("_id").isNull() | (F.col("superseded_by") == F.col("document_id"))).drop("_id")
    jump = known.filter("not bad").select("document_id", F.col("superseded_by").alias("to"))
    for _ in range(max(1, most.bit_length())):
        step = jump.select(F.col("document_id").alias("_from"), F.col("to").alias("_next"))
        jump = jump.join(step, F.col("to") == F.col("_from")).select("document_id", F.col("_next").alias("to"))
        if jump.isEmpty():
            break
    cyclic = jump.select("document_id", F.lit(True).alias("cyclic")).distinct()
    return known.join(cyclic, "document_id", "left").select("document_id", (F.col("bad") | F.coalesce("cyclic", F.lit(False))).alias("rejected"))
