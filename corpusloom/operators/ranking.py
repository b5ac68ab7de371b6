"""Ranking, demotion, merging and top-k within groups. Every order names its tie rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, score: str, tie: str, k: int) -> DataFrame:
    return rows.orderBy(F.desc(score), F.asc(tie)).limit(k)


def ranked(rows: DataFrame, score: str, tie: str) -> DataFrame:
    """Adds the 1-based rank over one result list (tens of rows, as retrieval returns them)."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(score), F.asc(tie))).cast("long"))


def demote_superseded(hits: DataFrame, penalty: float = 0.15) -> DataFrame:
    """Superseded hits lose a flat penalty and never fall below 0."""
    return hits.withColumn("score", F.when(F.col("superseded"), F.greatest(F.lit(0.0), F.col("score") - penalty)).otherwise(F.col("score")))


def merge_collections(parts: list[DataFrame], k: int, tie: str) -> DataFrame:
    """One list over collections: by rerank score if every hit has one, else by similarity."""
    rows = reduce(DataFrame.unionByName, parts)
    all_ranked = rows.filter(F.col("rerank").isNull()).isEmpty()
    return rows.orderBy(F.desc("rerank" if all_ranked else "similarity"), tie).limit(k)


def first_rank(results: DataFrame, wanted: DataFrame, group: str, id_col: str) -> DataFrame:
    """The best rank of a wanted id in each result list."""
    return results.join(wanted.select(id_col).distinct(), id_col, "left_semi").groupBy(group).agg(F.min("rank").alias("rank"))


def review_rank() -> Column:
    """Critical 100, held 90, reported 70 to 75, flagged 60 to 69, injection 55 or 40; the largest counts."""
    zero = F.lit(0)
    return F.greatest(
        F.when(F.col("critical"), 100).otherwise(zero), F.when(F.col("held"), 90).otherwise(zero),
        F.when(F.col("policy_score").isNotNull(), 60 + F.floor(9 * F.col("policy_score"))).otherwise(zero),
        F.when(F.col("reports") >= 0, 70 + F.least("reports", F.lit(5))).otherwise(zero),
        F.when(F.col("injection") == "high", 55).when(F.col("injection") == "medium", 40).otherwise(zero),
    )


def priority(rank: Column) -> Column:
    return F.when(rank >= 100, "critical").when(rank >= 70, "high").when(rank >= 50, "medium").otherwise("low")


def per_source(pairs: DataFrame, per_other: int = 2, most: int = 6) -> DataFrame:
    """Per document the best passages of others: at most two per other source, six in all, ties by passage."""
    best = pairs.groupBy("doc", "other", "passage").agg(F.max("score").alias("score"))
    order = [F.desc("score"), F.asc("passage")]
    few = best.withColumn("k", F.row_number().over(Window.partitionBy("doc", "other").orderBy(*order))).filter(F.col("k") <= per_other)
    return few.withColumn("k", F.row_number().over(Window.partitionBy("doc").orderBy(*order))).filter(F.col("k") <= most).drop("k")


def last_of_each(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The newest n rows of each group; Spark prunes each task's rows before the shuffle."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))).filter(F.col("_k") <= n).drop("_k")


def best_of_each(rows: DataFrame, group: str, order: list[Column], *columns: str) -> DataFrame:
    """The first row of each group under an order: an aggregate, so groups are folded before the shuffle."""
    key = F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)])
    return rows.groupBy(group).agg(*[F.min_by(c, key).alias(c) for c in columns])
