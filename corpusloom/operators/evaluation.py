"""Retrieval evaluation: ranks, recall, reciprocal rank, revision safety, probe queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.search import id_sizes, postings, term_counts
from corpusloom.storage import cut

#: Words of two chunks or more that are broadcast with their counts; more of them are joined by a shuffle.
BROADCAST_WORDS = 1_000_000


def hit_at(rank: Column, k: int) -> Column:
    return F.coalesce(rank <= k, F.lit(False))


def reciprocal(rank: Column) -> Column:
    return F.coalesce(1 / rank, F.lit(0.0))


def rate(flag: str) -> Column:
    return F.avg(F.when(F.col(flag), 1.0).otherwise(0.0))


def outcomes(results: DataFrame) -> DataFrame:
    """One row per query from results(query_id, unit, rank, category, relevant, stale): recall, best rank, safety."""
    at = lambda flag: F.min(F.when(F.col(flag), F.col("rank")))
    within = lambda k: F.count_if(F.col("relevant") & (F.col("rank") <= k))
    q = results.groupBy("query_id").agg(
        F.min("category").alias("category"), at("relevant").alias("best"), at("stale").alias("stale"), F.count_if(F.col("relevant")).alias("units"), within(5).alias("h5"), within(10).alias("h10")
    )
    return q.filter("units > 0").withColumns({
        "recall_5": F.col("h5") / F.col("units"), "recall_10": F.col("h10") / F.col("units"), "reciprocal": reciprocal(F.col("best")),
        "revision_safe": F.col("best").isNotNull() & (F.col("stale").isNull() | (F.col("stale") > F.col("best"))),
    })


def summary(outcome: DataFrame, by: str) -> DataFrame:
    return outcome.groupBy(by).agg(
        F.count("*").alias("queries"), F.round(F.avg("recall_5"), 6).alias("recall_5"), F.round(F.avg("recall_10"), 6).alias("recall_10"),
        F.round(F.avg("reciprocal"), 6).alias("mrr"), F.round(rate("revision_safe"), 6).alias("revision_safe"),
    )


def probe_keywords(chunks: DataFrame, n: int, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The k words of each chunk with the largest tf * ln(1 + n / df), ties by length, then word.

    Words are counted within their row unless an id has several rows. A word that no other chunk has needs no entry among
    the counts, so that they can be broadcast; then k rows a chunk and task are shuffled, not every word."""
    texts = chunks.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    tf = postings(chunks, id_col, text_col) if id_sizes(texts)[0] else term_counts(texts).drop("dl")
    df = cut(tf.groupBy("term").agg(F.count("*").alias("df")).filter("df > 1"))
    df = F.broadcast(df) if df.count() <= BROADCAST_WORDS else df
    scored = tf.join(df, "term", "left").select("id", "term", F.round(F.col("tf") * F.log(1 + F.lit(float(n)) / F.coalesce("df", F.lit(1))), 6).alias("score"))
    order = Window.partitionBy("id").orderBy(F.desc("score"), F.desc(F.length("term")), "term")
    return scored.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= k).drop("k")
