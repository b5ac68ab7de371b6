"""Aggregations: table statistics, rollups, facets, usage, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.listing import extension_key

FUNCTIONS = {"sum": F.sum, "mean": F.avg, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max}


def aggregate_table(rows: DataFrame, column: str, fn: str, group_by: str | None = None, sort_by: str | None = None, limit: int = 100) -> DataFrame:
    """One aggregate, by group or over all rows; sorted by value or group; 1 to 2,000 rows."""
    value = FUNCTIONS[fn](column).alias("value")
    if group_by is None:
        return rows.agg(value)
    out = rows.groupBy(F.col(group_by).alias("grp")).agg(value)
    order = [F.desc("value"), F.asc("grp")] if sort_by == "value" else [F.asc("grp")]
    return out.orderBy(*order).limit(max(1, min(2000, limit)))


def nearest_rank(column: str, p: float) -> Column:
    """The value at round(p * (n - 1)), halves to even: a nearest rank, not an interpolation."""
    ordered = F.array_sort(F.collect_list(column))
    return F.element_at(ordered, (F.bround(F.lit(p) * (F.count(column) - 1), 0) + 1).cast("int"))


def numeric_stats(rows: DataFrame, column: str) -> DataFrame:
    """min, max, mean, sum, count and nearest-rank p25, p50, p75 of one column.

    Ranks come from counts of distinct values and a running sum over them, so no task holds all values of the column:
    values are counted before the shuffle and range-partitioned, and each partition adds the counts of those before it."""
    values = rows.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    total = values.agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.sum("v").alias("sum"), F.count("v").alias("count"))
    counts = values.groupBy("v").agg(F.count("*").alias("c"))
    ranked = running(counts, "v", "c")
    n = total.first()["count"]
    if not n:
        return total.withColumns({f"p{p}": F.lit(None).cast("double") for p in (25, 50, 75)})
    at = {p: _bround(p / 100 * (n - 1)) for p in (25, 50, 75)}
    picks = ranked.agg(*[F.min(F.when(F.col("upto") > k, F.col("v"))).alias(f"p{p}") for p, k in at.items()])
    return total.join(F.broadcast(picks))  # one row beside one row


def _bround(x: float) -> int:
    return round(x)  # halves to even


def running(counts: DataFrame, key: str, count: str) -> DataFrame:
    """Adds `upto`, the sum of counts up to each key, without sorting all keys in one task."""
    from pyspark.sql import Window

    dealt = counts.repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id()).persist()
    parts = dealt.groupBy("_part").agg(F.sum(count).alias("_n")).withColumn("_one", F.lit(0))
    before = parts.select("_part", (F.sum("_n").over(Window.partitionBy("_one").orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.sum(count).over(Window.partitionBy("_part").orderBy(key))
    return dealt.join(F.broadcast(before), "_part").withColumn("upto", within + F.col("_before")).drop("_part", "_before")


def rollup(rows: DataFrame, keys: list[str], sums: list[str], labels: list[str], cost: str | None = None, quantity: str | None = None) -> DataFrame:
    """Lots to positions: the group is the first non-blank key; sums, label maxima, lots and the unit cost.

    Rows without any key, and total lines, are left out."""
    key = F.coalesce(*[F.nullif(F.trim(F.col(k).cast("string")), F.lit("")) for k in keys])
    kept = rows.withColumn("position", key).filter(F.col("position").isNotNull() & ~F.upper("position").rlike("^(GRAND |SUB)?TOTAL"))
    aggs = [F.sum(c).alias(c) for c in sums] + [F.max(c).alias(c) for c in labels] + [F.count("*").alias("lots")]
    out = kept.groupBy("position").agg(*aggs)
    if cost and quantity:
        out = out.withColumn("unit_cost", F.when(F.col(quantity) != 0, F.col(cost) / F.col(quantity)))
    return out


def collection_totals(docs: DataFrame) -> DataFrame:
    return docs.agg(
        F.count("*").alias("documents"), F.sum("num_pages").alias("pages"), F.sum("num_chunks").alias("chunks"), F.sum("file_size").alias("bytes"),
        F.min("uploaded_at").alias("first"), F.max("uploaded_at").alias("last"), F.count_if(F.col("file_size").isNull()).alias("no_size"), F.count_if(F.col("num_chunks") == 0).alias("no_chunks"),
    )


def by_extension(docs: DataFrame, top: int) -> DataFrame:
    return docs.groupBy(extension_key(F.col("filename")).alias("key")).agg(F.count("*").alias("n"), F.sum("file_size").alias("bytes")).orderBy(F.desc("n"), "key").limit(top)


def corpus_token(docs: DataFrame) -> DataFrame:
    """A token that changes when the corpus does."""
    parts = docs.agg(
        F.count("*").alias("a"), F.coalesce(F.max("uploaded_at"), F.lit("")).alias("b"), F.coalesce(F.sum("num_chunks"), F.lit(0)).alias("c"),
        F.count_if(F.col("policy_status") == "quarantined").alias("d"), F.count_if(F.col("superseded_by").isNotNull()).alias("e"),
    )
    return parts.select(F.concat_ws(":", "a", "b", "c", "d", "e").alias("token"))


def leading_text(chunks: DataFrame, max_chunks: int = 3, max_chars: int = 6000) -> DataFrame:
    """The first chunks of each document joined by a space and cut."""
    first = chunks.filter(F.col("chunk_index") < max_chunks)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), " ")
    return first.groupBy("document_id").agg(F.substring(joined, 1, max_chars).alias("leading"))


def usage_summary(events: DataFrame, since: str, group_by: str = "user") -> DataFrame:
    """Turns, values, distinct kinds and the last activity by user (null: anonymous) or by day."""
    key = F.coalesce(F.col("user_id").cast("string"), F.lit("anonymous")) if group_by == "user" else F.date_format("ts", "yyyy-MM-dd")
    return events.filter(F.col("ts") >= F.lit(since).cast("timestamp")).groupBy(key.alias("key")).agg(
        F.count("*").alias("turns"), F.sum("value").alias("total"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.max("ts").alias("last_active")
    )


def kind_counts(keys: DataFrame, kinds: DataFrame) -> DataFrame:
    """Extension counts folded into families; unknown ones are `other`."""
    return keys.join(kinds, "key", "left").groupBy(F.coalesce("kind", F.lit("other")).alias("kind")).agg(F.sum("n").alias("n"))


def token_histogram(rows: DataFrame, column: str, bounds: list[float], by: str) -> DataFrame:
    """Counts per bucket of given upper bounds; the last bucket is open."""
    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(column)))
    return rows.groupBy(by, bucket.alias("bucket")).agg(F.count("*").alias("n"))
