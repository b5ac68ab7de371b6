"""Structured Streaming over the events table. The windows are an extension of ours; each has a batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "1 hour"


def stream_of(spark: SparkSession, path: str, like: DataFrame, files: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder; event times become timestamps, which watermarks ask for."""
    rows = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", LATE) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "6 hours", step: str = "3 hours") -> DataFrame:
    rows = events.withWatermark("ts", LATE) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    rows = events.withWatermark("ts", LATE) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def deduplicated(events: DataFrame, key: str = "event_id") -> DataFrame:
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


BUCKET = "user_id long, event_id long, allowed boolean, left double"


def _take(tokens: float, last: float, now: float, burst: float, rate: float) -> tuple[bool, float]:
    tokens = min(burst, tokens + max(0.0, now - last) * rate)
    return (True, tokens - 1) if tokens >= 1 else (False, tokens)


def token_bucket(events: DataFrame, per_minute: float = 2.0) -> DataFrame:
    """(user_id, event_id, allowed, left): a bucket per user that refills with time; batch or stream.

    In a stream the bucket is keyed state that times out; in a batch each user's events go through in order of time."""
    rate = per_minute / 60

    def one(pdf: pd.DataFrame, tokens: float, last: float) -> tuple[list[tuple], float, float]:
        out = []
        for r in pdf.sort_values(["ts", "event_id"]).itertuples():
            now = r.ts.timestamp()
            ok, tokens = _take(tokens, last if last else now, now, per_minute, rate)
            last = max(last, now)
            out.append((r.user_id, r.event_id, ok, round(tokens, 6)))
        return out, tokens, last

    columns = ["user_id", "event_id", "allowed", "left"]
    if not events.isStreaming:
        return events.select("user_id", "event_id", "ts").groupBy("user_id").applyInPandas(lambda pdf: pd.DataFrame(one(pdf, per_minute, 0.0)[0], columns=columns), BUCKET)

    def keyed(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (per_minute, 0.0)
        for pdf in frames:
            out, tokens, last = one(pdf, tokens, last)
            yield pd.DataFrame(out, columns=columns)
        state.update((tokens, last))
        state.setTimeoutDuration(3_600_000)

    return events.select("user_id", "event_id", "ts").groupBy("user_id").applyInPandasWithState(keyed, BUCKET, "tokens double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return its rows, from a memory table."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
