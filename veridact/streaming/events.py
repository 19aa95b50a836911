"""Structured Streaming over append-only event logs: following, latest status, pairing, staleness and windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def follow(spark: SparkSession, path: str, schema: str = EVENT, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of the event files below ``path``, each read once when it is closed; a torn last line shows as nulls and is left out."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("mode", "PERMISSIVE").json(path)
    return stream.filter("event_id IS NOT NULL")


def from_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of Parquet event files."""
    return spark.readStream.schema(schema).parquet(path)


def deduplicated(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events by id, once; state lives as long as the watermark allows repeats."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def latest_status(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The last event type per key, by time and id; for update or complete mode."""
    return stream.groupBy(*keys).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("at"), F.count("*").alias("n"))


def tumbling(stream: DataFrame, width: str, delay: str) -> DataFrame:
    """Events by window and type; a window is final once the watermark passes it."""
    g = stream.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(stream: DataFrame, gap: str, delay: str) -> DataFrame:
    g = stream.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def paired(starts: DataFrame, ends: DataFrame, key: str, within: str, delay: str) -> DataFrame:
    """Starts with their end if one follows ``within`` that time; a start without one comes once the watermark has passed."""
    a = starts.select(F.col(key).alias("start_key"), F.col("ts").alias("began")).withWatermark("began", delay)
    b = ends.select(F.col(key).alias("end_key"), F.col("ts").alias("ended")).withWatermark("ended", delay)
    when = F.expr(f"start_key = end_key AND ended >= began AND ended <= began + INTERVAL {within}")
    return a.join(b, when, "leftOuter")


def stale(stream: DataFrame, key: str, seconds: int) -> DataFrame:
    """(key, last_seen, stale): a row for each key and batch, and one more with ``stale`` true when it falls silent so long.

    State per key is one time stamp; the timer runs on event time.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "last_seen": [last], "stale": [True]})
            return
        last = state.get[0] if state.exists else None
        for pdf in batches:
            top = pdf["ts"].max()
            last = top if last is None or top > last else last
        state.update((last,))
        due = int(last.timestamp() * 1000) + seconds * 1000
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], "last_seen": [last], "stale": [False]})

    kind = stream.schema[key].dataType.simpleString()
    marked = stream.withWatermark("ts", "0 seconds").select(key, "ts")
    return marked.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, last_seen timestamp, stale boolean", "last timestamp", "append", GroupStateTimeout.EventTimeTimeout)


def gaps_in_sequence(df: DataFrame, stream_key: str, sequence: str) -> DataFrame:
    """(key, after, missing): places where a log's sequence isn't contiguous; for a batch of a followed log."""
    from pyspark.sql import Window

    w = Window.partitionBy(stream_key).orderBy(sequence)
    after = F.lag(sequence).over(w)
    return df.select(stream_key, after.alias("after"), (F.col(sequence) - after - 1).alias("missing")).filter("missing > 0")


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there now, into a table in memory."""
    spark = stream.sparkSession
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def pairings(events: DataFrame, key: list[str], starts: list[str], ends: list[str]) -> DataFrame:
    """(key, state, seconds, missing) of a batch of start and terminal events (type, at, sequence) by key.

    complete: one start and terminals of one type, from the start to the last of them; running: no terminal; unstarted: no start;
    conflict: several starts, or terminals of several types, and no time; inconsistent: an end before its start.
    """
    start, end = F.col("type").isin(*starts), F.col("type").isin(*ends)
    g = events.filter(start | end).groupBy(*key).agg(
        F.count_if(start).alias("starts"), F.count_distinct(F.when(end, F.col("type"))).alias("kinds"), F.min(F.when(start, F.col("at"))).alias("begun"), F.max(F.when(end, F.col("at"))).alias("ended"),
    )
    seconds = F.unix_timestamp(F.col("ended").cast("timestamp")) - F.unix_timestamp(F.col("begun").cast("timestamp"))
    state = (
        F.when((F.col("starts") > 1) | (F.col("kinds") > 1), "conflict").when(F.col("starts") == 0, "unstarted").when(F.col("kinds") == 0, "running")
        .when(F.col("ended") < F.col("begun"), "inconsistent").otherwise("complete")
    )
    missing = F.when(state == "unstarted", "start").when(state == "running", "terminal")
    return g.select(*key, state.alias("state"), F.when(state == "complete", seconds).alias("seconds"), missing.alias("missing"))


def silent(events: DataFrame, key: list[str], progress: list[str], now, seconds: int) -> DataFrame:
    """(key, last, silent_seconds, alert): how long each key of a batch has made no progress at an instant; null last if it never did."""
    at = F.col("at").cast("timestamp")
    last = F.max(F.when(F.col("type").isin(*progress), at))
    g = events.groupBy(*key).agg(last.alias("last"))
    quiet = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last")
    return g.select(*key, "last", quiet.alias("silent_seconds"), F.coalesce(quiet > seconds, F.lit(True)).alias("alert"))
