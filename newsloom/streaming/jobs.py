"""Structured Streaming jobs; each takes streaming DataFrames and returns one.

Where a job has a batch twin it uses the twin's expressions, so both give the
same rows once the input is complete.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from newsloom.operators import ingest, profiles
from newsloom.sources.append import append_new

# How much later than newer events an event may arrive; each job takes it as an argument.
LATENESS = "1 day"


def stream_ingest(raw: DataFrame, as_of: Column) -> DataFrame:
    """Rows that pass the gate, under their normalized URL.

    Append the result with ``ingest_sink``, which stores each URL and each
    content once; so the stream itself keeps no state.
    """
    gated = ingest.ingest_gate(raw, as_of).where("gate = 'pending'")
    return gated.withColumn("source_url", F.coalesce(F.nullif("normalized_url", F.lit("")), "source_url"))


#: How long a stored URL or content counts as known: rows published longer ago do not pass the gate.
KNOWN_DAYS = 2


def ingest_sink(table: str, order_col: str, as_of: Column):
    """``foreachBatch`` function: append rows whose URL and content were not stored in the days around theirs.

    Rows go to ``rows``, their keys to ``keys``, a narrow index in folders by
    day of publication (``as_of`` where it is unknown).  A batch looks up the
    folders of its own days and ``KNOWN_DAYS`` around them by name, so its cost
    depends on what was stored in these days, not on the table.  Both are
    written under the batch id: a replay after a lost executor replaces its own
    rows and keys and adds none twice.
    """
    rows, keys = f"{table}/rows", f"{table}/keys"
    key_schema = "source_url string, content_hash string, day date, batch long"

    def existing(spark, paths: list[str]) -> list[str]:
        found = []
        for path in paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            if where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
                found.append(path)
        return found

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        dated = batch.withColumn("day", F.to_date(F.coalesce("published_at", as_of))).persist()
        try:
            first, last = dated.agg(F.min("day"), F.max("day")).first()
            if batch_id == 0:
                # an empty first part, so that the table can be read
                stored = T.StructType([*batch.schema.fields, T.StructField("content_hash", T.StringType())])
                spark.createDataFrame([], stored).write.mode("overwrite").parquet(f"{rows}/batch=-1")
            if first is None:
                return
            days = [first + timedelta(days=k) for k in range(-KNOWN_DAYS, (last - first).days + KNOWN_DAYS + 1)]
            folders = existing(spark, [f"{keys}/day={d}" for d in days])
            if folders:
                known = spark.read.schema(key_schema).option("basePath", keys).parquet(*folders).where(F.col("batch") < batch_id)
            else:
                known = spark.createDataFrame([], key_schema)
            inserts, _ = append_new(dated, known.select("source_url", "content_hash"), order_col)
            inserts.drop("day").write.mode("overwrite").parquet(f"{rows}/batch={batch_id}")
            added = spark.read.parquet(f"{rows}/batch={batch_id}")
            index = added.select("source_url", "content_hash", F.to_date(F.coalesce("published_at", as_of)).alias("day"), F.lit(batch_id).alias("batch"))
            index.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(keys)
        finally:
            dated.unpersist()

    return save


def stream_impressions(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Impressions and skips once per (user, article, type, day); update mode."""
    kinds = events.where(F.col("event_type").isin("impression", "skip")).withWatermark("created_at", lateness)
    position = F.when(F.col("event_type") == "impression", F.col("position"))
    grouped = kinds.groupBy(F.window("created_at", "1 day").alias("w"), "user_id", "ai_news_id", "event_type").agg(
        F.min("created_at").alias("first_at"), F.max_by(position, F.struct("created_at", "event_id")).alias("position")
    )
    return grouped.select("user_id", "ai_news_id", "event_type", F.to_date("w.start").alias("day"), "first_at", "position")


def stream_interactions(log: DataFrame) -> DataFrame:
    """Running fold of the interaction log per (user, article); update mode."""
    return profiles.effective_interactions(log).groupBy("user_id", "ai_news_id").agg(*profiles.interaction_aggregates())


def stream_activity(events: DataFrame, window: str, slide: str | None = None, lateness: str = LATENESS) -> DataFrame:
    """Event counts per tumbling or sliding window and type; update mode."""
    span = F.window("created_at", window, slide) if slide else F.window("created_at", window)
    counts = events.withWatermark("created_at", lateness).groupBy(span.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n")


def stream_sessions(events: DataFrame, articles: DataFrame, topics: Sequence[str], gap: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    """Topic counts per user session of liked and viewed articles; append mode.

    A session closes after ``gap`` without events and ``lateness`` on top; open
    ones are not emitted.
    """
    touched = events.where(F.col("event_type").isin("view", "long_view", "like")).withWatermark("created_at", lateness)
    named = touched.join(articles.select("ai_news_id", F.lower("category").alias("topic")), "ai_news_id")
    counts = [F.count_if(F.col("topic") == t).alias(f"n_{t}") for t in topics]
    sessions = named.groupBy(F.session_window("created_at", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"), *counts)
    return sessions.select("user_id", F.col("s.start").alias("started_at"), F.col("s.end").alias("ended_at"), "n", *[f"n_{t}" for t in topics])


#: Shares of a user's counters, and the groups that all shares of all users are dealt to.
PROFILE_SHARES = 4
PROFILE_GROUPS = 2048


class _ClampedCounters(StatefulProcessor):
    """Counters that never fall below zero, with the time of their last change: those of one group, or of one user where rows name none."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState(
            "counters", "users array<long>, kinds array<string>, keys array<string>, counts array<long>, seen_us array<long>"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # the moves of one micro-batch, in log order
        moves = pd.concat(list(rows)).sort_values("seq")
        users = moves["user_id"].tolist() if "user_id" in moves else [key[0]] * len(moves)
        held = self.counters.get() if self.counters.exists() else ([], [], [], [], [])
        counters = dict(zip(zip(*held[:3]), zip(*held[3:])))
        moved = {}
        for *name, delta, seen in zip(users, moves["kind"].tolist(), moves["key"].tolist(), moves["delta"].tolist(), moves["seen_us"].tolist()):
            name = tuple(name)
            count, last = counters.get(name, (0, seen))
            counters[name] = moved[name] = max(count + delta, 0), max(last, seen)
        self.counters.update(tuple(list(column) for column in (*zip(*counters), *zip(*counters.values()))))
        yield pd.DataFrame(
            [(*name, *state) for name, state in moved.items()], columns=["user_id", "kind", "key", "count", "seen_us"]
        )

    def close(self) -> None:
        pass


def stream_profiles(deltas: DataFrame) -> DataFrame:
    """Clamped interest counters per (user, kind, key); update mode.

    A call and a state value per key or user would cost far more than its few
    moves.  So the counters of a user fall into ``PROFILE_SHARES`` shares, by key,
    which spreads a busy user, and all shares into ``PROFILE_GROUPS`` groups with
    one state value each.  A micro-batch makes at most so many calls, however
    many users there are, and rewrites the values of the groups it moves.
    """
    share = F.pmod(F.xxhash64("kind", "key"), F.lit(PROFILE_SHARES))
    grouped = deltas.select(
        F.pmod(F.xxhash64("user_id", share), F.lit(PROFILE_GROUPS)).cast("int").alias("group"),
        "user_id",
        "kind",
        "key",
        "seq",
        F.col("delta").cast("long").alias("delta"),
        F.unix_micros("created_at").alias("seen_us"),
    )
    counted = grouped.groupBy("group").transformWithStateInPandas(
        statefulProcessor=_ClampedCounters(),
        outputStructType="user_id long, kind string, key string, count long, seen_us long",
        outputMode="Update",
        timeMode="None",
    )
    return counted.select("user_id", "kind", "key", "count", F.timestamp_micros("seen_us").alias("last_seen"))


class _StaleJobs(StatefulProcessor):
    """Reports a job that stays in processing beyond the limit, by data or by timer."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.started = handle.getValueState("started", "at_ms long")

    def _report(self, key, at_ms: int) -> pd.DataFrame:
        start = pd.Timestamp(at_ms, unit="ms")
        return pd.DataFrame({"item": [key[0]], "started_at": [start], "stale_at": [start + pd.Timedelta(self.ttl_ms, "ms")]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        log = pd.concat(list(rows)).sort_values("created_at")
        at = self.started.get()[0] if self.started.exists() else None
        if at is not None:
            self.handle.deleteTimer(at + self.ttl_ms)
        for status, when in zip(log["status"], log["created_at"]):
            now = when.value // 1_000_000
            if at is not None and now > at + self.ttl_ms:
                yield self._report(key, at)
            at = now if status == "processing" else None
        if at is None:
            self.started.clear()
        else:
            self.started.update((at,))
            self.handle.registerTimer(at + self.ttl_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self.started.get()[0]
        self.started.clear()
        yield self._report(key, at)

    def close(self) -> None:
        pass


def stream_stale_jobs(status_log: DataFrame, ttl_minutes: int = 10, lateness: str = "0 seconds") -> DataFrame:
    """(item, started_at, stale_at) of jobs in processing longer than the limit; append mode.

    A job's rows of one batch are read in time order; the timer of a job that is
    still open fires once the watermark, ``lateness`` behind the newest row,
    passes its limit.
    """
    return (
        status_log.withWatermark("created_at", lateness)
        .groupBy("item")
        .transformWithStateInPandas(
            statefulProcessor=_StaleJobs(ttl_minutes * 60_000),
            outputStructType="item long, started_at timestamp, stale_at timestamp",
            outputMode="Append",
            timeMode="EventTime",
        )
    )
