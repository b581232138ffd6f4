"""Streaming queries, run over the table files to the end of the input."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsloom.catalog.base import QUERIES, register, shape, ts
from newsloom.catalog.events import COUNTERS, HOSTS, KEYWORDS, MERGED
from newsloom.catalog.ingest import GATE, _gate_input
from newsloom.fixtures import Tables
from newsloom.operators import profiles, text
from newsloom.session import checkpoint_dir, cut_lineage
from newsloom.streaming import jobs
from newsloom.streaming.sinks import drain, file_stream, in_parts


#: Logs that are dealt into files in order, and the batches that their streams run in.
ORDERED = {"events": "ts", "pages": "page_id"}
BATCHES = 4


class StreamTables(Tables):
    """The same views over streaming reads: of logs in ``BATCHES`` parts in order, of other tables as they are."""

    def base(self, name):
        if name not in self._frames:
            table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            if name in ORDERED:
                folder = f"{checkpoint_dir(self.spark)}/newsloom-input-{uuid.uuid4().hex}"
                files = in_parts(table, ORDERED[name], BATCHES, folder, name)
                self._frames[name] = file_stream(self.spark, folder, name, table.schema, files_per_batch=files)
            else:
                self._frames[name] = file_stream(self.spark, self.sf_dir, name, table.schema)
        return self._frames[name]


def _live(t) -> StreamTables:
    return StreamTables(t.spark, t.sf_dir)


# rows that repeat one of a few addresses, in several spellings and over all batches
def _repeated(t):
    i = F.col("raw_news_id")
    again = F.concat(F.lit("https://site.example.org/again/"), (i % 5).cast("string"), F.when(i % 2 == 0, F.lit("?utm_source=x")).otherwise(F.lit("/")))
    return _gate_input(t).withColumn("source_url", F.when(i % 7 == 3, again).otherwise(F.col("source_url")))


def _ingest(t):
    spark = t.spark
    table = f"{checkpoint_dir(spark)}/newsloom-ingest-{uuid.uuid4().hex}"
    query = (
        jobs.stream_ingest(_repeated(_live(t)), t.as_of).writeStream.foreachBatch(jobs.ingest_sink(table, "raw_news_id", t.as_of))
        .option("checkpointLocation", f"{table}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return shape(spark.read.parquet(f"{table}/rows").select("raw_news_id", "normalized_url"))


_AGAIN = """gi AS (SELECT * REPLACE (CASE WHEN raw_news_id % 7 = 3 THEN 'https://site.example.org/again/' || raw_news_id % 5 || CASE WHEN raw_news_id % 2 = 0 THEN '?utm_source=x' ELSE '/' END
  ELSE source_url END AS source_url) FROM gi0)"""
register("stream_ingest", _ingest, "v_raw_news",
         "SELECT min(raw_news_id) AS raw_news_id, u AS normalized_url FROM (SELECT raw_news_id, CAST(u AS VARCHAR) AS u FROM gate JOIN gc USING (raw_news_id) WHERE gate = 'pending') GROUP BY u",
         GATE.replace("gi AS (", "gi0 AS (", 1).replace("gc AS (", f"{_AGAIN}, gc AS (", 1))

register("stream_impressions", lambda t: shape(drain(jobs.stream_impressions(_live(t).v_events), "update", ["user_id", "ai_news_id", "event_type", "day"])), "v_events", f"""
SELECT user_id, ai_news_id, event_type, strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS day, {ts('min(created_at)')} AS first_at,
  CASE WHEN event_type = 'impression' THEN CAST(arg_max(position, (created_at, event_id)) AS BIGINT) END AS position
FROM v_events WHERE event_type IN ('impression', 'skip') GROUP BY user_id, ai_news_id, event_type, CAST(created_at AS DATE)""")

register("stream_interactions", lambda t: shape(drain(jobs.stream_interactions(_live(t).v_interactions), "update", ["user_id", "ai_news_id"])), "v_interactions",
         f"SELECT user_id, ai_news_id, liked, viewed, CAST(watch_time AS BIGINT) AS watch_time, {ts('created_at')} AS created_at FROM merged", MERGED)


def _activity(t):
    events = _live(t).v_events
    keys = ["window_start", "window_end", "event_type"]
    parts = [drain(jobs.stream_activity(events, w, s), "update", keys).withColumn("span", F.lit(name))
             for name, w, s in (("10m", "10 minutes", None), ("1h", "1 hour", None), ("1h/10m", "1 hour", "10 minutes"))]
    return shape(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def _span(name: str, width: str, start: str, source: str = "v_events") -> str:
    return (f"SELECT {ts(start)} AS window_start, {ts(f'{start} + INTERVAL {width}')} AS window_end, event_type, count(*) AS n, '{name}' AS span "
            f"FROM {source} GROUP BY {start}, event_type")


register("stream_activity", _activity, "v_events", " UNION ALL ".join([
    _span("10m", "10 MINUTE", "time_bucket(INTERVAL 10 MINUTE, created_at)"), _span("1h", "1 HOUR", "date_trunc('hour', created_at)"),
    _span("1h/10m", "1 HOUR", "st", "(SELECT event_type, time_bucket(INTERVAL 10 MINUTE, created_at) - k * INTERVAL 10 MINUTE AS st FROM v_events, range(6) r(k))")]))

TOPICS = ("politics", "sports", "economy", "tech", "health", "culture", "general")
register("stream_sessions", lambda t: shape(drain(jobs.stream_sessions(_live(t).v_events, t.v_ai_news, TOPICS), "append")), "v_events v_ai_news", f"""
SELECT user_id, {ts('min(created_at)')} AS started_at, {ts('max(created_at) + INTERVAL 30 MINUTE')} AS ended_at, count(*) AS n, {', '.join(f"count(*) FILTER (category = '{x}') AS n_{x}" for x in TOPICS)}
FROM islands GROUP BY user_id, sid HAVING max(created_at) + INTERVAL 30 MINUTE <= (SELECT max(created_at) - INTERVAL 1 DAY FROM touched)""",
         """touched AS (SELECT e.*, a.category FROM v_events e JOIN v_ai_news a USING (ai_news_id) WHERE event_type IN ('view', 'long_view', 'like')),
islands AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY created_at, event_id) AS sid FROM (
  SELECT *, created_at - lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at, event_id) AS gap FROM touched))""")


def _profiles(t):
    # every micro-batch reads the articles' keys: made once
    keys = cut_lineage(profiles.article_counter_keys(t.v_ai_news, t.v_raw_news, text.keyword_arrays(t.v_ai_news, "ai_news_id", "final_text")))
    return drain(jobs.stream_profiles(profiles.counter_deltas(_live(t).v_interactions, keys)), "update", ["user_id", "kind", "key"])


register("stream_profiles", lambda t: shape(_profiles(t)), "v_interactions v_ai_news v_raw_news",
         f'SELECT user_id, kind, key, cnt AS count, {ts("last_seen")} AS last_seen FROM counters', ", ".join([HOSTS, KEYWORDS, COUNTERS]))


def _stale(t):
    log = _live(t).v_events.select(
        F.col("user_id").alias("item"), F.when(F.col("event_type") == "view", "processing").otherwise("done").alias("status"),
        F.date_trunc("millisecond", "created_at").alias("created_at"))
    return drain(jobs.stream_stale_jobs(log), "append")


register("stream_stale_jobs", lambda t: shape(_stale(t)), "v_events", f"""
SELECT user_id AS item, {ts('c')} AS started_at, {ts('c + INTERVAL 10 MINUTE')} AS stale_at FROM (
  SELECT *, lead(c) OVER (PARTITION BY user_id ORDER BY c, event_id) AS nxt, max(c) OVER () AS mx FROM (SELECT *, date_trunc('millisecond', created_at) AS c FROM v_events))
WHERE event_type = 'view' AND (nxt > c + INTERVAL 10 MINUTE OR (nxt IS NULL AND c + INTERVAL 10 MINUTE <= mx))""")

__all__ = ["QUERIES"]
