"""Queries over interaction and event logs, deduplication and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import duck as D
from newsloom.catalog.base import register, shape, ts
from newsloom.fixtures import AS_OF
from newsloom.operators import dedup, metrics, profiles, text

NOW = f"TIMESTAMP '{AS_OF}'"

# --- shared oracle fragments ---------------------------------------------------
MERGED = """merged AS (
  SELECT user_id, ai_news_id,
    arg_max(liked, seq) FILTER (liked IS NOT NULL) AS liked,
    arg_max(CASE WHEN liked IS NOT NULL THEN coalesce(viewed, watch_time IS NOT NULL) ELSE TRUE END, seq) AS viewed,
    arg_max(watch_time, seq) FILTER (watch_time IS NOT NULL) AS watch_time,
    arg_max(created_at, seq) AS created_at
  FROM v_interactions WHERE liked IS NOT NULL OR coalesce(viewed, FALSE) OR coalesce(watch_time, 0) > 0
  GROUP BY user_id, ai_news_id)"""
SAVED = """saved_now AS (
  SELECT user_id, ai_news_id, arg_max(created_at, seq) AS saved_at, max(seq) AS seq FROM v_saved
  GROUP BY user_id, ai_news_id HAVING count(*) % 2 = 1)"""

register("merge_interactions", lambda t: shape(profiles.merge_interactions(t.v_interactions)), "v_interactions",
         f"SELECT user_id, ai_news_id, liked, viewed, CAST(watch_time AS BIGINT) AS watch_time, {ts('created_at')} AS created_at FROM merged",
         MERGED)

register("user_item_state",
         lambda t: shape(profiles.user_item_state(t.v_interactions, profiles.saved_state(t.v_saved), t.v_comments)),
         "v_interactions v_saved v_comments", """
SELECT user_id, ai_news_id, like_state, viewed, watch_time, saved, coalesce(n, 0) AS comment_count,
  like_state > 0 AS liked, like_state < 0 AND NOT viewed AS skipped, like_state < 0 AS disliked
FROM (
  SELECT coalesce(i.user_id, s.user_id) AS user_id, coalesce(i.ai_news_id, s.ai_news_id) AS ai_news_id,
    coalesce(i.like_state, 0) AS like_state, coalesce(i.viewed, FALSE) AS viewed, coalesce(i.watch_time, 0) AS watch_time,
    s.user_id IS NOT NULL AS saved
  FROM (SELECT user_id, ai_news_id,
          CAST(max(CASE WHEN liked IS TRUE THEN 1 WHEN liked IS FALSE THEN -1 ELSE 0 END) AS BIGINT) AS like_state,
          bool_or(coalesce(viewed, FALSE)) AS viewed, CAST(max(coalesce(watch_time, 0)) AS BIGINT) AS watch_time
        FROM v_interactions GROUP BY 1, 2) i
  FULL JOIN saved_now s ON s.user_id = i.user_id AND s.ai_news_id = i.ai_news_id) k
LEFT JOIN (SELECT ai_news_id AS a, count(*) AS n FROM v_comments GROUP BY 1) c ON c.a = k.ai_news_id""", SAVED)

register("seen_items", lambda t: shape(profiles.seen_items(t.v_interactions, t.as_of)), "v_interactions",
         f"SELECT DISTINCT user_id, ai_news_id FROM v_interactions WHERE viewed AND created_at >= {NOW} - INTERVAL 30 DAY")

register("cold_start_users", lambda t: shape(profiles.cold_start_users(t.v_users, t.v_interactions, t.as_of)),
         "v_users v_interactions", f"""
SELECT u.user_id, count(i.seq) AS interaction_count FROM v_users u
LEFT JOIN v_interactions i ON i.user_id = u.user_id AND i.created_at >= {NOW} - INTERVAL 30 DAY
GROUP BY u.user_id HAVING count(i.seq) < 5""")

register("valid_events", lambda t: shape(profiles.valid_events(t.v_events)), "v_events", f"""
SELECT event_id, user_id, ai_news_id, event_type, coalesce(dwell_time, 0) AS dwell_time, CAST(position AS BIGINT) AS position,
  {ts('created_at')} AS created_at FROM v_events WHERE event_type IN {D.lst(profiles.VALID_EVENTS)}""")
register("valid_events_rejects", lambda t: shape(profiles.event_rejects(t.v_events)), "v_events", f"""
SELECT count(*) FILTER (event_type IN {D.lst(profiles.VALID_EVENTS)}) AS accepted,
  count(*) FILTER (event_type NOT IN {D.lst(profiles.VALID_EVENTS)}) AS rejected FROM v_events""")

PREFERENCES = """prefs AS (
  SELECT e.user_id, lower(trim(coalesce(nullif(a.category, ''), 'general'))) AS category,
    sum(CASE e.event_type WHEN 'view' THEN 1.0::DOUBLE WHEN 'like' THEN 3.0 WHEN 'skip' THEN -2.0 WHEN 'long_view' THEN 2.0 ELSE 0.0 END
        + CASE WHEN coalesce(e.dwell_time, 0) > 10 THEN 2.0::DOUBLE ELSE 0.0 END) AS preference
  FROM v_events e LEFT JOIN v_ai_news a ON a.ai_news_id = e.ai_news_id GROUP BY 1, 2)"""
register("category_preferences", lambda t: shape(profiles.category_preferences(t.v_events, t.v_ai_news)), "v_events v_ai_news",
         "SELECT * FROM prefs", PREFERENCES)

HOSTS = f"""hosts AS (
  SELECT a.ai_news_id, lower(trim(coalesce(a.category, ''))) AS category, {D.hostname("lower(trim(coalesce(r.source_url, '')))")} AS host
  FROM v_ai_news a LEFT JOIN v_raw_news r ON r.raw_news_id = a.raw_news_id)"""
LIKED = f"""liked AS (SELECT user_id, ai_news_id, created_at FROM merged WHERE liked AND created_at >= {NOW} - INTERVAL 90 DAY)"""
PROFILE = f"""profile AS (
  SELECT user_id, kind, key, count(*) AS cnt, max(created_at) AS last_seen FROM (
    SELECT l.user_id, 'topic' AS kind, h.category AS key, l.created_at FROM liked l JOIN hosts h USING (ai_news_id) WHERE h.category <> ''
    UNION ALL
    SELECT l.user_id, 'source', h.host, l.created_at FROM liked l JOIN hosts h USING (ai_news_id) WHERE h.host <> ''
    UNION ALL
    SELECT l.user_id, 'keyword', k.w, l.created_at FROM liked l JOIN (
      SELECT DISTINCT ai_news_id, w FROM (SELECT ai_news_id, unnest({D.keyword_words('final_text')}) AS w FROM v_ai_news
        WHERE ai_news_id IN (SELECT ai_news_id FROM liked))) k USING (ai_news_id))
  GROUP BY 1, 2, 3)"""
register("profile_from_likes",
         lambda t: shape(profiles.profile_from_likes(profiles.merge_interactions(t.v_interactions), t.v_ai_news, t.v_raw_news, t.as_of)),
         "v_interactions v_ai_news v_raw_news",
         f'SELECT user_id, kind, key, cnt AS count, {ts("last_seen")} AS last_seen FROM profile',
         ", ".join([MERGED, HOSTS, LIKED, PROFILE]))

KEYWORDS = f"""kw_pos AS (
  SELECT ai_news_id, unnest({D.keyword_words('final_text')}) AS keyword, generate_subscripts({D.keyword_words('final_text')}, 1) AS pos FROM v_ai_news),
kw AS (
  SELECT ai_news_id, keyword, cnt, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY ai_news_id ORDER BY cnt DESC, first_pos) AS rank FROM (
      SELECT ai_news_id, keyword, count(*) AS cnt, min(pos) AS first_pos FROM kw_pos GROUP BY 1, 2)) WHERE rank <= 6)"""
COUNTERS = """moves AS (
  SELECT user_id, ai_news_id, seq, created_at, CASE WHEN liked THEN 2 WHEN NOT liked THEN -1 WHEN coalesce(viewed, FALSE) OR coalesce(watch_time, 0) > 0 THEN 1 END AS delta
  FROM v_interactions),
keyed AS (
  SELECT m.*, k.kind, k.key FROM moves m JOIN (
    SELECT ai_news_id, 'topic' AS kind, category AS key FROM hosts UNION ALL SELECT ai_news_id, 'source', host FROM hosts
    UNION ALL SELECT ai_news_id, 'keyword', lower(trim(keyword)) FROM kw) k USING (ai_news_id) WHERE m.delta IS NOT NULL AND k.key <> ''),
walk AS (SELECT *, sum(delta) OVER (PARTITION BY user_id, kind, key ORDER BY seq) AS s FROM keyed),
counters AS (
  SELECT user_id, kind, key, CAST(arg_max(s, seq) - least(0, min(s)) AS BIGINT) AS cnt, max(created_at) AS last_seen FROM walk GROUP BY 1, 2, 3)"""


def _deltas(t):
    articles = t.v_ai_news
    keys = profiles.article_counter_keys(articles, t.v_raw_news, text.keyword_arrays(articles, "ai_news_id", "final_text"))
    return profiles.counter_deltas(t.v_interactions, keys)


register("profile_counters", lambda t: shape(profiles.profile_counters(_deltas(t))), "v_interactions v_ai_news v_raw_news",
         f'SELECT user_id, kind, key, cnt AS count, {ts("last_seen")} AS last_seen FROM counters',
         ", ".join([HOSTS, KEYWORDS, COUNTERS]))

register("saved_state", lambda t: shape(profiles.saved_state(t.v_saved)), "v_saved",
         f"SELECT user_id, ai_news_id, {ts('saved_at')} AS saved_at, seq FROM saved_now", SAVED)

register("comment_tree", lambda t: shape(profiles.comment_tree(t.v_comments)), "v_comments", f"""
SELECT l.comment_id, l.ai_news_id, l.user_id, l.parent_id, l.content, {ts('l.created_at')} AS created_at, CAST(w.depth AS BIGINT) AS depth, w.path, w.root_id,
  coalesce(n.n, 0) AS reply_count,
  row_number() OVER (PARTITION BY l.ai_news_id, l.parent_id ORDER BY l.created_at, l.comment_id) AS sibling_pos
FROM linked l JOIN walk w USING (comment_id)
LEFT JOIN (SELECT parent_id AS p, count(*) AS n FROM linked WHERE parent_id IS NOT NULL GROUP BY 1) n ON n.p = l.comment_id""",
         """linked AS (
  SELECT c.comment_id, c.ai_news_id, c.user_id, c.content, c.created_at, p.comment_id AS parent_id
  FROM v_comments c LEFT JOIN v_comments p ON p.comment_id = c.parent_comment_id AND p.ai_news_id = c.ai_news_id),
walk AS (/* RECURSIVE */
  SELECT comment_id, 0 AS depth, CAST(comment_id AS VARCHAR) AS path, comment_id AS root_id FROM linked WHERE parent_id IS NULL
  UNION ALL
  SELECT l.comment_id, w.depth + 1, w.path || '/' || CAST(l.comment_id AS VARCHAR), w.root_id FROM linked l JOIN walk w ON l.parent_id = w.comment_id)""")

register("daily_impressions", lambda t: shape(profiles.daily_impressions(t.v_events)), "v_events", f"""
SELECT user_id, ai_news_id, event_type, strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS day, {ts('min(created_at)')} AS first_at,
  CASE WHEN event_type = 'impression' THEN CAST(arg_max(position, (created_at, event_id)) AS BIGINT) END AS position
FROM v_events WHERE event_type IN ('impression', 'skip') GROUP BY user_id, ai_news_id, event_type, CAST(created_at AS DATE)""")


def _engagement_events(t):
    saves = t.v_saved.select(
        F.col("seq").alias("event_id"), "user_id", "ai_news_id", F.lit("save").alias("event_type"),
        F.lit(None).cast("double").alias("dwell_time"), F.lit(None).cast("int").alias("position"), "created_at",
    )
    return t.v_events.unionByName(saves)


register("engagement_flags", lambda t: shape(profiles.engagement_flags(_engagement_events(t))), "v_events v_saved", f"""
SELECT user_id, ai_news_id, bool_or(k IN ('view', 'long_view')) AS viewed, bool_or(k = 'like') AS liked, bool_or(k = 'save') AS saved,
  arg_max(dwell_time, id) FILTER (k IN ('view', 'long_view') AND dwell_time IS NOT NULL) AS dwell_time, {ts('arg_min(created_at, id)')} AS created_at
FROM (SELECT event_id AS id, user_id, ai_news_id, event_type AS k, dwell_time, created_at FROM v_events
      UNION ALL SELECT seq, user_id, ai_news_id, 'save', NULL, created_at FROM v_saved)
WHERE k IN ('view', 'long_view', 'like', 'save') GROUP BY user_id, ai_news_id""")


def _signal_weight(t):
    merged = profiles.merge_interactions(t.v_interactions)
    saved = profiles.saved_state(t.v_saved).select("user_id", "ai_news_id", F.lit(True).alias("saved"))
    joined = merged.join(saved, ["user_id", "ai_news_id"], "left")
    weight = profiles.signal_weight(F.col("liked"), F.col("viewed"), F.col("saved"), F.col("watch_time"))
    return shape(joined.select("user_id", "ai_news_id", weight.alias("weight")), weight=6)


register("signal_weight", _signal_weight, "v_interactions v_saved", """
SELECT m.user_id, m.ai_news_id, round(CASE WHEN viewed THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN liked THEN 2.25::DOUBLE WHEN NOT liked THEN -1.2::DOUBLE ELSE 0 END
  + CASE WHEN s.user_id IS NOT NULL THEN 1.4::DOUBLE ELSE 0 END + CASE WHEN watch_time > 0 THEN least(watch_time / 240.0::DOUBLE, 0.5::DOUBLE) ELSE 0 END, 6) AS weight
FROM merged m LEFT JOIN saved_now s ON s.user_id = m.user_id AND s.ai_news_id = m.ai_news_id""", f"{MERGED}, {SAVED}")

# --- metrics ---------------------------------------------------------------------
METRIC_HOURS = 48
register("recommendation_metrics",
         lambda t: shape(metrics.recommendation_metrics(t.v_feature_log, t.v_interactions, t.v_saved, t.as_of, METRIC_HOURS)),
         "v_feature_log v_interactions v_saved", f"""
SELECT CAST({METRIC_HOURS} AS BIGINT) AS timeframe_hours, n AS impressions, v AS viewed_clicks, round(v / greatest(n, 1), 4) AS ctr,
  round(coalesce((SELECT avg(watch_time) FROM v_interactions WHERE created_at >= {NOW} - INTERVAL {METRIC_HOURS} HOUR AND watch_time > 0), 0), 2) AS avg_time_spent_seconds,
  p AS positive_engagements, round(p / greatest(n, 1), 4) AS recommendation_accuracy
FROM (SELECT count(*) AS n, count(*) FILTER (seen) AS v, count(*) FILTER (good) AS p FROM (
  SELECT EXISTS (SELECT 1 FROM v_interactions i WHERE i.user_id = f.user_id AND i.ai_news_id = f.ai_news_id AND i.created_at >= f.created_at AND coalesce(i.viewed, FALSE)) AS seen,
    EXISTS (SELECT 1 FROM v_interactions i WHERE i.user_id = f.user_id AND i.ai_news_id = f.ai_news_id AND i.created_at >= f.created_at AND coalesce(i.liked, FALSE))
    OR EXISTS (SELECT 1 FROM v_saved s WHERE s.user_id = f.user_id AND s.ai_news_id = f.ai_news_id AND s.created_at >= f.created_at) AS good
  FROM v_feature_log f WHERE f.created_at >= {NOW} - INTERVAL {METRIC_HOURS} HOUR))""")

register("processing_metrics", lambda t: shape(metrics.processing_metrics(t.v_raw_news, t.v_ai_news, t.as_of, METRIC_HOURS)),
         "v_raw_news v_ai_news", f"""
SELECT CAST({METRIC_HOURS} AS BIGINT) AS timeframe_hours, count(*) AS total_raw_news, count(*) FILTER (process_status IN ('generated', 'completed')) AS completed_jobs,
  count(*) FILTER (process_status = 'failed') AS failed_jobs, count(*) FILTER (process_status IN ('pending', 'classified', 'processing')) AS pending_jobs,
  CAST(coalesce(sum(CASE WHEN attempt_count > 1 THEN attempt_count - 1 ELSE 0 END), 0) AS BIGINT) AS retry_count,
  round(coalesce(avg(coalesce(attempt_count, 0)), 0), 2) AS avg_attempt_count,
  round(coalesce(avg(epoch(f) - epoch(created_at)) FILTER (process_status IN ('generated', 'completed') AND f >= created_at), 0), 2) AS avg_processing_latency_seconds
FROM v_raw_news r LEFT JOIN (SELECT raw_news_id AS rid, min(created_at) AS f FROM v_ai_news GROUP BY 1) a ON a.rid = r.raw_news_id
WHERE created_at >= {NOW} - INTERVAL {METRIC_HOURS} HOUR""")

register("health_flags", lambda t: shape(metrics.health_flags(t.v_raw_news, t.as_of)), "v_raw_news", f"""
SELECT p AS processed, f AS failed, round(r, 2) AS failure_rate, s AS stalled_seconds, r < 0.3 AS failure_ok, s < 600 AS activity_ok,
  CASE WHEN r < 0.3 AND s < 600 THEN 'healthy' WHEN r < 0.3 OR s < 600 THEN 'degraded' ELSE 'unhealthy' END AS status
FROM (SELECT p, f, CASE WHEN p + f > 0 THEN f / (p + f) ELSE 0.0::DOUBLE END AS r, CAST(epoch({NOW}) - epoch(a) AS BIGINT) AS s
  FROM (SELECT count(*) FILTER (process_status IN ('generated', 'completed')) AS p, count(*) FILTER (process_status = 'failed') AS f,
    max(coalesce(processing_started_at, created_at)) AS a FROM v_raw_news))""")

register("source_heartbeat", lambda t: shape(metrics.source_heartbeat(t.v_raw_news, t.as_of)), "v_raw_news", f"""
SELECT source, {ts('l')} AS last_run, age AS age_seconds, CASE WHEN age <= 1800 THEN 'healthy' WHEN age <= 2700 THEN 'degraded' ELSE 'unhealthy' END AS status
FROM (SELECT source, l, CAST(epoch({NOW}) - epoch(l) AS BIGINT) AS age FROM (
  SELECT {D.hostname('source_url')} AS source, max(created_at) AS l FROM v_raw_news GROUP BY 1))""")

register("recent_counts", lambda t: shape(metrics.recent_counts(t.v_events, F.lit("2024-01-30 00:00:00").cast("timestamp"))), "v_events", """
SELECT count(*) FILTER (created_at >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 10 MINUTE) AS last_10m,
  count(*) FILTER (created_at >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 15 MINUTE) AS last_15m,
  count(*) FILTER (created_at >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 60 MINUTE) AS last_1h FROM v_events""")


def _run_results(t):
    made = t.v_ai_news.groupBy("raw_news_id").agg(F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("process_status").isin("generated", "completed"), "processed").otherwise(F.col("process_status"))
    joined = t.v_raw_news.select("raw_news_id", status.alias("status")).join(made, "raw_news_id", "left")
    return joined.select("status", F.when(F.col("status") == "processed", F.coalesce("n", F.lit(0))).otherwise(0).alias("created"))


register("run_summary", lambda t: shape(metrics.run_summary(_run_results(t))), "v_raw_news v_ai_news", """
SELECT count(*) AS fetched, count(*) FILTER (ok) AS processed, count(*) FILTER (process_status = 'failed') AS failed,
  count(*) - count(*) FILTER (ok) - count(*) FILTER (process_status = 'failed') AS skipped, CAST(coalesce(sum(CASE WHEN ok THEN coalesce(n, 0) ELSE 0 END), 0) AS BIGINT) AS created
FROM (SELECT process_status, coalesce(process_status IN ('generated', 'completed'), FALSE) AS ok, n FROM v_raw_news r
  LEFT JOIN (SELECT raw_news_id AS rid, count(*) AS n FROM v_ai_news GROUP BY 1) a ON a.rid = r.raw_news_id)""")

# --- identity and deduplication ------------------------------------------------------


def _two_deliveries(t):
    """Every raw row delivered twice; in the second delivery some rows lost their URL."""
    first = t.v_raw_news.select("raw_news_id", "title", "source_url").withColumn("seq", F.col("raw_news_id"))
    again = first.withColumn("seq", F.col("seq") + 1_000_000_000).withColumn(
        "source_url", F.when(F.col("raw_news_id") % 5 == 0, F.lit("  ")).otherwise(F.col("source_url"))
    )
    return first.unionByName(again)


DELIVERIES = """deliveries AS (
  SELECT raw_news_id, title, source_url, raw_news_id AS seq FROM v_raw_news UNION ALL
  SELECT raw_news_id, title, CASE WHEN raw_news_id % 5 = 0 THEN '  ' ELSE source_url END, raw_news_id + 1000000000 FROM v_raw_news)"""
register("dedupe_first_by_url", lambda t: shape(dedup.dedupe_first_by_url(_two_deliveries(t), "seq")), "v_raw_news", """
SELECT raw_news_id, title, u AS source_url, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY u ORDER BY seq) AS rn FROM (SELECT *, trim(source_url) AS u FROM deliveries) WHERE u <> '') WHERE rn = 1""", DELIVERIES)
register("dedupe_first_by_url_stats", lambda t: shape(dedup.dedupe_first_by_url_stats(_two_deliveries(t))), "v_raw_news", """
SELECT count(*) AS total, count(*) FILTER (trim(source_url) = '') AS skipped_no_url, count(DISTINCT nullif(trim(source_url), '')) AS kept,
  count(*) - count(*) FILTER (trim(source_url) = '') - count(DISTINCT nullif(trim(source_url), '')) AS repeated FROM deliveries""", DELIVERIES)

register("dedupe_url_or_title",
         lambda t: shape(dedup.dedupe_url_or_title(
             t.v_ai_news.select("ai_news_id", "final_title", F.when(F.col("ai_news_id") % 2 == 0, F.col("source_url")).alias("source_url")), "ai_news_id")),
         "v_ai_news", """
SELECT ai_news_id, final_title, source_url FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ai_news_id) AS rn FROM (
  SELECT ai_news_id, final_title, source_url, coalesce(nullif(lower(trim(source_url)), ''), nullif(lower(trim(final_title)), '')) AS k
  FROM (SELECT ai_news_id, final_title, CASE WHEN ai_news_id % 2 = 0 THEN source_url END AS source_url FROM v_ai_news)) WHERE k IS NOT NULL) WHERE rn = 1""")


def _mixed_articles(t):
    raw = t.v_raw_news.select(F.col("raw_news_id").alias("seq"), "source_url", "title", F.col("html").alias("content"))
    docs = t.documents.select(
        (F.col("doc_id") + 1_000_000_000).alias("seq"), F.lit(None).cast("string").alias("source_url"),
        F.substring("text", 1, 60).alias("title"), F.col("text").alias("content"),
    )
    return raw.unionByName(docs)


register("dedupe_url_else_hash",
         lambda t: shape(dedup.dedupe_url_else_hash(_mixed_articles(t), "seq", "source_url", "title", "content").select("seq", "source_url", "title")),
         "v_raw_news", f"""
SELECT seq, source_url, title FROM (SELECT *, row_number() OVER (PARTITION BY coalesce('u:' || {D.normalize_source_url('source_url')},
    'h:' || md5(lower(trim(coalesce(title, '')) || coalesce(content, '')))) ORDER BY seq) AS rn FROM (
  SELECT raw_news_id AS seq, source_url, title, html AS content FROM v_raw_news UNION ALL
  SELECT doc_id + 1000000000, NULL, substr(text, 1, 60), text FROM documents)) WHERE rn = 1""")

register("content_hashes",
         lambda t: shape(dedup.content_hashes(t.v_ai_news, "final_title", "final_text", "source_url").select("ai_news_id", "content_hash", "near_hash")),
         "v_ai_news", """
SELECT ai_news_id, sha256(trim(final_title) || '|' || trim(final_text) || '|' || trim(source_url)) AS content_hash,
  md5(lower(trim(final_title) || final_text)) AS near_hash FROM v_ai_news""")


def _batches(t):
    docs = t.documents.select("doc_id", "source", F.substring("text", 1, 60).alias("title"), "text")
    is_global = F.col("source").isin("src0", "src1", "src2", "src3", "src4", "src5", "src6", "src7")
    return [docs.where(is_global), docs.where(~is_global)]


BATCHED = """batched AS (
  SELECT doc_id, source, substr(text, 1, 60) AS title, CASE WHEN source IN ('src0','src1','src2','src3','src4','src5','src6','src7') THEN 0 ELSE 1 END AS batch,
    md5(lower(trim(substr(text, 1, 60)) || text)) AS near_hash FROM documents)"""
register("dedupe_content_hash",
         lambda t: shape(dedup.dedupe_content_hash(_batches(t), "doc_id", "title", "text")[0].select("doc_id", "source", "batch", "near_hash")),
         "", "SELECT doc_id, source, CAST(batch AS BIGINT) AS batch, near_hash FROM (SELECT *, row_number() OVER (PARTITION BY near_hash ORDER BY batch, doc_id) AS rn FROM batched) WHERE rn = 1", BATCHED)
register("dedupe_content_hash_stats", lambda t: shape(dedup.dedupe_content_hash(_batches(t), "doc_id", "title", "text")[1]),
         "", "SELECT count(*) AS total_before, count(DISTINCT near_hash) AS total_after FROM batched", BATCHED)


def _colliding(t):
    """Raw rows under one address per path number, so that addresses repeat."""
    address = F.concat(F.lit("https://site.example.org/"), (F.col("raw_news_id") % 40).cast("string"))
    raw = t.v_raw_news.select("raw_news_id", address.alias("source_url"), "created_at")
    return raw, t.v_ai_news.select("ai_news_id", "raw_news_id", "target_persona", "created_at")


COMPACT = """raw AS (SELECT raw_news_id, concat('https://site.example.org/', CAST(raw_news_id % 40 AS VARCHAR)) AS source_url, created_at FROM v_raw_news),
kept AS (SELECT raw_news_id, source_url, first_value(raw_news_id) OVER (PARTITION BY source_url ORDER BY created_at DESC, raw_news_id DESC) AS keep_id,
  count(*) OVER (PARTITION BY source_url) AS n FROM raw),
enriched AS (
  SELECT e.ai_news_id, coalesce(k.keep_id, e.raw_news_id) AS raw_news_id, e.target_persona, e.created_at, k.keep_id,
    row_number() OVER (PARTITION BY k.keep_id, e.target_persona ORDER BY e.created_at DESC, e.ai_news_id DESC) AS rn
  FROM v_ai_news e LEFT JOIN kept k ON k.raw_news_id = e.raw_news_id AND k.n > 1)"""
register("compact_duplicates", lambda t: shape(dedup.compact_duplicates(*_colliding(t))[1]), "v_raw_news v_ai_news",
         f"SELECT ai_news_id, raw_news_id, target_persona, {ts('created_at')} AS created_at FROM enriched WHERE keep_id IS NULL OR rn = 1", COMPACT)
register("compact_duplicates_raw", lambda t: shape(dedup.compact_duplicates(*_colliding(t))[0]), "v_raw_news v_ai_news",
         f"SELECT raw_news_id, source_url, {ts('created_at')} AS created_at FROM raw WHERE raw_news_id IN (SELECT keep_id FROM kept)", COMPACT)

register("latest_interaction", lambda t: shape(dedup.latest_interaction(t.v_interactions)), "v_interactions", f"""
SELECT seq, user_id, ai_news_id, liked, viewed, CAST(watch_time AS BIGINT) AS watch_time, {ts('created_at')} AS created_at FROM v_interactions
WHERE seq IN (SELECT max(seq) FROM v_interactions GROUP BY user_id, ai_news_id)""")

register("duplicate_report", lambda t: shape(dedup.duplicate_report(_colliding(t)[0], "source_url")), "v_raw_news",
         "SELECT source_url, count(*) AS cnt FROM (SELECT concat('https://site.example.org/', CAST(raw_news_id % 40 AS VARCHAR)) AS source_url FROM v_raw_news) GROUP BY 1 HAVING count(*) > 1")

register("unique_image_hash",
         lambda t: shape(dedup.unique_image_hash(
             t.v_images.withColumn("image_hash", F.when(F.col("pos") < 3, dedup.image_md5(F.col("url")))), [F.col("ai_news_id"), F.col("pos")])),
         "v_images", """
SELECT ai_news_id, pos, url, h AS image_hash FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY ai_news_id, pos) AS rn FROM (
  SELECT *, CASE WHEN pos < 3 THEN md5(lower(trim(url))) END AS h FROM v_images)) WHERE h IS NULL OR rn = 1""")
