"""Queries over personas, audiences and the work queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import duck as D
from newsloom.catalog.base import register, shape, ts
from newsloom.catalog.events import NOW
from newsloom.catalog.texts import QUALITY, TENS, _quality_input
from newsloom.operators import matching, personas, text

TOPICS = "list_distinct(CAST(interests->'all_topics' AS VARCHAR[]))"
# list_distinct does not keep order in DuckDB, so topics are numbered
UT = """ut AS (SELECT user_id, topic, min(pos) AS pos FROM (SELECT user_id, lower(trim(unnest(l))) AS topic, generate_subscripts(l, 1) AS pos FROM (
  SELECT user_id, CAST(interests->'all_topics' AS VARCHAR[]) AS l FROM v_users)) WHERE topic <> '' GROUP BY 1, 2)"""
register("user_topics", lambda t: shape(t.v_users.select("user_id", personas.user_topics(F.col("interests")).alias("topics"))), "v_users",
         "SELECT user_id, string_agg(topic, '¦' ORDER BY pos) AS topics FROM ut GROUP BY 1", UT)

register("persona_cohort", lambda t: shape(personas.persona_cohort(t.v_users)), "v_users", """
SELECT label, topic, profession, geo, country_code FROM (SELECT label, min(user_id * 100 + pos) AS fst, arg_min(topic, user_id * 100 + pos) AS topic, any_value(profession) AS profession, any_value(geo) AS geo, any_value(cc) AS country_code FROM (
  SELECT u.user_id, pos, topic, lower(interests->>'profession') AS profession, lower(location) AS geo, upper(country_code) AS cc,
    topic || '|' || lower(interests->>'profession') || '|' || lower(location) || '|' || lower(country_code) AS label
  FROM v_users u JOIN ut USING (user_id) WHERE is_active) GROUP BY 1)""", UT)


def _targeted_articles(t):
    """Articles with personas of all lengths, some of a topic that no user lists."""
    n = F.col("ai_news_id")
    job = F.element_at(F.array(*[F.lit(j) for j in ("", "building", "machinery", "automobile", "furniture")]), (n % 5 + 1).cast("int"))
    geo = F.element_at(F.array(*[F.lit(g) for g in ("", "united", "ran", "china")]), (n % 4 + 1).cast("int"))
    country = F.when(n % 3 == 0, "UN").when(n % 11 == 0, "FR").otherwise("")
    topic = F.when(n % 13 == 0, "chess").when(n % 17 == 0, "port").otherwise(F.col("category"))
    label = F.concat_ws("|", topic, job, geo, country)
    return t.v_ai_news.select("ai_news_id", "ai_score", label.alias("target_persona"))


TARGETS = """tg AS (SELECT ai_news_id, ai_score, CASE WHEN ai_news_id % 13 = 0 THEN 'chess' WHEN ai_news_id % 17 = 0 THEN 'port' ELSE category END AS topic,
  ['', 'building', 'machinery', 'automobile', 'furniture'][ai_news_id % 5 + 1] AS prof, ['', 'united', 'ran', 'china'][ai_news_id % 4 + 1] AS geo,
  CASE WHEN ai_news_id % 3 = 0 THEN 'UN' WHEN ai_news_id % 11 = 0 THEN 'FR' ELSE '' END AS cc FROM v_ai_news),
us AS (SELECT user_id, CAST(interests->'all_topics' AS VARCHAR[]) AS topics, lower(interests) AS it, lower(interests->>'profession') AS prof, lower(location) AS loc, upper(country_code) AS cc FROM v_users WHERE is_active)"""
REST = "(t.prof = '' OR t.prof = u.prof) AND (t.geo = '' OR contains(u.loc, t.geo)) AND (t.cc = '' OR t.cc = u.cc)"
FAN = f"""{TARGETS}, f1 AS (SELECT u.user_id, t.ai_news_id, t.ai_score, 1 AS tier FROM tg t JOIN us u ON (t.topic = 'general' OR list_contains(u.topics, t.topic)) AND {REST}),
f2 AS (SELECT u.user_id, t.ai_news_id, t.ai_score, 2 AS tier FROM tg t JOIN us u ON contains(u.it, t.topic) AND {REST} WHERE t.ai_news_id NOT IN (SELECT ai_news_id FROM f1)),
f3 AS (SELECT u.user_id, t.ai_news_id, t.ai_score, 3 AS tier FROM tg t JOIN us u ON (t.prof <> '' AND t.prof = u.prof) OR (t.geo <> '' AND contains(u.loc, t.geo)) OR (t.cc <> '' AND t.cc = u.cc)
  WHERE t.ai_news_id NOT IN (SELECT ai_news_id FROM f1) AND t.ai_news_id NOT IN (SELECT ai_news_id FROM f2)),
fx AS (SELECT DISTINCT user_id, ai_news_id FROM v_saved)"""
register("feed_fanout", lambda t: shape(personas.feed_fanout(_targeted_articles(t), t.v_users, t.v_saved.select("user_id", "ai_news_id").distinct())),
         "v_users v_ai_news v_saved", """SELECT user_id, ai_news_id, ai_score, CAST(tier AS BIGINT) AS tier FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3) f
WHERE NOT EXISTS (SELECT 1 FROM fx WHERE fx.user_id = f.user_id AND fx.ai_news_id = f.ai_news_id)""", FAN)
register("audience_counts", lambda t: shape(personas.audience_counts(_targeted_articles(t), t.v_users, t.v_saved.select("user_id", "ai_news_id").distinct())),
         "v_users v_ai_news v_saved", f"""SELECT t.ai_news_id, count(*) AS active_users, count(*) FILTER (t.topic = 'general' OR list_contains(u.topics, t.topic)) AS topic_matches,
  count(*) FILTER (u.prof = t.prof) AS profession_matches, count(*) FILTER (contains(u.loc, t.geo)) AS geo_matches, count(*) FILTER (u.cc = t.cc) AS country_matches,
  count(*) FILTER ((t.topic = 'general' OR list_contains(u.topics, t.topic)) AND {REST} AND x.user_id IS NULL) AS combined_matches
FROM tg t CROSS JOIN us u LEFT JOIN (SELECT DISTINCT user_id, ai_news_id FROM v_saved) x ON x.user_id = u.user_id AND x.ai_news_id = t.ai_news_id GROUP BY 1""", TARGETS)

register("upsert_enriched",
         lambda t: (lambda a: shape(personas.upsert_enriched(a.where("ai_news_id % 2 = 1"), a.where("ai_news_id % 2 = 0"))))(
             t.v_ai_news.select("ai_news_id", "raw_news_id", "target_persona", "ai_score")),
         "v_ai_news", """SELECT ai_news_id, raw_news_id, target_persona, ai_score, ai_news_id % 2 = 1 AS inserted FROM (
  SELECT *, row_number() OVER (PARTITION BY raw_news_id, target_persona ORDER BY ai_news_id % 2, ai_news_id) AS rn FROM v_ai_news) WHERE rn = 1""")


def _drafts(t):
    scored = text.quality_score(_quality_input(t), "text", "text", "persona", "geo", "model")
    return scored.join(t.documents.select("doc_id", "source"), "doc_id").select(F.col("source").alias("item"), F.col("doc_id").alias("round"), "combined_score")


register("best_candidate", lambda t: shape(personas.best_candidate(_drafts(t))), "", """
SELECT item, coalesce(fg, br) AS round, coalesce(fs, bs) AS combined_score FROM (
  SELECT item, min(round) FILTER (s >= 8) AS fg, arg_min(s, round) FILTER (s >= 8) AS fs, max(s) AS bs, arg_min(round, (-s, round)) AS br FROM drafts GROUP BY 1) WHERE coalesce(fs, bs) >= 6""",
         f"{QUALITY}, drafts AS (SELECT d.source AS item, b.doc_id AS round, ({TENS.format('CAST(round(m * 100) AS BIGINT) * 4 + q * 6')}) / 100 AS s FROM bounded b JOIN documents d USING (doc_id))")

QUEUE = ("raw_news_id", "process_status", "attempt_count", "processing_started_at", "created_at")
register("claim_queue", lambda t: shape(personas.claim_queue(t.v_raw_news.select(*QUEUE), t.as_of)), "v_raw_news", f"""
SELECT raw_news_id, 'processing' AS process_status, CAST(coalesce(attempt_count, 0) + 1 AS BIGINT) AS attempt_count, {ts(NOW)} AS processing_started_at, {ts('created_at')} AS created_at FROM v_raw_news
WHERE process_status IS NULL OR process_status IN ('pending', 'new') OR (process_status = 'failed' AND coalesce(attempt_count, 0) < 3) ORDER BY v_raw_news.created_at DESC, raw_news_id DESC LIMIT 50""")
register("recover_stale", lambda t: shape(personas.recover_stale(t.v_raw_news.select(*QUEUE), t.as_of)), "v_raw_news", f"""
SELECT raw_news_id, CASE WHEN r THEN 'pending' ELSE process_status END AS process_status, CAST(CASE WHEN r THEN 0 ELSE attempt_count END AS BIGINT) AS attempt_count,
  {ts('CASE WHEN NOT r THEN processing_started_at END')} AS processing_started_at, {ts('created_at')} AS created_at, r AS recovered
FROM (SELECT *, coalesce(process_status = 'processing' AND coalesce(processing_started_at, created_at) < {NOW} - INTERVAL 10 MINUTE, FALSE) AS r FROM v_raw_news)""")


def _retention(i):
    def run(t):
        return shape(personas.apply_retention(t.v_raw_news.select("raw_news_id", "created_at"), t.v_ai_news.select("ai_news_id", "raw_news_id", "created_at"), t.as_of)[i])
    return run


register("apply_retention", _retention(1), "v_raw_news v_ai_news", f"""SELECT ai_news_id, raw_news_id, {ts('created_at')} AS created_at FROM v_ai_news
WHERE created_at >= {NOW} - INTERVAL 4 DAY AND raw_news_id IN (SELECT raw_news_id FROM v_raw_news WHERE created_at >= {NOW} - INTERVAL 4 DAY)""")
register("apply_retention_raw", _retention(0), "v_raw_news", f"SELECT raw_news_id, {ts('created_at')} AS created_at FROM v_raw_news WHERE v_raw_news.created_at >= {NOW} - INTERVAL 4 DAY")
register("apply_retention_counts", _retention(2), "v_raw_news v_ai_news", f"""SELECT (SELECT count(*) FROM v_raw_news WHERE created_at < {NOW} - INTERVAL 4 DAY) AS deleted_raw,
  (SELECT count(*) FROM v_ai_news WHERE created_at < {NOW} - INTERVAL 4 DAY) AS deleted_by_age""")


def _cache_plan(t):
    a = t.v_ai_news
    requests = t.v_interactions.select("ai_news_id", "user_id").distinct().join(
        t.v_users.select("user_id", F.col("interests").alias("profile_json")), "user_id", "left")
    base = a.where("ai_news_id % 2 = 0").select(
        "ai_news_id", personas.article_cache_key(F.col("ai_news_id"), F.col("final_title"), F.col("final_text")).alias("base_key"),
        F.col("created_at").alias("cached_at"), F.lower("final_title").alias("summary"), "category")
    profiles = t.v_users.select("user_id", personas.profile_cache_key(F.col("interests")).alias("profile_key"))
    served = t.v_saved.select("user_id", "ai_news_id").distinct().join(profiles, "user_id").join(
        a.where("ai_news_id % 2 = 1").select("ai_news_id", F.col("created_at").alias("cached_at")), "ai_news_id")
    return shape(personas.enrichment_cache_plan(requests, a, base, served, t.as_of))


register("enrichment_cache_plan", _cache_plan, "v_ai_news v_users v_interactions v_saved", f"""
SELECT r.ai_news_id, r.user_id, a.bk AS base_key, r.pk AS profile_key, CASE WHEN s.user_id IS NOT NULL THEN 'user_hit' WHEN b.ai_news_id IS NOT NULL THEN 'base_hit' ELSE 'miss' END AS plan,
  coalesce(b.summary, trim(substr(a.final_text, 1, 200)) || '...') AS summary, coalesce(b.category, 'other') AS category
FROM req r JOIN (SELECT *, md5(CAST(ai_news_id AS VARCHAR) || '|' || final_title || '|' || final_text) AS bk FROM v_ai_news) a USING (ai_news_id)
LEFT JOIN (SELECT ai_news_id, lower(final_title) AS summary, category FROM v_ai_news WHERE ai_news_id % 2 = 0 AND created_at > {NOW} - INTERVAL 48 HOUR) b ON b.ai_news_id = r.ai_news_id
LEFT JOIN (SELECT DISTINCT v.user_id, v.ai_news_id FROM v_saved v JOIN v_users u USING (user_id) JOIN v_ai_news n USING (ai_news_id) WHERE n.ai_news_id % 2 = 1 AND n.created_at > {NOW} - INTERVAL 12 HOUR) s
  ON s.user_id = r.user_id AND s.ai_news_id = r.ai_news_id""",
         "req AS (SELECT i.ai_news_id, i.user_id, coalesce(md5(u.interests), 'anon') AS pk FROM (SELECT DISTINCT ai_news_id, user_id FROM v_interactions) i LEFT JOIN v_users u USING (user_id))")

register("seed_new_user_feed", lambda t: shape(personas.seed_new_user_feed(t.v_users, t.v_ai_news, t.v_saved.select("user_id", "ai_news_id").distinct())),
         "v_users v_ai_news v_saved", """
SELECT user_id, ai_news_id, ai_score, rank, tier FROM (
  SELECT user_id, ai_news_id, ai_score, rank, CAST(1 AS BIGINT) AS tier FROM own
  UNION ALL SELECT u.user_id, g.ai_news_id, g.ai_score, g.rank, CAST(2 AS BIGINT) FROM v_users u CROSS JOIN gen g WHERE u.user_id NOT IN (SELECT user_id FROM own)) f
WHERE NOT EXISTS (SELECT 1 FROM v_saved s WHERE s.user_id = f.user_id AND s.ai_news_id = f.ai_news_id)""",
         f"""{UT}, lat AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, ai_news_id DESC) AS pos FROM (SELECT * FROM v_ai_news ORDER BY created_at DESC, ai_news_id DESC LIMIT 300)),
m1 AS (SELECT DISTINCT u.user_id, l.ai_news_id, l.ai_score, l.raw_news_id, l.pos FROM ut u JOIN lat l ON l.target_persona = u.topic OR starts_with(l.target_persona, u.topic || '|')),
m2 AS (SELECT *, row_number() OVER (PARTITION BY user_id, raw_news_id ORDER BY pos) AS rr FROM m1),
own AS (SELECT * FROM (SELECT user_id, ai_news_id, ai_score, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS rank FROM m2 WHERE rr = 1) WHERE rank <= 40),
gen AS (SELECT * FROM (SELECT ai_news_id, ai_score, row_number() OVER (ORDER BY pos) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY raw_news_id ORDER BY pos) AS rr FROM lat
  WHERE target_persona = 'general' OR starts_with(target_persona, 'general|')) WHERE rr = 1) WHERE rank <= 12)""")

# --- topic expansion and matching -------------------------------------------------------
ALIAS = "al AS (SELECT * FROM (VALUES " + ", ".join(
    f"({D.q(t)}, {D.q(v)}, {i})" for t, vs in matching.TOPIC_ALIASES.items() for i, v in enumerate(vs)) + ") x(topic, variant, p))"
EXPAND = f"""{UT}, {ALIAS},
vr AS (SELECT user_id, pos, variant, p FROM ut JOIN al USING (topic) WHERE topic <> 'general' UNION ALL SELECT user_id, pos, topic, 1000 FROM ut WHERE topic NOT IN ('cs', 'general')),
vd AS (SELECT user_id, variant, min((pos, p)) AS fst FROM vr WHERE len(variant) > 2 GROUP BY 1, 2)"""
register("expand_topics",
         lambda t: shape(matching.expand_topics(t.v_users.select("user_id", personas.user_topics(F.col("interests")).alias("topics")), matching.alias_table(t.spark))),
         "v_users", "SELECT user_id, string_agg(variant, '¦' ORDER BY fst) AS queries FROM vd GROUP BY 1", EXPAND)

QUERY_TOPICS = ("cs", "dota", "the", "general", "tion", "la", "gol", "ereè", "furniture")


def _topic_matches(t):
    docs = t.documents.select("doc_id", F.lower("text").alias("haystack"))
    topics = t.spark.createDataFrame([(x,) for x in QUERY_TOPICS if x != "general"], "topic string")
    variants = matching.topic_variants(topics, matching.alias_table(t.spark))
    return matching.match_articles_topics(docs, variants, "doc_id", "haystack")


_VARIANTS = sorted({(x, v) for x in QUERY_TOPICS if x != "general" for v in [*matching.TOPIC_ALIASES.get(x, ()), *([] if x == "cs" else [x])]})
register("match_articles_topics", lambda t: shape(_topic_matches(t)), "", """
SELECT DISTINCT doc_id, topic FROM documents JOIN v ON CASE WHEN len(variant) <= 2 THEN regexp_matches(lower(text), '(^|[^a-z0-9])' || variant || '($|[^a-z0-9])') ELSE contains(lower(text), variant) END""",
         "v AS (SELECT * FROM (VALUES " + ", ".join(f"({D.q(a)}, {D.q(b)})" for a, b in _VARIANTS) + ") x(topic, variant))")
