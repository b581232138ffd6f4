"""Queries over candidates, ranking, feed assembly and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import duck as D
from newsloom.catalog.base import register, shape, ts
from newsloom.catalog.events import HOSTS, LIKED, MERGED, NOW, PREFERENCES, PROFILE, SAVED
from newsloom.catalog.texts import DIM, NEWS_TEXT, USER_TEXT, embedding_ctes
from newsloom.operators import dedup, feed, metrics, personas, profiles, text, vectors
from newsloom.plans import user_feed as plan

LIMIT = 20
VIEWS = "v_users v_ai_news v_raw_news v_interactions v_saved v_comments"


def _tables(t):
    return t.v_users, t.v_ai_news, t.v_raw_news, t.v_interactions, t.v_saved, t.v_comments, t.as_of


def _rows(t):
    return plan.candidate_rows(*_tables(t), limit=LIMIT)[0]


def _ranked(t):
    return plan.ranked_feed(*_tables(t), limit=LIMIT)


def _shortlist(t):
    return feed.shortlist(plan.slim_ranked(*_tables(t), limit=LIMIT)[0], LIMIT)


def _seen(t):
    return profiles.seen_items(profiles.merge_interactions(t.v_interactions), t.as_of)


# --- oracle chain -------------------------------------------------------------------
CANDS = f"""cands AS (
  SELECT *, row_number() OVER (ORDER BY ai_score DESC, created_at DESC, ai_news_id) AS candidate_pos FROM (
    SELECT a.ai_news_id, a.raw_news_id, lower(category) AS category, lower(trim(region)) AS region, lower(trim(language)) AS language, target_persona,
      ai_score, a.created_at, r.source_url, json_extract_string(image_urls, '$[0]') AS image_url, final_title, final_text, len(trim(final_text)) AS text_len
    FROM v_ai_news a LEFT JOIN v_raw_news r USING (raw_news_id)
    WHERE a.created_at >= {NOW} - INTERVAL 48 HOUR AND len(trim(final_title)) > 0 AND len(trim(final_text)) > 0
    ORDER BY ai_score DESC, a.created_at DESC, a.ai_news_id LIMIT 250))"""
STATE = """ist AS (SELECT user_id, ai_news_id, max(CASE WHEN liked IS TRUE THEN 1 WHEN liked IS FALSE THEN -1 ELSE 0 END) AS ls,
    bool_or(coalesce(viewed, FALSE)) AS vw, max(coalesce(watch_time, 0)) AS wt FROM merged GROUP BY 1, 2),
ncom AS (SELECT ai_news_id, count(*) AS n FROM v_comments GROUP BY 1)"""


def _decay(c: str, seen: str) -> str:
    return f"{c} * pow(0.95::DOUBLE, greatest(0.0::DOUBLE, epoch_us({NOW} - {seen}) / 3.6e9::DOUBLE))"


UCAND = f"""ovl AS (
  SELECT p.user_id, c.ai_news_id, sum({_decay('p.cnt', 'p.last_seen')}) AS overlap FROM profile p JOIN (
    SELECT DISTINCT ai_news_id, w FROM (SELECT ai_news_id, unnest({D.keyword_words('final_text')}) AS w FROM cands)) c ON p.kind = 'keyword' AND p.key = c.w GROUP BY 1, 2),
nint AS (SELECT user_id, count(*) AS n FROM merged WHERE created_at >= {NOW} - INTERVAL 30 DAY GROUP BY 1),
seen AS (SELECT DISTINCT user_id, ai_news_id FROM merged WHERE viewed AND created_at >= {NOW} - INTERVAL 30 DAY),
ucand AS (
  SELECT u.user_id, c.*, coalesce(n.n, 0) < 5 AS cold_start, coalesce(i.ls > 0, FALSE) AS liked, coalesce(i.vw, FALSE) AS viewed,
    s.user_id IS NOT NULL AS saved, coalesce(i.ls < 0 AND NOT i.vw, FALSE) AS skipped, coalesce(i.ls < 0, FALSE) AS disliked, coalesce(i.wt, 0) AS watch_time,
    CASE WHEN i.user_id IS NULL AND s.user_id IS NULL THEN 0 ELSE coalesce(nc.n, 0) END AS comment_count,
    {_decay('pt.cnt', 'pt.last_seen')} AS topic_weight, {_decay('ps.cnt', 'ps.last_seen')} AS source_weight, o.overlap, sn.user_id IS NOT NULL AS seen
  FROM v_users u CROSS JOIN cands c
  LEFT JOIN nint n ON n.user_id = u.user_id
  LEFT JOIN ist i ON i.user_id = u.user_id AND i.ai_news_id = c.ai_news_id
  LEFT JOIN saved_now s ON s.user_id = u.user_id AND s.ai_news_id = c.ai_news_id
  LEFT JOIN ncom nc ON nc.ai_news_id = c.ai_news_id
  LEFT JOIN profile pt ON pt.user_id = u.user_id AND pt.kind = 'topic' AND pt.key = trim(c.category)
  LEFT JOIN profile ps ON ps.user_id = u.user_id AND ps.kind = 'source' AND ps.key = ({D.hostname("lower(trim(coalesce(c.source_url, '')))")})
  LEFT JOIN ovl o ON o.user_id = u.user_id AND o.ai_news_id = c.ai_news_id
  LEFT JOIN seen sn ON sn.user_id = u.user_id AND sn.ai_news_id = c.ai_news_id
  WHERE u.is_active)"""
SESSION = """sess0 AS (SELECT *, (liked OR viewed) AND category <> '' AS touched FROM ucand),
sess1 AS (SELECT *, touched AND row_number() OVER (PARTITION BY user_id, touched ORDER BY candidate_pos DESC) <= 3 AS lst FROM sess0),
sess AS (SELECT *, count(*) FILTER (touched) OVER t AS topic_session, count(*) FILTER (lst) OVER t AS topic_last, count(*) FILTER (lst AND liked) OVER t AS topic_likes_last,
  count(*) FILTER (lst AND watch_time > 3) OVER t AS topic_dwells_last, row_number() OVER (PARTITION BY user_id, category ORDER BY candidate_pos) AS topic_count,
  count(*) FILTER (lst AND liked) OVER (PARTITION BY user_id) AS likes_last FROM sess1 WINDOW t AS (PARTITION BY user_id, category))"""
BAD_IMAGE = " OR ".join(f"contains(lower(image_url), '{w}')" for w in feed.BAD_IMAGE_WORDS)
AGE = f"(epoch_us({NOW} - created_at) / 3.6e9::DOUBLE)"
SCORED = f"""scored AS (SELECT *, round_even(0.0::DOUBLE + least(coalesce(ai_score, 0), 10.0)
  + CASE WHEN language = 'uz' THEN 3.0::DOUBLE WHEN language NOT IN ('', 'unknown') THEN -3.0::DOUBLE ELSE 0 END
  + CASE WHEN region <> 'uz' THEN 0::DOUBLE WHEN cold_start THEN 8.0 ELSE 5.0 END
  + CASE WHEN image_url IS NOT NULL AND regexp_matches(trim(image_url), '^https?://') AND NOT ({BAD_IMAGE}) THEN 1.0::DOUBLE ELSE 0 END
  + CASE WHEN text_len > 200 THEN 2.0::DOUBLE WHEN text_len < 50 THEN -1.0 ELSE 0 END
  + CASE WHEN NOT cold_start THEN 0::DOUBLE WHEN {AGE} < 6 THEN 2.0 WHEN {AGE} < 24 THEN 1.0 ELSE 0 END
  + (0.3::DOUBLE * coalesce(nullif(ai_score, 0), 0.3::DOUBLE) + 0.25::DOUBLE * exp(-{AGE} / 24.0::DOUBLE) + 0.2::DOUBLE * 0.5::DOUBLE + 0.25::DOUBLE * 0.0::DOUBLE) * 0.5::DOUBLE
  + CASE WHEN liked THEN 5.0::DOUBLE ELSE 0 END + CASE WHEN liked THEN 10.0::DOUBLE ELSE 0 END + CASE WHEN disliked OR skipped THEN -6.0::DOUBLE ELSE 0 END
  + CASE WHEN saved THEN 0.75::DOUBLE ELSE 0 END + CASE WHEN viewed THEN 2.0::DOUBLE ELSE 0 END + CASE WHEN liked THEN ln(2.0::DOUBLE) ELSE 0 END * 1.5::DOUBLE
  + coalesce(topic_weight * 1.5::DOUBLE, 0) + coalesce(source_weight * 2.0::DOUBLE, 0) + CASE WHEN overlap > 0 THEN least(4.0::DOUBLE, 2.0::DOUBLE + 0.25::DOUBLE * overlap) ELSE 0 END
  + CASE WHEN category <> '' AND topic_session >= 2 THEN 5.0::DOUBLE ELSE 0 END + CASE WHEN category <> '' AND topic_session >= 3 THEN 3.0::DOUBLE ELSE 0 END
  + CASE WHEN category <> '' AND topic_session >= 4 THEN -3.0::DOUBLE ELSE 0 END + CASE WHEN category <> '' AND topic_last >= 2 THEN 6.0::DOUBLE ELSE 0 END
  + CASE WHEN likes_last >= 2 AND topic_likes_last >= 1 THEN 4.0::DOUBLE ELSE 0 END
  + CASE WHEN watch_time > 6 THEN 8.0::DOUBLE WHEN watch_time > 3 THEN 4.0 WHEN watch_time > 0 AND watch_time < 1 THEN -5.0 ELSE 0 END
  + CASE WHEN liked AND watch_time > 3 THEN 5.0::DOUBLE WHEN liked AND watch_time < 1 THEN -3.0 ELSE 0 END
  + CASE WHEN category <> '' AND topic_dwells_last >= 2 THEN 6.0::DOUBLE ELSE 0 END + CASE WHEN topic_count >= 3 THEN -3.0::DOUBLE ELSE 0 END, 6) AS rank_score FROM sess),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rank_score DESC, created_at DESC, ai_news_id) AS rank_pos,
  topic_weight IS NOT NULL AS topic_known, topic_weight IS NOT NULL OR source_weight IS NOT NULL AS preferred FROM scored)"""
RANKED = ", ".join([MERGED, SAVED, HOSTS, LIKED, PROFILE, CANDS, STATE, UCAND, SESSION, SCORED])


def _slot_step(prev: str, name: str, step: int, eligible: str, slots: str) -> str:
    return f"""{name}a AS (SELECT *, count(step) OVER (PARTITION BY user_id, category) AS used, count(step) OVER (PARTITION BY user_id) AS taken,
  NOT seen AND step IS NULL AND ({eligible}) AS el FROM {prev}),
{name}b AS (SELECT *, el AND used + row_number() OVER (PARTITION BY user_id, category, el ORDER BY rank_pos) <= 3 AS cp FROM {name}a),
{name} AS (SELECT * EXCLUDE (step, used, taken, el, cp), coalesce(step, CASE WHEN cp AND row_number() OVER (PARTITION BY user_id, cp ORDER BY rank_pos) <= ({slots}) THEN {step} END) AS step FROM {name}b)"""


SLOTS = ", ".join([
    "s0 AS (SELECT *, CAST(NULL AS INT) AS step FROM ranked)",
    _slot_step("s0", "s1", 1, "preferred", "14"),
    _slot_step("s1", "s2", 2, "NOT preferred AND NOT topic_known", "2"),
    _slot_step("s2", "s3", 3, "NOT preferred", "6 - greatest(0, taken - 14)"),
    _slot_step("s3", "s4", 4, "TRUE", "20 - taken"),
    "slots AS (SELECT *, CASE WHEN step IS NOT NULL THEN row_number() OVER (PARTITION BY user_id, step IS NULL ORDER BY step, rank_pos) END AS slot_pos FROM s4)",
])
QUOTA = """q0 AS (SELECT *, row_number() OVER (PARTITION BY user_id, region = 'uz' ORDER BY slot_pos) AS rr FROM slots WHERE slot_pos IS NOT NULL),
q1 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN region = 'uz' AND rr <= 12 THEN 0 WHEN region <> 'uz' AND rr <= 8 THEN 1 ELSE 2 END, slot_pos) AS p FROM q0),
q2 AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM q1 WHERE p <= 20),
quota AS (SELECT *, CASE WHEN p <= 5 AND n >= 5 THEN row_number() OVER (PARTITION BY user_id, p <= 5 ORDER BY rank_score DESC, p) ELSE p END AS feed_pos FROM q2)"""


def _clean(source: str, name: str) -> str:
    return f"""{name}0 AS (SELECT *, row_number() OVER (PARTITION BY user_id, lower(trim(final_title)) ORDER BY feed_pos) AS tn FROM {source}
  WHERE trim(final_title) <> '' AND text_len > 0 AND ai_score > 0 AND (coalesce(image_url, '') = '' OR regexp_matches(image_url, '(?i)^https?://[^/?#]+'))),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY feed_pos) AS position FROM {name}0 WHERE tn = 1) WHERE position <= 20)"""


# swaps: the first (oversized topic) cannot fire here, as slots cap a topic at 3 of 20
SWAPS = """w0 AS (SELECT r.*, q.feed_pos, q.feed_pos IS NOT NULL AND r.topic_known AS kin, q.feed_pos IS NULL AND NOT r.topic_known AND NOT r.seen AS nout
  FROM ranked r LEFT JOIN quota q ON q.user_id = r.user_id AND q.ai_news_id = r.ai_news_id),
w1 AS (SELECT *, row_number() OVER (PARTITION BY user_id, kin ORDER BY feed_pos DESC) AS tr, row_number() OVER (PARTITION BY user_id, nout ORDER BY rank_pos) AS nr,
  least(greatest(0, 4 - count(*) FILTER (feed_pos IS NOT NULL AND NOT topic_known) OVER (PARTITION BY user_id)), count(*) FILTER (nout) OVER (PARTITION BY user_id)) AS k FROM w0),
swapped AS (SELECT a.* EXCLUDE (feed_pos), CASE WHEN a.nout AND a.nr <= a.k THEN b.feed_pos WHEN a.kin AND a.tr <= a.k THEN NULL ELSE a.feed_pos END AS feed_pos
  FROM w1 a LEFT JOIN w1 b ON b.user_id = a.user_id AND b.kin AND a.nout AND b.tr = a.nr AND b.tr <= b.k)"""
FINAL = f"{SWAPS}, {_clean('(SELECT * FROM swapped WHERE feed_pos IS NOT NULL)', 'final')}"

# --- candidates and scores ---------------------------------------------------------------
register("fresh_candidates",
         lambda t: shape(feed.fresh_candidates(t.v_ai_news, t.v_raw_news, t.as_of, LIMIT).select(
             "candidate_pos", "ai_news_id", "raw_news_id", "category", "region", "ai_score", "source_url", "image_url", "created_at")),
         "v_ai_news v_raw_news", f"SELECT candidate_pos, ai_news_id, raw_news_id, category, region, ai_score, source_url, image_url, {ts('created_at')} AS created_at FROM cands", CANDS)

register("freshness_scores",
         lambda t: shape(t.v_ai_news.select("ai_news_id", feed.freshness_48h(F.col("created_at"), t.as_of).alias("freshness_48h"),
                                            feed.freshness_24h(F.col("created_at"), t.as_of).alias("freshness_24h")), freshness_24h=6),
         "v_ai_news", f"SELECT ai_news_id, round_even(exp(-greatest(0.0, {AGE}) / 48.0), 6) AS freshness_48h, round(exp(-{AGE} / 24.0), 6) AS freshness_24h FROM v_ai_news")


def _light(t):
    facts = feed.candidate_facts(feed.fresh_candidates(t.v_ai_news, t.v_raw_news, t.as_of, LIMIT))
    prefs = profiles.category_preferences(t.v_events, t.v_ai_news)
    joined = prefs.join(facts, "category")
    score = feed.light_score(F.col("ai_score"), F.col("created_at"), F.lit(None).cast("double"), F.col("preference"), t.as_of)
    return shape(joined.select("user_id", "ai_news_id", score.alias("light_score")), light_score=6)


register("light_score", _light, "v_events v_ai_news v_raw_news", f"""
SELECT p.user_id, c.ai_news_id, round(0.3::DOUBLE * coalesce(nullif(ai_score, 0), 0.3::DOUBLE) + 0.25::DOUBLE * exp(-{AGE} / 24.0::DOUBLE) + 0.2::DOUBLE * 0.5::DOUBLE + 0.25::DOUBLE * preference, 6) AS light_score
FROM prefs p JOIN cands c USING (category)""", f"{PREFERENCES}, {CANDS}")

register("session_topics", lambda t: shape(feed.session_topics(_rows(t))), VIEWS,
         "SELECT user_id, category AS topic, count(*) AS n, count(*) FILTER (lst) AS in_last_three FROM sess1 WHERE touched GROUP BY 1, 2",
         ", ".join([MERGED, SAVED, HOSTS, LIKED, PROFILE, CANDS, STATE, UCAND, SESSION]))

register("rank_score", lambda t: shape(feed.rank_score(_rows(t), t.as_of).select("user_id", "ai_news_id", "rank_score")), VIEWS,
         "SELECT user_id, ai_news_id, rank_score FROM scored", RANKED)
register("rank_items", lambda t: shape(_ranked(t).select("user_id", "rank_pos", "ai_news_id", "rank_score", "preferred", "topic_known")), VIEWS,
         "SELECT user_id, rank_pos, ai_news_id, rank_score, preferred, topic_known FROM ranked", RANKED)
register("exploration_noise", lambda t: shape(feed.exploration_noise(_ranked(t)).select("user_id", "ai_news_id", "rank_score", "explored_score"), explored_score=6), VIEWS, """
SELECT user_id, ai_news_id, rank_score, round(rank_score + ('0x' || substr(sha256('0|' || user_id || '|' || ai_news_id), 1, 8))::BIGINT / 4294967296.0 * 0.15, 6) AS explored_score FROM ranked""", RANKED)

# --- filters ----------------------------------------------------------------------------------
register("dedupe_feed", lambda t: shape(dedup.dedupe_feed(_ranked(t)).select("user_id", "rank_pos", "ai_news_id")), VIEWS, """
SELECT user_id, rank_pos, ai_news_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, trim(regexp_replace(lower(final_title), '\\s+', ' ', 'g')) ORDER BY rank_pos) AS rn FROM ranked) WHERE rn = 1""", RANKED)
register("drop_seen", lambda t: shape(feed.drop_seen(_ranked(t), _seen(t)).select("user_id", "rank_pos", "ai_news_id")), VIEWS,
         "SELECT user_id, rank_pos, ai_news_id FROM ranked WHERE NOT seen", RANKED)
register("topic_cap", lambda t: shape(feed.topic_cap(_ranked(t)).select("user_id", "rank_pos", "ai_news_id", "category")), VIEWS, """
SELECT user_id, rank_pos, ai_news_id, category FROM (SELECT *, row_number() OVER (PARTITION BY user_id, category ORDER BY rank_pos) AS rn FROM ranked) WHERE rn <= 3""", RANKED)
register("filter_feed", lambda t: shape(feed.filter_feed(_ranked(t), _seen(t), 3, 5.0).select("user_id", "rank_pos", "ai_news_id", "category")), VIEWS, """
SELECT user_id, rank_pos, ai_news_id, category FROM (SELECT *, row_number() OVER (PARTITION BY user_id, category ORDER BY rank_pos) AS rn FROM (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, trim(regexp_replace(lower(final_title), '\\s+', ' ', 'g')) ORDER BY rank_pos) AS dn FROM ranked
    WHERE len(trim(final_title)) >= 5 AND text_len >= 30) WHERE dn = 1 AND NOT seen)) WHERE rn <= 3 AND rank_score >= 5.0""", RANKED)

def _once(ctes: str, *names: str) -> str:
    """The named expressions are computed once, however often the others read them."""
    for name in names:
        ctes = ctes.replace(f"{name} AS (", f"{name} AS MATERIALIZED (")
    return ctes


# --- assembly ------------------------------------------------------------------------------------
register("preference_slots",
         lambda t: shape(feed.preference_slots(_shortlist(t), LIMIT).where("slot_pos IS NOT NULL").select("user_id", "slot_pos", "slot_step", "ai_news_id")), VIEWS,
         "SELECT user_id, slot_pos, CAST(step AS BIGINT) AS slot_step, ai_news_id FROM slots WHERE slot_pos IS NOT NULL", f"{RANKED}, {SLOTS}")
register("region_quota",
         lambda t: shape(feed.region_quota(feed.preference_slots(_shortlist(t), LIMIT), LIMIT).where("feed_pos IS NOT NULL").select("user_id", "feed_pos", "ai_news_id", "region")), VIEWS,
         "SELECT user_id, feed_pos, ai_news_id, region FROM quota", f"{RANKED}, {SLOTS}, {QUOTA}")
register("diversity_swaps",
         lambda t: shape(plan.place(plan.slim_ranked(*_tables(t), limit=LIMIT)[0], LIMIT).select(
             "user_id", "feed_pos", "ai_news_id", "category")), VIEWS,
         "SELECT user_id, feed_pos, ai_news_id, category FROM swapped WHERE feed_pos IS NOT NULL", _once(f"{RANKED}, {SLOTS}, {QUOTA}, {SWAPS}", "ranked", "slots", "quota", "w1"))
register("sanitize_feed", lambda t: shape(plan.assemble(_ranked(t), LIMIT, swaps=False).select("user_id", "position", "ai_news_id")), VIEWS,
         "SELECT user_id, position, ai_news_id FROM clean", f"{RANKED}, {SLOTS}, {QUOTA}, {_clean('quota', 'clean')}")
register("feed_defaults",
         lambda t: shape(feed.display_defaults(t.v_ai_news.withColumn("image_url", F.get(F.from_json("image_urls", "array<string>"), F.lit(0)))).select("ai_news_id", "title", "text", "image", "source")),
         "v_ai_news", """SELECT ai_news_id, coalesce(nullif(trim(final_title), ''), 'News update') AS title, coalesce(nullif(trim(final_text), ''), 'News update') AS text,
  json_extract_string(image_urls, '$[0]') AS image, source_url AS source FROM v_ai_news""")


def _user_feed(t):
    return plan.user_feed(*_tables(t), limit=LIMIT)


FEED = f"{RANKED}, {SLOTS}, {QUOTA}, {FINAL}"
register("user_feed",
         lambda t: shape(_user_feed(t).select("user_id", "position", "ai_news_id", "category", "region", "rank_score", "liked", "saved", "viewed")), VIEWS,
         "SELECT user_id, position, ai_news_id, category, region, rank_score, liked, saved, viewed FROM final", FEED)


def _preload(t):
    return shape(plan.preload(*_tables(t), limit=LIMIT).withColumn("preload", F.array_join(F.col("preload").cast("array<string>"), ",")))


register("preload_ids", _preload, VIEWS, """
SELECT user_id, string_agg(CAST(ai_news_id AS VARCHAR), ',' ORDER BY rank_pos) AS preload FROM (
  SELECT r.*, row_number() OVER (PARTITION BY r.user_id ORDER BY r.rank_pos) AS rn FROM ranked r
  WHERE NOT EXISTS (SELECT 1 FROM final f WHERE f.user_id = r.user_id AND f.ai_news_id = r.ai_news_id)) WHERE rn <= 3 GROUP BY 1""", FEED)
register("search_feed", lambda t: shape(feed.search_feed(_user_feed(t), t.v_ai_news, " Furniture ").select("user_id", "position", "ai_news_id")), VIEWS, """
SELECT user_id, position, ai_news_id FROM final JOIN (SELECT ai_news_id FROM v_ai_news WHERE contains(lower(final_title || ' ' || final_text || ' ' || target_persona || ' ' || category || ' ' || CAST(raw_news_id AS VARCHAR)), 'furniture')) USING (ai_news_id)""", FEED)
register("feed_quality", lambda t: shape(metrics.feed_quality(_user_feed(t), 250)), VIEWS, """
SELECT user_id, count(*) AS final_count, round(count(*) FILTER (region = 'uz') / count(*) * 100, 4) AS uz_region_pct,
  round(count(*) FILTER (language = 'uz') / count(*) * 100, 4) AS uz_language_pct, round((250 - count(*)) / 250 * 100, 4) AS dedupe_rate FROM final GROUP BY 1""", FEED)
register("status_breakdown", lambda t: shape(metrics.status_breakdown(t.v_raw_news, t.v_ai_news, t.v_users, _user_feed(t))), VIEWS, """
SELECT 'status' AS scope, process_status AS name, count(*) AS cnt FROM v_raw_news GROUP BY 2
UNION ALL SELECT 'table', 'raw_news', count(*) FROM v_raw_news UNION ALL SELECT 'table', 'ai_news', count(*) FROM v_ai_news
UNION ALL SELECT 'table', 'users', count(*) FROM v_users UNION ALL SELECT 'table', 'user_feed', count(*) FROM final
UNION ALL SELECT 'table', 'generated_raw', count(*) FROM v_raw_news WHERE process_status IN ('generated', 'completed')""", FEED)

register("global_feed",
         lambda t: shape(feed.global_feed(t.v_ai_news, t.v_users, profiles.user_item_state(
             profiles.merge_interactions(t.v_interactions), profiles.saved_state(t.v_saved), t.v_comments), t.as_of, LIMIT)), VIEWS, f"""
SELECT u.user_id, c.position, c.ai_news_id, c.category, c.ai_score, {ts('c.created_at')} AS created_at, coalesce(i.ls > 0, FALSE) AS liked, s.user_id IS NOT NULL AS saved,
  coalesce(i.vw, FALSE) AS viewed, CASE WHEN i.user_id IS NULL AND s.user_id IS NULL THEN 0 ELSE coalesce(n.n, 0) END AS comment_count
FROM v_users u CROSS JOIN top20 c LEFT JOIN ist i ON i.user_id = u.user_id AND i.ai_news_id = c.ai_news_id
LEFT JOIN saved_now s ON s.user_id = u.user_id AND s.ai_news_id = c.ai_news_id LEFT JOIN ncom n ON n.ai_news_id = c.ai_news_id""",
         ", ".join([MERGED, SAVED, STATE, f"""top20 AS (SELECT *, row_number() OVER (ORDER BY ai_score DESC, created_at DESC, ai_news_id) AS position FROM (
  SELECT * FROM v_ai_news WHERE created_at >= {NOW} - INTERVAL 48 HOUR AND ai_score > 0.5 ORDER BY ai_score DESC, created_at DESC, ai_news_id LIMIT 20))"""]))
register("pending_feed", lambda t: shape(feed.pending_feed(t.v_raw_news, t.v_ai_news, t.as_of, 50)), "v_raw_news v_ai_news", f"""
SELECT raw_news_id, source_url, title, {ts('created_at')} AS created_at, count(*) OVER () AS total_pending FROM v_raw_news
WHERE created_at >= {NOW} - INTERVAL 7 DAY AND title IS NOT NULL AND raw_news_id NOT IN (SELECT raw_news_id FROM v_ai_news) ORDER BY created_at DESC, raw_news_id DESC LIMIT 50""")

# --- vectors ---------------------------------------------------------------------------------------


def _label_topk(t):
    centers = vectors.label_centroids(t.embeddings, "label", "embedding").withColumn("label", F.col("label").cast("bigint"))
    items = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    return shape(vectors.cosine_topk(items, centers, "vec_id", "label", 10, per="label"))


register("cosine_topk", _label_topk, "", """
SELECT label, vec_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS rank FROM (
  SELECT c.label, e.vec_id, round_even(sum(c.x * e.x) / (sqrt(sum(c.x * c.x)) * sqrt(sum(e.x * e.x))), 6) AS similarity
  FROM cen c JOIN el e ON e.idx = c.idx GROUP BY 1, 2)) WHERE rank <= 10""",
         """el AS (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS idx FROM embeddings),
cen AS (SELECT label, idx, avg(x) AS x FROM el GROUP BY 1, 2)""")


def _article_texts(t, articles):
    raw = t.v_raw_news.select("raw_news_id", F.col("title").alias("raw_text"))
    body = text.article_embedding_text(*[F.col(c) for c in ("final_title", "final_text", "category", "target_persona", "raw_text", "region")])
    return articles.join(raw, "raw_news_id", "left").select("ai_news_id", body.alias("body"))


def _user_texts(t):
    body = text.user_embedding_text(F.col("interests"), F.col("location"), F.col("country_code"), F.col("username"))
    return t.v_users.select("user_id", body.alias("body"))


def _user_vectors(t):
    profile = text.dense_vectors(text.hash_embedding(_user_texts(t), "user_id", "body", DIM), "user_id", DIM)
    merged = profiles.merge_interactions(t.v_interactions)
    last_seq = t.v_interactions.groupBy("user_id", "ai_news_id").agg(F.max("seq").alias("seq"))
    weighted = merged.join(last_seq, ["user_id", "ai_news_id"]).withColumn(
        "weight", profiles.signal_weight(F.col("liked"), F.col("viewed"), F.lit(False), F.col("watch_time")))
    saved = profiles.saved_state(t.v_saved)
    # only articles in somebody's history need a vector
    touched = weighted.select("ai_news_id").union(saved.select("ai_news_id")).distinct()
    needed = t.v_ai_news.join(touched, "ai_news_id", "left_semi")
    articles = text.dense_vectors(text.hash_embedding(_article_texts(t, needed), "ai_news_id", "body", DIM), "ai_news_id", DIM)
    return vectors.user_embedding(profile, weighted, saved, t.v_ai_news, articles)


UVEC = ", ".join([MERGED, SAVED,
    f"utext AS (SELECT user_id, {USER_TEXT} AS body FROM v_users)", embedding_ctes("ue", "utext", "user_id", "body"),
    f"atext AS (SELECT a.ai_news_id, {NEWS_TEXT} AS body FROM v_ai_news a LEFT JOIN v_raw_news r USING (raw_news_id))", embedding_ctes("ae", "atext", "ai_news_id", "body"),
    """hist AS (SELECT user_id, ai_news_id, w FROM (SELECT m.user_id, m.ai_news_id, CASE WHEN viewed THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN liked THEN 2.25::DOUBLE WHEN NOT liked THEN -1.2::DOUBLE ELSE 0 END
    + CASE WHEN watch_time > 0 THEN least(watch_time / 240.0::DOUBLE, 0.5::DOUBLE) ELSE 0 END AS w, row_number() OVER (PARTITION BY m.user_id ORDER BY m.created_at DESC, s.seq DESC) AS rn
    FROM merged m JOIN (SELECT user_id, ai_news_id, max(seq) AS seq FROM v_interactions GROUP BY 1, 2) s USING (user_id, ai_news_id)) WHERE rn <= 20
  UNION ALL SELECT user_id, ai_news_id, 1.35::DOUBLE FROM (SELECT *, row_number() OVER (PARTITION BY user_id, t ORDER BY saved_at DESC, seq DESC) AS tn FROM (
    SELECT s.*, lower(trim(regexp_replace(a.final_title, '\\s+', ' ', 'g'))) AS t FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY saved_at DESC, seq DESC) AS rn FROM saved_now) s
    JOIN v_ai_news a USING (ai_news_id) WHERE rn <= 20)) WHERE tn = 1),
uvs AS (SELECT user_id, idx, sum(x) AS x FROM (SELECT id AS user_id, idx, 1.8::DOUBLE * weight AS x FROM ue
  UNION ALL SELECT h.user_id, e.idx, h.w * e.weight FROM hist h JOIN ae e ON e.id = h.ai_news_id WHERE h.w <> 0) GROUP BY 1, 2),
uvec AS (SELECT user_id, idx, round_even(x / sqrt(sum(x * x) OVER (PARTITION BY user_id)), 8) AS weight FROM uvs)"""])


def _user_embedding(t):
    long = _user_vectors(t).select("user_id", F.posexplode("vector").alias("idx", "weight"))
    return shape(long.where("weight <> 0"))


register("user_embedding", _user_embedding, "v_users v_ai_news v_raw_news v_interactions v_saved",
         "SELECT user_id, idx, weight FROM uvec WHERE weight <> 0", UVEC)


def _similarity_rank(t):
    articles, raw = t.v_ai_news, t.v_raw_news
    candidates = feed.fresh_candidates(articles, raw, t.as_of, LIMIT)
    items = text.dense_vectors(text.hash_embedding(_article_texts(t, candidates), "ai_news_id", "body", DIM), "ai_news_id", DIM)
    users = _user_vectors(t)
    similar = vectors.cosine_topk(users, items, "user_id", "ai_news_id", LIMIT * feed.SIMILARITY_WINDOW, per="user_id").drop("rank")
    state = profiles.user_item_state(profiles.merge_interactions(t.v_interactions), profiles.saved_state(t.v_saved), t.v_comments)
    flag_cols = F.struct("liked", "viewed", "saved", "disliked", "comment_count")
    context = state.join(candidates.select("ai_news_id"), "ai_news_id", "left_semi").groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("ai_news_id", flag_cols))).alias("flags"))
    topics = t.v_users.select("user_id", personas.user_topics(F.col("interests")).alias("topics"))
    ranked = vectors.similarity_rank(similar, feed.candidate_facts(candidates), context, topics, t.as_of, LIMIT)
    return shape(ranked.select("user_id", "position", "ai_news_id", "similarity", "rank_score"))


register("similarity_rank", _similarity_rank, VIEWS, """
SELECT user_id, position, ai_news_id, similarity, rank_score FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rank_score DESC, similarity DESC, ai_score DESC, ai_news_id DESC) AS position FROM (
    SELECT *, bool_or(keep) OVER (PARTITION BY user_id) AS anyk FROM sscore) WHERE keep OR NOT anyk) WHERE position <= 20""",
         ", ".join([UVEC, CANDS, STATE, f"""csim AS (SELECT u.user_id, c.ai_news_id, coalesce(round_even(d.dot / (un.n * cn.n), 6), 0) AS similarity FROM (SELECT DISTINCT user_id FROM uvec) u CROSS JOIN cands c
  LEFT JOIN (SELECT v.user_id, e.id, sum(v.weight * e.weight) AS dot FROM uvec v JOIN ae e ON e.idx = v.idx AND e.id IN (SELECT ai_news_id FROM cands) GROUP BY 1, 2) d ON d.user_id = u.user_id AND d.id = c.ai_news_id
  LEFT JOIN (SELECT user_id, sqrt(sum(weight * weight)) AS n FROM uvec GROUP BY 1) un ON un.user_id = u.user_id
  LEFT JOIN (SELECT id, sqrt(sum(weight * weight)) AS n FROM ae GROUP BY 1) cn ON cn.id = c.ai_news_id),
cwin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY similarity DESC, ai_news_id) AS rn FROM csim) WHERE rn <= 80),
sscore AS (SELECT w.user_id, w.ai_news_id, w.similarity, c.ai_score, round_even(1.0::DOUBLE * w.similarity + 0.45::DOUBLE * (CASE WHEN s.user_id IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END
    + CASE WHEN i.ls > 0 THEN 1.25::DOUBLE WHEN i.ls < 0 THEN -0.5::DOUBLE ELSE 0 END + CASE WHEN i.vw THEN 0.25::DOUBLE ELSE 0 END
    + CASE WHEN i.user_id IS NULL AND s.user_id IS NULL THEN 0 ELSE least(coalesce(n.n, 0) * 0.03::DOUBLE, 0.25::DOUBLE) END) + 0.2::DOUBLE * round_even(exp(-greatest(0.0, (epoch_us({NOW} - c.created_at) / 3.6e9::DOUBLE)) / 48.0), 6), 6) AS rank_score,
  (s.user_id IS NOT NULL OR len(list_filter(CAST(u.interests->'all_topics' AS VARCHAR[]), lambda x: x <> 'general' AND (c.target_persona = x OR starts_with(c.target_persona, x || '|')))) > 0)
    AND (NOT coalesce(i.vw, FALSE) OR s.user_id IS NOT NULL) AS keep
  FROM cwin w JOIN cands c USING (ai_news_id) JOIN v_users u ON u.user_id = w.user_id LEFT JOIN ist i ON i.user_id = w.user_id AND i.ai_news_id = w.ai_news_id
  LEFT JOIN saved_now s ON s.user_id = w.user_id AND s.ai_news_id = w.ai_news_id LEFT JOIN ncom n ON n.ai_news_id = w.ai_news_id)"""]))
