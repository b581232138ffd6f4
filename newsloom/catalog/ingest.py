"""Queries over sources, ingest cleaning and images."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from newsloom.catalog import duck as D
from newsloom.catalog.base import register, shape, ts
from newsloom.catalog.events import NOW
from newsloom.functions import dates, urls
from newsloom.functions import images as I
from newsloom.functions import lexicon as L
from newsloom.operators import dedup, images, ingest, pages
from newsloom.session import checkpoint_dir
from newsloom.sources import append, rss, tables

# --- sources ---------------------------------------------------------------------------
register("latest_rows",
         lambda t: shape(tables.latest_rows(t.v_raw_news.select(F.lit("raw").alias("kind"), F.col("raw_news_id").alias("id"), "title"), "id", 50).unionByName(
             tables.latest_rows(t.v_ai_news.select(F.lit("enriched").alias("kind"), F.col("ai_news_id").alias("id"), F.col("final_title").alias("title")), "id", 50))),
         "v_raw_news v_ai_news", """SELECT * FROM (SELECT 'raw' AS kind, raw_news_id AS id, title FROM v_raw_news ORDER BY raw_news_id DESC LIMIT 50)
UNION ALL SELECT * FROM (SELECT 'enriched', ai_news_id, final_title FROM v_ai_news ORDER BY ai_news_id DESC LIMIT 50)""")


def _list_forms(t):
    n, js = F.col("ai_news_id"), F.col("image_urls")
    bare = F.regexp_replace(js, r'[\["\]]', "")
    form = (
        F.when(n % 5 == 0, js).when(n % 5 == 1, F.concat(F.lit("{"), F.regexp_replace(bare, ",", ", "), F.lit("}")))
        .when(n % 5 == 2, bare).when(n % 5 == 3, F.lit(" ")).otherwise(F.lit('{"a": 1}'))
    )
    return t.v_ai_news.select("ai_news_id", tables.coerce_json_list(form).alias("urls"))


register("coerce_json_list", lambda t: shape(_list_forms(t)), "v_ai_news",
         "SELECT ai_news_id, CASE WHEN ai_news_id % 5 < 3 THEN replace(regexp_replace(image_urls, '[\\[\"\\]]', '', 'g'), ',', '¦') ELSE '' END AS urls FROM v_ai_news")
register("vector_from_json",
         lambda t: shape(t.embeddings.select("vec_id", F.posexplode(tables.vector_from_json(F.to_json("embedding"))).alias("pos", "value"))
                         .withColumn("value", F.col("value").cast("float"))),
         "", "SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings")


def _as_feed(batches):
    """Each task's items between the tags that make its file one feed."""
    yield pd.DataFrame({"value": ['<rss xmlns:media="http://search.yahoo.com/mrss/"><channel>']})
    yield from batches
    yield pd.DataFrame({"value": ["</channel></rss>"]})


def _rss(t):
    """Documents written as feed files and read back through the XML source."""
    spark = t.spark
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    host = F.element_at(F.array(F.lit("kun.uz"), F.lit("daryo.uz"), F.lit("site.example.org")), (F.col("doc_id") % 3 + 1).cast("int"))
    day = F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")
    title = F.when(F.col("doc_id") % 10 == 9, "").otherwise(esc(F.substring("text", 1, 60)))
    item = F.concat(
        F.lit("<item><title>"), title, F.lit("</title><link>https://"), host, F.lit("/n/"), F.col("doc_id").cast("string"),
        F.lit("</link><description>"), esc(F.col("text")), F.lit("</description><pubDate>Mon, "), day,
        F.lit(' Jan 2024 10:00:00 GMT</pubDate><media:content url="https://cdn.example.com/'), F.col("doc_id").cast("string"), F.lit('.jpg"/></item>'),
    )
    entry = F.concat(
        F.lit("<entry><title>"), title, F.lit('</title><link href="https://'), host, F.lit("/n/"), F.col("doc_id").cast("string"),
        F.lit('"/><summary>'), esc(F.col("text")), F.lit("</summary><updated>2024-01-"), day, F.lit("T10:00:00Z</updated></entry>"),
    )
    path = f"{checkpoint_dir(spark)}/newsloom-feeds-{uuid.uuid4().hex}"
    lines = t.documents.select(F.when(F.col("doc_id") % 2 == 0, item).otherwise(entry).alias("value"))
    lines.mapInPandas(_as_feed, "value string").write.text(path)
    return rss.rss_items(spark, path, ingest.source_table(spark))


register("rss_items", lambda t: shape(_rss(t)), "", f"""
SELECT t AS title, 'https://' || h || '/n/' || doc_id AS url, {D.strip('text')} AS description, CASE WHEN doc_id % 2 = 0 THEN 'https://cdn.example.com/' || doc_id || '.jpg' END AS image_url,
  {ts("make_timestamp(2024, 1, doc_id % 28 + 1, 10, 0, 0)")} AS published_at, CAST(CASE h WHEN 'kun.uz' THEN 106 WHEN 'daryo.uz' THEN 102 ELSE 0 END AS BIGINT) AS source_priority
FROM (SELECT *, {D.strip('substr(text, 1, 60)')} AS t, ['kun.uz', 'daryo.uz', 'site.example.org'][doc_id % 3 + 1] AS h FROM documents WHERE doc_id % 10 <> 9) WHERE t <> ''""")


def _append(i):
    def run(t):
        rows = t.v_raw_news.select("raw_news_id", "title", "source_url", F.col("html").alias("raw_text"))
        table = rows.where("raw_news_id % 2 = 0").withColumn("content_hash", dedup.content_sha256(F.col("title"), F.col("raw_text"), F.col("source_url")))
        # the batch repeats every fourth stored row under its address, and two thirds of the rest twice
        batch = rows.where("raw_news_id % 2 = 1 OR raw_news_id % 4 = 0").withColumn("seq", F.col("raw_news_id"))
        again = rows.where("raw_news_id % 2 = 1 AND raw_news_id % 3 > 0").withColumn("seq", F.col("raw_news_id") + 1_000_000_000)
        out = append.append_new(batch.unionByName(again), table.select("source_url", "content_hash"), "seq")[i]
        return shape(out.select("raw_news_id", "source_url", "content_hash") if i == 0 else out)
    return run


register("append_new", _append(0), "v_raw_news",
         "SELECT raw_news_id, source_url, sha256(trim(title) || '|' || trim(html) || '|' || trim(source_url)) AS content_hash FROM v_raw_news WHERE raw_news_id % 2 = 1 AND source_url NOT IN (SELECT source_url FROM v_raw_news WHERE raw_news_id % 2 = 0)")
register("append_new_stats", _append(1), "v_raw_news", """SELECT total, inserted, total - inserted AS skipped FROM (SELECT count(*) FILTER (raw_news_id % 2 = 1 OR raw_news_id % 4 = 0) + count(*) FILTER (raw_news_id % 2 = 1 AND raw_news_id % 3 > 0) AS total,
  count(*) FILTER (raw_news_id % 2 = 1) AS inserted FROM v_raw_news)""")
register("source_summary",
         lambda t: shape(tables.source_summary(t.v_ai_news.withColumn("source", urls.hostname(F.col("source_url"))), "source", ["source_url"], "ai_news_id")
                         .withColumn("examples", F.transform("examples", lambda e: e["source_url"]))),
         "v_ai_news", f"""SELECT source, count(*) AS cnt, string_agg(source_url, '¦' ORDER BY ai_news_id) FILTER (rn <= 5) AS examples FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY ai_news_id) AS rn FROM (SELECT *, {D.hostname('source_url')} AS source FROM v_ai_news)) GROUP BY 1""")

# --- addresses and article rows --------------------------------------------------------------
register("normalize_source_url", lambda t: shape(t.pages.select("page_id", urls.normalize_source_url(F.col("url")).alias("normalized"))), "",
         f"SELECT page_id, {D.normalize_source_url('url')} AS normalized FROM pages")


def _wrapped(t):
    def wrap(c, key):
        return F.concat(F.lit(f"https://go.example.com/r?a=1&{key}="), F.url_encode(c))

    i, u = F.col("page_id"), F.col("url")
    form = (
        F.when(i % 4 == 0, wrap(u, "url")).when(i % 4 == 1, wrap(wrap(u, "dest"), "u"))
        .when(i % 4 == 2, wrap(wrap(wrap(u, "r"), "redirect"), "continue")).otherwise(F.concat(u, F.lit("?url=none")))
    )
    return t.pages.select("page_id", urls.unwrap_redirect_url(form).alias("target"))


def _level(src: str) -> str:
    found = []
    for key in urls.REDIRECT_PARAMS:
        v = f"url_decode(trim(url_decode(replace(regexp_extract({D.url_part('u', 4)}, '(?:^|&){key}=([^&]+)', 1), '+', ' '))))"
        found.append(f"CASE WHEN regexp_matches(lower({v}), '^https?://') THEN {v} END")
    return f"SELECT page_id, coalesce({', '.join(found)}, u) AS u FROM {src}"


WRAPPED = f"""l0 AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://go.example.com/r?a=1&url=' || e1 WHEN 1 THEN 'https://go.example.com/r?a=1&u=' || url_encode('https://go.example.com/r?a=1&dest=' || e1)
  WHEN 2 THEN 'https://go.example.com/r?a=1&continue=' || url_encode('https://go.example.com/r?a=1&redirect=' || url_encode('https://go.example.com/r?a=1&r=' || e1)) ELSE url || '?url=none' END AS u FROM (SELECT *, url_encode(url) AS e1 FROM pages)),
l1 AS ({_level('l0')}), l2 AS ({_level('l1')}), l3 AS ({_level('l2')})"""
register("unwrap_redirect_url", lambda t: shape(_wrapped(t)), "", "SELECT page_id, u AS target FROM l3", WRAPPED)


def _payload(t):
    d = F.col("doc_id")
    return t.documents.select(
        F.when(d % 9 == 0, " ").otherwise(F.substring("text", 1, 60)).alias("title"), F.when(d % 2 == 0, F.col("lang")).alias("description"),
        F.col("text").alias("content"), F.concat(F.lit("https://go.example.com/?url="), F.url_encode(F.concat(F.lit("https://site.example.org/"), d.cast("string")))).alias("url"),
        F.when(d % 5 > 0, F.col("source")).alias("source_name"), F.lit(None).cast("string").alias("image_url"), F.lit("2024-01-30").alias("published_at"))


register("normalize_article", lambda t: shape(ingest.normalize_article(_payload(t))), "", f"""
SELECT CASE WHEN doc_id % 9 = 0 THEN 'Untitled' ELSE coalesce(nullif({D.strip('substr(text, 1, 60)')}, ''), 'Untitled') END AS title,
  CASE WHEN doc_id % 2 = 0 THEN lang || CASE WHEN {D.strip('text')} <> '' THEN chr(10) || chr(10) ELSE '' END ELSE '' END || {D.strip('text')} AS raw_text,
  'https://site.example.org/' || doc_id AS source_url, 'general' AS category, CASE WHEN doc_id % 5 > 0 THEN source ELSE 'global' END AS region, FALSE AS is_urgent,
  CAST(NULL AS VARCHAR) AS image_url, '2024-01-30' AS published_at FROM documents""")
register("canonical_items",
         lambda t: shape(ingest.canonical_items(
             t.documents.select("doc_id", F.concat(F.lit("https://"), "source", F.lit(".example.org")).alias("source"), F.substring("text", 1, 60).alias("title"),
                                F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("https://a/"), F.col("doc_id").cast("string"))).alias("url"), F.col("text").alias("content"), F.col("lang").alias("section")),
             ["src1.example.org", "src2.example.org"])),
         "", """SELECT title, 'https://a/' || doc_id AS source_url, CAST(NULL AS VARCHAR) AS image_url, content AS raw_text, lang AS category, CAST(NULL AS VARCHAR) AS region FROM (
  SELECT doc_id, nullif(substr(text, 1, 60), '') AS title, text AS content, lang FROM documents WHERE source IN ('src1', 'src2')) WHERE doc_id % 3 > 0""")


def _date_texts(t):
    k, o = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    text = (
        F.when(k % 4 == 0, F.date_format(o, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k % 4 == 1, F.concat(F.date_format(o, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0500")))
        .when(k % 4 == 2, F.date_format(o, "yyyy-MM-dd")).otherwise(F.concat(F.lit("around "), F.date_format(o, "yyyy")))
    )
    return t.orders.select("o_orderkey", dates.parse_published_at(text).alias("published_at"))


register("parse_published_at", lambda t: shape(_date_texts(t)), "", f"""
SELECT o_orderkey, {ts("CASE o_orderkey % 4 WHEN 0 THEN date_trunc('second', o_orderdate) WHEN 1 THEN date_trunc('second', o_orderdate) - INTERVAL 5 HOUR WHEN 2 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END")} AS published_at FROM orders""")

GATE_IN = """gi AS (SELECT raw_news_id, CASE WHEN raw_news_id % 23 = 0 THEN '' WHEN raw_news_id % 19 = 0 THEN 'A test of the gate' ELSE title END AS title,
  CASE WHEN raw_news_id % 17 = 0 THEN NULL WHEN raw_news_id % 13 = 0 THEN 'https://ads.example.com/x' ELSE source_url END AS source_url,
  CASE WHEN raw_news_id % 23 = 0 THEN ' ' WHEN raw_news_id % 11 = 0 THEN 'New Trailer out' ELSE html END AS raw_text, created_at AS published_at FROM v_raw_news)"""


def _gate_input(t):
    i = F.col("raw_news_id")
    return t.v_raw_news.select(
        "raw_news_id",
        F.when(i % 23 == 0, "").when(i % 19 == 0, "A test of the gate").otherwise(F.col("title")).alias("title"),
        F.when(i % 17 == 0, None).when(i % 13 == 0, "https://ads.example.com/x").otherwise(F.col("source_url")).alias("source_url"),
        F.when(i % 23 == 0, " ").when(i % 11 == 0, "New Trailer out").otherwise(F.col("html")).alias("raw_text"),
        F.col("created_at").alias("published_at"),
    )


def _plain(x: str) -> str:
    return D.strip(D.collapse(D.unescape(f"coalesce({x}, '')")))


GATE = f"""{GATE_IN}, gc AS (SELECT raw_news_id, published_at, lower({_plain('title')}) AS t, lower({_plain('raw_text')}) AS r, lower(coalesce({D.normalize_source_url('source_url')}, '')) AS u FROM gi),
gate AS (SELECT raw_news_id, CASE WHEN published_at < {NOW} - INTERVAL 48 HOUR THEN 'dropped' WHEN u = '' OR {D.any_of('u', ingest.BAD_SOURCE_WORDS)} THEN 'ignored_source' WHEN t = '' AND r = '' THEN 'ignored_empty'
  WHEN {D.any_of("(t || ' ' || r || ' ' || u)", ingest.GARBAGE_WORDS)} THEN 'ignored_garbage' WHEN contains(t, 'test') THEN 'ignored_test' ELSE 'pending' END AS gate FROM gc)"""
register("ingest_gate", lambda t: shape(ingest.ingest_gate(_gate_input(t), t.as_of).select("raw_news_id", "gate")), "v_raw_news", "SELECT raw_news_id, gate FROM gate", GATE)
register("ingest_gate_funnel", lambda t: shape(ingest.gate_funnel(ingest.ingest_gate(_gate_input(t), t.as_of))), "v_raw_news", "SELECT gate, count(*) AS cnt FROM gate GROUP BY 1", GATE)

HOSTS9 = [u.split("/")[2] for _, _, u, _ in ingest.SOURCE_PRIORITIES] + ["site.example.org"]


def _sourced(t):
    host = F.element_at(F.array(*[F.lit(h) for h in HOSTS9]), (F.col("ai_news_id") % 10 + 1).cast("int"))
    url = F.concat(F.lit("https://"), host, F.lit("/a/"), F.col("ai_news_id").cast("string"))
    rows = t.v_ai_news.select("ai_news_id", "final_title", url.alias("source_url"), "created_at",
                              F.when(F.col("ai_news_id") % 7 > 0, F.col("created_at")).alias("published_at"))
    return ingest.source_priority(rows, ingest.source_table(t.spark), ["uz"])


PRIOS = {}
for _g, _n, _u, _p in ingest.SOURCE_PRIORITIES:
    PRIOS[_u.split("/")[2]] = max(PRIOS.get(_u.split("/")[2], 0), _p + (4 if _g == "uz" else 0))
SOURCED = f"""sp AS (SELECT ai_news_id, final_title, created_at, CASE WHEN ai_news_id % 7 > 0 THEN created_at END AS published_at, h, 'https://' || h || '/a/' || ai_news_id AS source_url,
  CAST(CASE h {' '.join(f"WHEN {D.q(h)} THEN {p}" for h, p in PRIOS.items())} ELSE 0 END AS BIGINT) AS source_priority FROM (SELECT *, {D.arr(HOSTS9)}[ai_news_id % 10 + 1] AS h FROM v_ai_news))"""
register("source_priority", lambda t: shape(_sourced(t).select("ai_news_id", "source_url", "source_priority")), "v_ai_news", "SELECT ai_news_id, source_url, source_priority FROM sp", SOURCED)
register("prioritize_recent", lambda t: shape(ingest.prioritize_recent(_sourced(t), t.as_of, 150, "ai_news_id").select("ai_news_id", "source_priority", "published_at")), "v_ai_news", f"""
SELECT ai_news_id, source_priority, {ts('published_at')} AS published_at FROM (SELECT * FROM sp ORDER BY source_priority DESC, CASE WHEN published_at >= {NOW} - INTERVAL 24 HOUR THEN 0 ELSE 1 END, published_at DESC NULLS LAST, ai_news_id LIMIT 150)""", SOURCED)
register("country_global_mix",
         lambda t: shape(ingest.country_global_mix(_sourced(t), ingest.preferred_domains(["uz"]), 60, "ai_news_id").select("ai_news_id", "mix_pos", "is_preferred")), "v_ai_news", """
SELECT ai_news_id, mix_pos, is_preferred FROM (SELECT *, row_number() OVER (PARTITION BY lower(source_url) ORDER BY mix_pos) AS dn FROM (
  SELECT *, CASE WHEN is_preferred THEN rn ELSE rn + 36 END AS mix_pos FROM (SELECT *, row_number() OVER (PARTITION BY is_preferred ORDER BY created_at DESC, ai_news_id) AS rn FROM (
    SELECT *, regexp_replace(h, '^www\\.', '') IN ('kun.uz', 'gazeta.uz', 'daryo.uz', 'uznews.uz') AS is_preferred FROM sp)) WHERE rn <= CASE WHEN is_preferred THEN 36 ELSE 24 END)) WHERE dn = 1""", SOURCED)

# --- images ---------------------------------------------------------------------------------------


def _images(t):
    """Fixture images, and variants of them: protocol-relative, bare host, relative, inline and resized forms."""
    n, u = F.col("ai_news_id"), F.col("url")
    made = (
        F.when(n % 6 == 0, F.regexp_replace(u, "^https:", "")).when(n % 6 == 1, F.regexp_replace(u, "^https://", ""))
        .when(n % 6 == 2, F.concat(F.lit("/thumb/"), n.cast("string"), F.lit(".png"))).when(n % 6 == 3, F.lit("data:image/png;base64,AA"))
        .when(n % 6 == 4, F.concat(F.lit("https://ichef.bbci.co.uk/news/"), (n % 900 + 100).cast("string"), F.lit("/p.jpg")))
        .otherwise(F.concat(F.lit("https://cdn.example.com/a.jpg?w="), (n % 1200).cast("string"), F.lit("&h="), (n % 800).cast("string")))
    )
    return t.v_images.unionByName(t.v_images.select((-n).alias("ai_news_id"), "pos", made.alias("url")))


IMG = """img AS (SELECT ai_news_id, pos, url FROM v_images UNION ALL SELECT -ai_news_id, pos, CASE ai_news_id % 6 WHEN 0 THEN regexp_replace(url, '^https:', '') WHEN 1 THEN regexp_replace(url, '^https://', '')
  WHEN 2 THEN '/thumb/' || ai_news_id || '.png' WHEN 3 THEN 'data:image/png;base64,AA' WHEN 4 THEN 'https://ichef.bbci.co.uk/news/' || (ai_news_id % 900 + 100) || '/p.jpg'
  ELSE 'https://cdn.example.com/a.jpg?w=' || (ai_news_id % 1200) || '&h=' || (ai_news_id % 800) END FROM v_images)"""
from newsloom.operators.feed import BAD_IMAGE_WORDS  # noqa: E402

PAIR = "(?:^|[^0-9])([0-9]{2,4})[xX]([0-9]{2,4})(?:[^0-9]|$)"
PQ = f"({D.url_part('url', 3)} || ' ' || {D.url_part('url', 4)})"
DIMS = f"""dim AS (SELECT *, lower(url) AS lo, lower({D.url_part('url', 3)}) AS p, lower({PQ}) AS pq,
  coalesce(TRY_CAST(nullif(regexp_extract({D.url_part('url', 4)}, '(?:^|&)w=([^&]+)', 1), '') AS INT), TRY_CAST(nullif(regexp_extract({PQ}, '{PAIR}', 1), '') AS INT)) AS w0,
  coalesce(TRY_CAST(nullif(regexp_extract({D.url_part('url', 4)}, '(?:^|&)h=([^&]+)', 1), '') AS INT), TRY_CAST(nullif(regexp_extract({PQ}, '{PAIR}', 2), '') AS INT)) AS h,
  TRY_CAST(nullif(regexp_extract({D.url_part('url', 3)}, '/(?:standard|news|thumb|thumbnail)/([0-9]{{2,4}})/', 1), '') AS INT) AS wf FROM {{src}})"""
NEWS_PHOTO = f"""(lo <> '' AND NOT {D.any_of('pq', I.BLOCKED_TERMS + I.LOW_QUALITY_TERMS)} AND NOT regexp_matches(p, '\\.(svg|ico|gif|js|css|json|xml|txt|pdf|woff|woff2|ttf|map)$')
  AND NOT (coalesce(coalesce(w0, wf) < 720, FALSE) OR coalesce(h < 400, FALSE) OR coalesce(coalesce(w0, wf) * h < 288000, FALSE))
  AND NOT coalesce(TRY_CAST(nullif(regexp_extract(pq, '{PAIR}', 1), '') AS INT) < 360 OR TRY_CAST(nullif(regexp_extract(pq, '{PAIR}', 2), '') AS INT) < 220, FALSE))"""
register("image_url_filter", lambda t: shape(images.image_url_filter(_images(t))), "v_images", f"""
SELECT ai_news_id, pos, url, regexp_matches(url, '^https?://') AND NOT {D.any_of('lo', BAD_IMAGE_WORDS)} AS soft_ok,
  regexp_matches(url, '(?i)^https?://') AND NOT {D.any_of('lo', I.LOW_QUALITY_TERMS)} AND NOT regexp_matches(p, '\\.(svg|ico|gif)$') AND NOT coalesce(w0 < 640, FALSE) AND NOT coalesce(h < 360, FALSE) AS candidate_ok,
  {NEWS_PHOTO} AS news_photo,
  NOT starts_with(lo, 'data:') AND NOT {D.any_of('lo', I.EXTRACTOR_BAD_WORDS)} AND (regexp_matches(p, '\\.(jpg|jpeg|png|webp|gif|avif)$') OR contains(p, 'img') OR contains(p, 'images')) AS extractor_ok,
  starts_with(lo, 'data:') OR contains(lo, '.svg') OR {D.any_of('lo', I.REJECTED_WORDS)} AS rejected, regexp_replace(url, '[?#].*$', '') AS bare_url FROM dim""",
         f"{IMG}, {DIMS.replace('{src}', 'img')}")
register("normalize_candidate_url",
         lambda t: shape(_images(t).select("ai_news_id", "pos", I.normalize_candidate_url(F.col("url"), F.when(F.col("pos") < 2, F.lit("https://site.example.org/x/y.html"))).alias("absolute"))),
         "v_images", """SELECT ai_news_id, pos, CASE WHEN ai_news_id > 0 THEN url ELSE CASE -ai_news_id % 6 WHEN 0 THEN 'https:' || url WHEN 1 THEN CASE WHEN pos < 2 THEN 'https://site.example.org/x/' || url ELSE 'https://' || url END
  WHEN 2 THEN CASE WHEN pos < 2 THEN 'https://site.example.org' || url END WHEN 3 THEN NULL WHEN 4 THEN CASE WHEN -ai_news_id % 900 + 100 < 720 THEN 'https://ichef.bbci.co.uk/news/1024/p.jpg' ELSE url END ELSE url END END AS absolute FROM img""", IMG)

CANON = f"(regexp_replace(lower({D.url_part('url', 2)}), '^www\\.', '') || coalesce(nullif(regexp_replace(lower({D.url_part('url', 3)}), '/+', '/', 'g'), ''), '/') || CASE WHEN contains(url, '&id=7') THEN '?id=7' ELSE '' END)"
VISUAL = f"(regexp_replace(lower({D.url_part('url', 2)}), '^www\\.', '') || regexp_replace(lower({D.url_part('url', 3)}), '_[0-9]{{2,4}}x[0-9]{{2,4}}\\.', '_{{size}}.'))"
register("image_keys", lambda t: shape(images.image_keys(t.v_images)), "v_images", f"SELECT ai_news_id, pos, url, {CANON} AS canonical_key, {VISUAL} AS visual_key FROM v_images")
register("unique_images_across_posts", lambda t: shape(images.unique_images_across_posts(t.v_images)), "v_images", f"""
SELECT ai_news_id, pos, url, canonical_key FROM (SELECT *, row_number() OVER (PARTITION BY ai_news_id ORDER BY pos) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY canonical_key ORDER BY ai_news_id, pos) AS rn FROM (SELECT *, {CANON} AS canonical_key FROM v_images)) WHERE rn = 1) WHERE n <= 4""")


def _variants(t):
    """Every image in three sizes of the same picture, as positions 0 to 11."""
    def sized(k, size):
        return t.v_images.select("ai_news_id", (F.col("pos") + 4 * k).alias("pos"), F.regexp_replace("url", r"_\d+x\d+\.", f"_{size}.").alias("url"))
    return sized(0, "640x360").unionByName(sized(1, "1920x1080")).unionByName(sized(2, "800x450"))


VARS = "vs AS (" + " UNION ALL ".join(
    f"SELECT ai_news_id, pos + {4 * k} AS pos, regexp_replace(url, '_[0-9]+x[0-9]+\\.', '_{s}.') AS url, CAST({a} AS BIGINT) AS area FROM v_images"
    for k, (s, a) in enumerate((("640x360", 640 * 360), ("1920x1080", 1920 * 1080), ("800x450", 800 * 450)))) + ")"
register("best_image_variant", lambda t: shape(images.best_image_variant(_variants(t)).select("ai_news_id", "group_pos", "pos", "url", "area")), "v_images", f"""
SELECT ai_news_id, row_number() OVER (PARTITION BY ai_news_id ORDER BY fp) AS group_pos, pos, url, area FROM (
  SELECT *, row_number() OVER (PARTITION BY ai_news_id, k ORDER BY CASE WHEN pos IN (0, 1) THEN 0 ELSE 1 END, area DESC, pos) AS rn, min(pos) OVER (PARTITION BY ai_news_id, k) AS fp
  FROM (SELECT *, {VISUAL} AS k FROM vs)) WHERE rn = 1""", VARS)


def _topical(t):
    """Images with the persona plus the word img as topic; every third post names the image host as its source."""
    posts = t.v_ai_news.select(
        "ai_news_id", F.concat_ws(" ", F.col("target_persona"), F.when(F.col("ai_news_id") % 2 == 0, "img jpg")).alias("topic"),
        F.when(F.col("ai_news_id") % 3 == 0, "https://example.com/a").when(F.col("ai_news_id") % 3 == 1, F.col("source_url")).alias("source_url"),
        F.when(F.col("ai_news_id") % 5 == 0, F.lit("Nature and sports photo")).alias("context"))
    return images.rank_images(t.v_images.join(posts, "ai_news_id"))


TOKENS = f"""list_filter(string_split(regexp_replace(target_persona || CASE WHEN ai_news_id % 2 = 0 THEN ' img jpg' ELSE '' END, '[^a-z]+', ' ', 'g'), ' '), lambda w: len(w) >= 3 AND w NOT IN {D.lst(images.TOPIC_STOPWORDS)})"""
# runs of words never occur in an address or context here, so single words decide
RANKIMG = f"""tp AS (SELECT ai_news_id, {TOKENS} AS tk, CASE WHEN ai_news_id % 3 = 0 THEN 'example.com' WHEN ai_news_id % 3 = 1 THEN regexp_extract(source_url, '//([^/]+)', 1) END AS dom,
  CASE WHEN ai_news_id % 5 = 0 THEN 'nature and sports photo' ELSE '' END AS ctx FROM v_ai_news),
im AS (SELECT * FROM v_images JOIN tp USING (ai_news_id)), {DIMS.replace('{src}', 'im')},
ri AS (SELECT *, len(list_filter(tk, lambda x: contains(lower({D.url_part('url', 2)}) || ' ' || pq, x))) AS uh, len(list_filter(tk, lambda x: contains(ctx, x))) AS ch, {NEWS_PHOTO} AS photo,
  coalesce(contains(lower({D.url_part('url', 2)}), dom), FALSE) AS own, contains(lo || ' ' || ctx, 'nature') AS stock FROM dim),
rs AS (SELECT *, round(CASE WHEN own THEN 60.0::DOUBLE ELSE 0 END + CASE WHEN photo THEN 30.0::DOUBLE ELSE 0 END + CASE WHEN w0 >= 1600 THEN 18.0::DOUBLE WHEN w0 >= 1280 THEN 14 WHEN w0 >= 1024 THEN 10 WHEN w0 >= 720 THEN 6 ELSE 0 END
  + CASE WHEN w0 * h >= 1440000 THEN 12.0::DOUBLE WHEN w0 * h >= 921600 THEN 8 WHEN w0 * h >= 589824 THEN 5 ELSE 0 END + CASE WHEN h >= 900 THEN 8.0::DOUBLE WHEN h >= 720 THEN 6 WHEN h >= 480 THEN 3 WHEN h >= 400 THEN 1.5 ELSE 0 END
  + least(uh * 4.0::DOUBLE, 20.0::DOUBLE) + least(ch * 6.0::DOUBLE, 30.0::DOUBLE) + CASE WHEN stock AND uh = 0 AND ch = 0 THEN -30.0::DOUBLE WHEN stock THEN -10.0::DOUBLE ELSE 0 END
  + CASE WHEN dom IS NULL AND uh = 0 AND ch = 0 THEN -8.0::DOUBLE ELSE 0 END - pos * 0.05::DOUBLE, 4) AS score FROM ri),
rk AS (SELECT *, row_number() OVER (PARTITION BY ai_news_id ORDER BY score DESC, pos) AS image_rank FROM rs)"""
register("rank_images", lambda t: shape(_topical(t).select("ai_news_id", "pos", "score", "image_rank")), "v_ai_news v_images", "SELECT ai_news_id, pos, score, image_rank FROM rk", RANKIMG)
register("diverse_images", lambda t: shape(images.diverse_images(_topical(t)).select("ai_news_id", "place", "pos", "url")), "v_ai_news v_images", f"""
SELECT ai_news_id, place, pos, url FROM (SELECT *, row_number() OVER (PARTITION BY ai_news_id ORDER BY CASE WHEN dn <= 2 THEN 0 ELSE 1 END, image_rank) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY ai_news_id, lower({D.url_part('url', 2)}) ORDER BY image_rank) AS dn FROM rk WHERE len(tk) = 0 OR uh > 0 OR ch > 0 OR (own AND photo))) WHERE place <= 4""", RANKIMG)


def _pictured(t):
    i = F.col("page_id").cast("string")
    head = (
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<meta property="og:image" content="https://cdn.example.com/p/'), i, F.lit('.jpg">')))
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit('<img src="/img/logo.png"><img src="/pic/s.jpg" width="90"><img src="/pic/'), i, F.lit('.jpg" width="640">')))
        .otherwise(F.concat(F.lit('<img srcset="/s/'), i, F.lit("-640.jpg 640w, /s/"), i, F.lit('-320.jpg 320w" src="/s/'), i, F.lit('-320.jpg">')))
    )
    return pages.page_images(t.pages.select("page_id", "url", F.concat(head, "html").alias("html")))


register("page_images", lambda t: shape(_pictured(t)), "", f"""
SELECT page_id, CAST(0 AS BIGINT) AS pos, 'meta' AS kind, 'https://cdn.example.com/p/' || page_id || '.jpg' AS image_url, TRUE AS chosen FROM po WHERE page_id % 3 = 0
UNION ALL SELECT page_id, 1, 'blob', 'https://cdn.example.com/p/' || page_id || '.jpg', FALSE FROM po WHERE page_id % 3 = 0
UNION ALL SELECT page_id, 0, 'img', o || '/img/logo.png', FALSE FROM po WHERE page_id % 3 = 1
UNION ALL SELECT page_id, 1, 'img', o || '/pic/' || page_id || '.jpg', NOT bad FROM po WHERE page_id % 3 = 1
UNION ALL SELECT page_id, 0, 'srcset', o || '/s/' || page_id || '-640.jpg', NOT bad FROM po WHERE page_id % 3 = 2
UNION ALL SELECT page_id, 1, 'img', o || '/s/' || page_id || '-320.jpg', FALSE FROM po WHERE page_id % 3 = 2""",
         f"po AS (SELECT page_id, {D.url_part('url', 1)} || '://' || {D.url_part('url', 2)} AS o, {D.any_of('lower(url)', I.REJECTED_WORDS)} AS bad FROM pages)")
