"""Queries over landed pages.

The pages carry no dates, images or JSON-LD.  Queries that need them read
pages to which head tags were added from the page's own columns, by Spark and
by the oracle alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import duck as D
from newsloom.catalog.base import register, shape, ts
from newsloom.catalog.events import NOW
from newsloom.functions import html as H
from newsloom.operators import pages

HIDDEN = D.q(H.HIDDEN)


def inner(x: str) -> str:
    return D.strip(D.collapse(D.unescape(f"regexp_replace({x}, '<[^>]+>', ' ', 'g')")))


def visible(x: str) -> str:
    return inner(f"regexp_replace({x}, {HIDDEN}, ' ', 'g')")


def host(x: str) -> str:
    return f"regexp_replace(lower({D.url_part(x, 2)}), '^www\\.', '')"


def meta(x: str, names) -> str:
    marker = D.q(rf"(?is)\s(?:property|name|itemprop)\s*=\s*[\"'](?:{'|'.join(names)})[\"']")
    tag = f"list_filter(regexp_extract_all({x}, {D.q(H.META_TAG)}), lambda m: regexp_matches(m, {marker}))[1]"
    content = D.q(r"(?is)\scontent\s*=\s*[\"']([^\"']*)[\"']")
    return f"nullif(trim(regexp_extract({tag}, {content}, 1)), '')"


# --- pages with head tags made from their own columns ---------------------------------------
# page_id % 8: 0-1 JSON-LD date, 2 meta date, 3 time tag, 4 words, 5 hours ago, 6 mail date, 7 nothing
_DAY = "2024-01-"


def _tagged(t):
    i = F.col("page_id")
    day = F.lpad((i % 31 + 1).cast("string"), 2, "0")
    ld = F.concat(F.lit('<script type="application/ld+json">{"@context":"https://schema.org","@type":"NewsArticle","datePublished":"2024-01-'), day, F.lit('T12:34:00+05:00"}</script>'))
    og = F.lit('<meta property="og:type" content="article"><meta name="twitter:image" content="/pic/'), i.cast("string"), F.lit('.jpg?w=1">')
    tags = (
        F.when(i % 8 <= 1, ld)
        .when(i % 8 == 2, F.concat(F.lit('<meta property="article:published_time" content="2024-01-'), day, F.lit('T10:00:00+05:00">'), *og))
        .when(i % 8 == 3, F.concat(F.lit('<time datetime="2024-01-'), day, F.lit('T08:00:00">08:00</time>'), *og))
        .when(i % 8 == 4, F.concat(F.lit('<div class="date">сегодня 12:30</div>'), *og))
        .when(i % 8 == 5, F.concat(F.lit("<time>"), (i % 40).cast("string"), F.lit(" soat oldin</time>"), *og))
        .when(i % 8 == 6, F.concat(F.lit('<meta name="pubdate" content="Tue, 30 Jan 2024 '), F.lpad((i % 24).cast("string"), 2, "0"), F.lit(':15:00 +0300">'), *og))
        .otherwise("")
    )
    return t.pages.select("page_id", "url", F.concat(tags, "html").alias("html"))


TAGGED = """tagged AS (SELECT page_id, url, CASE
    WHEN page_id % 8 <= 1 THEN '<script type="application/ld+json">{"@context":"https://schema.org","@type":"NewsArticle","datePublished":"2024-01-' || day || 'T12:34:00+05:00"}</script>'
    WHEN page_id % 8 = 2 THEN '<meta property="article:published_time" content="2024-01-' || day || 'T10:00:00+05:00">' || og
    WHEN page_id % 8 = 3 THEN '<time datetime="2024-01-' || day || 'T08:00:00">08:00</time>' || og
    WHEN page_id % 8 = 4 THEN '<div class="date">сегодня 12:30</div>' || og
    WHEN page_id % 8 = 5 THEN '<time>' || page_id % 40 || ' soat oldin</time>' || og
    WHEN page_id % 8 = 6 THEN '<meta name="pubdate" content="Tue, 30 Jan 2024 ' || lpad(CAST(page_id % 24 AS VARCHAR), 2, '0') || ':15:00 +0300">' || og ELSE '' END || html AS html
  FROM (SELECT *, lpad(CAST(page_id % 31 + 1 AS VARCHAR), 2, '0') AS day,
    '<meta property="og:type" content="article"><meta name="twitter:image" content="/pic/' || page_id || '.jpg?w=1">' AS og FROM pages))"""
# the instant each kind of tag stands for, computed from the page id alone; a clock
# time outside an ISO date reads as today's local time, mail-style dates included
DATED = f"""dated AS (SELECT *, CASE
    WHEN page_id % 8 <= 1 THEN make_timestamp(2024, 1, page_id % 31 + 1, 7, 34, 0)
    WHEN page_id % 8 = 2 THEN make_timestamp(2024, 1, page_id % 31 + 1, 5, 0, 0)
    WHEN page_id % 8 = 3 THEN make_timestamp(2024, 1, page_id % 31 + 1, 3, 0, 0)
    WHEN page_id % 8 = 4 THEN TIMESTAMP '2024-01-31 07:30:00'
    WHEN page_id % 8 = 5 THEN {NOW} - to_hours(page_id % 40)
    WHEN page_id % 8 = 6 THEN make_timestamp(2024, 1, 31, page_id % 24, 15, 0) - INTERVAL 5 HOUR END AS published_at FROM tagged)"""
SCORE = f"""sc AS (SELECT *, len({visible('html')}) AS text_len,
  len(list_filter(regexp_extract_all(html, {D.q(H.JSON_LD)}, 1), lambda b: json_valid(b) AND regexp_matches(b, {D.q(H.ARTICLE_TYPES)}))) > 0 AS has_json_ld,
  lower(coalesce({meta('html', ['og:type'])}, '')) AS og_type, {D.any_of('lower(url)', pages.BAD_URL_PARTS)} AS is_bad_url FROM dated),
scored AS (SELECT *, CAST(CASE WHEN has_json_ld THEN 2 ELSE 0 END + CASE WHEN og_type = 'article' THEN 2 ELSE 0 END + CASE WHEN text_len > 1000 THEN 1 ELSE 0 END - CASE WHEN is_bad_url THEN 2 ELSE 0 END AS BIGINT) AS score FROM sc)"""
PARAS = f"""list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(html, {HIDDEN}, ' ', 'g'), '(?is)<p(?:\\s[^>]*)?>', '</p><p>', 'g'), '(?is)<p>(.*?)(?:</p>|$)', 1),
  lambda p: {inner('p')}), lambda p: len(p) > 50)"""
FIELDS = f"""fields AS (SELECT *, coalesce({meta('html', ['og:title'])}, nullif({D.strip(D.unescape(f"regexp_extract(html, {D.q(H.TITLE)}, 1)"))}, ''), nullif({inner(f"regexp_extract(html, {D.q(H.H1)}, 1)")}, '')) AS title,
  nullif({inner(f"regexp_extract(html, {D.q(H.H1)}, 1)")}, '') AS h1, array_to_string({PARAS}, chr(10) || chr(10)) AS body FROM scored)"""

register("page_links", lambda t: shape(pages.page_links(t.pages)), "", f"""
SELECT page_id, CAST(pos - 1 AS BIGINT) AS pos, link FROM (SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY first) AS pos FROM (
  SELECT page_id, link, min(i) AS first FROM (
    SELECT page_id, i, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN h WHEN starts_with(h, '//') THEN {D.url_part('url', 1)} || ':' || h
      WHEN starts_with(h, '/') THEN {D.url_part('url', 1)} || '://' || {D.url_part('url', 2)} || h
      ELSE {D.url_part('url', 1)} || '://' || {D.url_part('url', 2)} || regexp_replace({D.url_part('url', 3)}, '[^/]*$', '') || h END AS link, url
    FROM (SELECT page_id, url, {D.strip('unnest(hs)')} AS h, generate_subscripts(hs, 1) AS i FROM (SELECT page_id, url, regexp_extract_all(html, {D.q(H.HREF)}, 1) AS hs FROM pages))
    WHERE h <> '' AND NOT regexp_matches(h, {D.q(pages.NON_ARTICLE_HREF)}))
  WHERE {host('link')} = {host('url')} GROUP BY 1, 2))""")


def _slugged(t):
    """Page addresses, and longer ones made from them: dated, listing, slug and file forms."""
    i = F.col("page_id")
    made = (
        F.when(i % 6 == 0, F.concat(F.lit("https://kun.uz/news/2024/01/"), F.lpad((i % 28 + 1).cast("string"), 2, "0"), F.lit("/story-"), i.cast("string")))
        .when(i % 6 == 1, F.concat(F.lit("https://www.gazeta.uz/ru/list/"), i.cast("string")))
        .when(i % 6 == 2, F.concat(F.lit("https://uznews.uz/ru/news/"), i.cast("string")))
        .when(i % 6 == 3, F.concat(F.lit("https://site.example.org/a/b/long-slug-"), i.cast("string")))
        .when(i % 6 == 4, F.concat(F.lit("https://site.example.org/category/"), i.cast("string"), F.lit("/x.html")))
        .otherwise(F.concat(F.lit("https://podrobno.uz/cat/politics/"), i.cast("string"), F.lit("/")))
    )
    return t.pages.select("page_id", "url").unionByName(t.pages.select((-i - 1).alias("page_id"), made.alias("url")))


register("article_url_flag", lambda t: shape(_slugged(t).withColumn("is_article", pages.article_url_flag(F.col("url")))), "", """
SELECT page_id, url, CASE WHEN page_id < 0 THEN (-page_id - 1) % 6 IN (0, 2, 3)
  ELSE NOT regexp_matches(p, '(?i)/(list|tag|category|page|section)(/|$)') AND (regexp_matches(p, '\\.html?$')
    OR (len(s) >= 3 AND (contains(s[-1], '-') OR regexp_matches(s[-1], '\\d') OR len(s[-1]) > 20))) END AS is_article
FROM (SELECT *, list_filter(string_split(p, '/'), lambda x: x <> '') AS s FROM (SELECT *, regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1) AS p FROM slugged))""",
         """slugged AS (SELECT page_id, url FROM pages UNION ALL SELECT -page_id - 1, CASE page_id % 6 WHEN 0 THEN 'https://kun.uz/news/2024/01/' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') || '/story-' || page_id
  WHEN 1 THEN 'https://www.gazeta.uz/ru/list/' || page_id WHEN 2 THEN 'https://uznews.uz/ru/news/' || page_id WHEN 3 THEN 'https://site.example.org/a/b/long-slug-' || page_id
  WHEN 4 THEN 'https://site.example.org/category/' || page_id || '/x.html' ELSE 'https://podrobno.uz/cat/politics/' || page_id || '/' END FROM pages)""")

register("article_page_score",
         lambda t: shape(pages.article_page_score(_tagged(t)).select("page_id", "text_len", "has_json_ld", "og_type", "is_bad_url", "score", "is_article")),
         "", "SELECT page_id, text_len, has_json_ld, og_type, is_bad_url, score, score >= 2 AS is_article FROM scored", f"{TAGGED}, {DATED}, {SCORE}")


# --- pages of known sites and of every fallback, made around the visible text of each page --------
# kind by page_id % 6: 0-2 pages of sites, 3 blocks without paragraphs, 4 short paragraphs
# without blocks, 5 pictures only.  Parts: address, then what comes before the text, after it,
# with # for the id
_MADE = (
    ("https://www.gazeta.uz/ru/2024/01/05/n#/", "<title>Site</title><h1>First</h1><div class='top'><p>This paragraph of a side column is longer than fifty characters.</p></div>"
     "<h1 class='big article__title'>Title #</h1><section class='x article__content y'><section><p>", "</p></section><p>short</p></section><p>Another long paragraph that stands after the article's own.</p>"
     "<img src='/img/small.png'><img src='/img/photo-#.jpg?x=1' width='800'>"),
    ("https://daryo.uz/n#", "<title>Name #</title><div>menu</div><article><b>", "</b></article><footer>end</footer><img src='/img/a.jpg'><figure class='f'><img data-src='//cdn.example.org/#.webp'></figure>"),
    ("https://kun.uz/news/n#", "<meta property='og:title' content='Head #'><h1>H</h1><DIV class='article-text'><div>a</div><p>", "</p></DIV><p>This paragraph of a side column is longer than fifty characters.</p>"),
    ("https://site.example.org/a/n#", "<h1>Only #</h1><div>short</div><div class='main'><div>", "</div> end</div><div>tail</div><img srcset='b/1.jpg 400w, b/#.jpg 800w'>"),
    ("https://site.example.org/b/n#", "<p>one <i>two</i></p><p>three</p><span>", "</span><img src='/logo.jpg'>"),
    ("https://site.example.org/c/n#", "<img width='80' src='/img/tiny.jpg'><!-- ", " -->"),
)


def _plain(html):
    return F.regexp_replace(H.visible_text(html), "[<>&-]", "")


def _fallback_pages(t):
    i = F.col("page_id")
    kind = (i % len(_MADE) + 1).cast("int")

    def part(k):
        return F.replace(F.element_at(F.array(*[F.lit(m[k]) for m in _MADE]), kind), F.lit("#"), i.cast("string"))

    return t.pages.select("page_id", part(0).alias("url"), F.concat(part(1), _plain(F.col("html")), part(2)).alias("html"))


FALLBACKS = f"""made AS (SELECT page_id, page_id AS i, page_id % 6 AS kind, {D.strip(D.collapse(f"regexp_replace({visible('html')}, '[<>&-]', '', 'g')"))} AS x FROM pages),
expected AS (SELECT page_id,
  CASE kind WHEN 0 THEN 'Title ' || i WHEN 1 THEN 'Name ' || i WHEN 2 THEN 'Head ' || i WHEN 3 THEN 'Only ' || i END AS title,
  CASE kind WHEN 0 THEN 'First' WHEN 2 THEN 'H' WHEN 3 THEN 'Only ' || i END AS h1,
  CASE kind WHEN 0 THEN CASE WHEN len(x) > 40 THEN x WHEN x = '' THEN 'short' ELSE x || chr(10) || chr(10) || 'short' END
    WHEN 1 THEN CASE WHEN x = '' THEN 'menu' ELSE x END WHEN 2 THEN CASE WHEN x = '' THEN 'a' ELSE x END
    WHEN 3 THEN CASE WHEN x = '' THEN 'short' ELSE x || ' end' END WHEN 4 THEN 'one two' || chr(10) || chr(10) || 'three' ELSE '' END AS body,
  CASE kind WHEN 0 THEN 'https://www.gazeta.uz/img/photo-' || i || '.jpg' WHEN 1 THEN 'https://cdn.example.org/' || i || '.webp'
    WHEN 3 THEN 'https://site.example.org/a/b/' || i || '.jpg' WHEN 5 THEN 'https://site.example.org/img/tiny.jpg' END AS image_url FROM made)"""
FIELD_NAMES = ("page_id", "title", "h1", "body", "image_url")
register("page_fields", lambda t: shape(pages.page_fields(_tagged(t)).select(*FIELD_NAMES)), "",
         f"SELECT page_id, title, h1, body, CASE WHEN page_id % 8 BETWEEN 2 AND 6 THEN {D.url_part('url', 1)} || '://' || {D.url_part('url', 2)} || '/pic/' || page_id || '.jpg' END AS image_url FROM fields",
         f"{TAGGED}, {DATED}, {SCORE}, {FIELDS}")
register("page_fields_sites", lambda t: shape(pages.page_fields(_fallback_pages(t)).select(*FIELD_NAMES)), "",
         "SELECT page_id, title, h1, body, image_url FROM expected", FALLBACKS)

CLEANED = """regexp_replace({0}, '\\S+@\\S+', '', 'g')"""


def _clean_boilerplate(x: str) -> str:
    t = CLEANED.format(x)
    for marker in pages.CUT_MARKERS:
        t = f"split_part({t}, {D.q(marker)}, 1)"
    for phrase in pages.REMOVED_PHRASES:
        t = f"replace({t}, {D.q(phrase)}, '')"
    return D.strip(D.collapse(t))


UI = D.any_of("lower(p)", [x.lower() for x in pages.UI_PHRASES])
# the oracle leaves legal notices out: no text of the tables holds one
BOILER = f"""bl AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), lambda p: {D.strip('p')}), lambda p: p <> '') AS ls FROM documents),
bp AS (SELECT doc_id, text, CASE WHEN len(ls) > 1 THEN ls ELSE {D.sentences('text')} END AS ps FROM bl),
bx AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM bp),
bf AS (SELECT *, NOT {UI} AS ok, coalesce(min(CASE WHEN NOT {UI} AND len(p) > 100 THEN i END) OVER (PARTITION BY doc_id), 1) AS st FROM bx),
bj AS (SELECT doc_id, string_agg(p, ' ' ORDER BY i) FILTER (rn <= 6) AS a FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM bf WHERE ok AND i >= st) GROUP BY 1),
bk AS (SELECT doc_id, string_agg(p, ' ' ORDER BY i) FILTER (rn <= 6) AS b FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM bf WHERE ok) GROUP BY 1),
bc AS (SELECT d.doc_id, {_clean_boilerplate("coalesce(a, '')")} AS a, {_clean_boilerplate("coalesce(b, '')")} AS b, {_clean_boilerplate('text')} AS c FROM documents d LEFT JOIN bj USING (doc_id) LEFT JOIN bk USING (doc_id))"""
register("boilerplate_filter",
         lambda t: shape(t.documents.select("doc_id", pages.boilerplate_filter(F.col("text")).alias("body"), pages.good_paragraph(F.col("text")).alias("good"))),
         "", """SELECT doc_id, CASE WHEN len(a) >= 200 THEN a WHEN len(b) >= 200 THEN b WHEN len(c) >= 200 THEN c ELSE '' END AS body,
  (SELECT len(trim(text)) >= 50 AND NOT contains(lower(text), 'cookie') AND NOT contains(text, '©') FROM documents x WHERE x.doc_id = bc.doc_id) AS good FROM bc""", BOILER)

register("publish_date", lambda t: shape(_tagged(t).select("page_id", pages.publish_date(F.col("html"), t.as_of).alias("published_at"))),
         "", f"SELECT page_id, {ts('published_at')} AS published_at FROM dated", f"{TAGGED}, {DATED}")
register("published_on_day", lambda t: shape(pages.published_on_day(t.v_events, F.lit("2024-01-15 12:00:00").cast("timestamp")).select("event_id", "created_at")), "v_events",
         f"SELECT event_id, {ts('created_at')} AS created_at FROM v_events WHERE CAST(v_events.created_at + INTERVAL 5 HOUR AS DATE) = DATE '2024-01-15'")
register("hash_sample", lambda t: shape(pages.hash_sample(t.pages.select("page_id", "url"), "url")), "",
         "SELECT page_id, url FROM pages WHERE ('0x' || substr(sha256(url), 1, 2))::INT / 255.0 < 0.2")

AD = """any_kw OR (nav AND cm) OR mk OR (rights AND (ish OR nav))"""


def _ad(text: str) -> str:
    return f"""(SELECT {D.any_of('x', pages.AD_KEYWORDS)} OR ({D.any_of('x', pages.NAV_MARKERS)} AND {D.any_of('x', ("izoh", "ro'yxatdan", "ro‘yxatdan"))})
  OR {D.any_of('x', ('ishlab chiquvchi', 'ishlab chiqaruvchi'))} OR ({D.any_of('x', ('©', 'copyright'))} AND ({D.any_of('x', ('ishlab', 'izoh'))} OR {D.any_of('x', pages.NAV_MARKERS)})) FROM (SELECT lower({text}) AS x))"""


register("ad_flag", lambda t: shape(t.documents.select("doc_id", pages.ad_flag(F.col("text"), F.substring("text", 1, 60)).alias("is_ad"))), "",
         f"SELECT doc_id, {_ad(chr(116) + 'ext')} AS is_ad FROM documents")
register("js_rendered_flag", lambda t: shape(t.pages.select("page_id", pages.js_rendered_flag(F.col("html")).alias("js_rendered"))), "",
         f"SELECT page_id, s > a * 3 OR (a < 5 AND n < 200) AS js_rendered FROM (SELECT page_id, len(regexp_extract_all(html, '(?i)<script[\\s>]')) AS s, len(regexp_extract_all(html, '(?i)<a[\\s>]')) AS a, len({visible('html')}) AS n FROM pages)")


def _redirected(t):
    from newsloom.functions.urls import normalize_source_url

    final = F.when(F.col("page_id") % 10 == 0, H.origin(F.col("url"))).otherwise(normalize_source_url(F.col("url")))
    return pages.redirect_flags(t.pages.withColumn("final_url", final), "final_url")


register("redirect_flags", lambda t: shape(_redirected(t).select("page_id", "final_url", "to_home", "shortened", "looks_home")), "", f"""
SELECT page_id, f AS final_url, {host('url')} = {host('f')} AND regexp_replace({D.url_part('f', 3)}, '/+$', '') = '' AS to_home, len({D.url_part('f', 3)}) < len({D.url_part('url', 3)}) AS shortened,
  len(regexp_extract_all(html, '(?i)<a[\\s>]')) > 100 AND len(list_filter(regexp_extract_all(html, '(?is)<p(?:\\s[^>]*)?>([^<]*)', 1), lambda p: trim(p) <> '')) < 10 AS looks_home
FROM (SELECT *, CASE WHEN page_id % 10 = 0 THEN {D.url_part('url', 1)} || '://' || {D.url_part('url', 2)} ELSE {D.normalize_source_url('url')} END AS f FROM pages)""")

FUNNEL = f"""{TAGGED}, {DATED}, {SCORE}, {FIELDS},
fun AS (SELECT page_id, CASE WHEN html = '' THEN 'no_html' WHEN score < 2 THEN 'not_article' WHEN len(body) < 300 THEN 'short' WHEN {_ad("body || ' ' || coalesce(title, '')")} THEN 'ad'
  WHEN published_at IS NULL THEN 'no_date' WHEN CAST(published_at + INTERVAL 5 HOUR AS DATE) <> DATE '2024-01-31' THEN 'not_today' ELSE 'ok' END AS reason FROM fields)"""
register("page_funnel", lambda t: shape(pages.page_funnel(_tagged(t), t.as_of).select("page_id", "reason")), "", "SELECT page_id, reason FROM fun", FUNNEL)
register("page_funnel_counts", lambda t: shape(pages.funnel_counts(pages.page_funnel(_tagged(t), t.as_of))), "", "SELECT reason, count(*) AS pages FROM fun GROUP BY 1", FUNNEL)
