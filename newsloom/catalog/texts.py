"""Queries over article text."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import duck as D
from newsloom.catalog.base import register, shape
from newsloom.functions import lexicon as L
from newsloom.functions import texts as X
from newsloom.operators import metrics, text

SEP = "'¦'"


def join(x: str) -> str:
    return f"array_to_string({x}, {SEP})"


# RE2 word boundaries are ASCII, so letters beyond ASCII become digits first:
# they stay word characters and never match the letter classes.
def _ascii_words(x: str) -> str:
    return f"regexp_replace({x}, '[ªµºÀ-ÖØ-öø-ˁͰ-῿]', '0', 'g')"


LANG = f"""norm AS (SELECT ai_news_id, final_title, final_text, {D.apostrophes("coalesce(final_text, '')")} AS n FROM v_ai_news),
latin AS (SELECT *, lower(n) AS lo, regexp_extract_all({_ascii_words('lower(n)')}, '\\b[a-zA-Z''\\-]+\\b') AS latin FROM norm),
counted AS (SELECT *,
  len(regexp_extract_all(n, {D.q(L.CYRILLIC)})) AS cyrillic_total, len(regexp_extract_all(n, {D.q(L.UZBEK_CYRILLIC)})) AS cyrillic_uz,
  len(list_filter(latin, lambda w: regexp_matches(w, {D.q(L.UZBEK_LATIN_PATTERN)}))) AS uzbek_latin_hits,
  CAST({D.contained('lo', L.UZBEK_MARKERS)} AS BIGINT) AS uzbek_marker_hits,
  len(list_filter(latin, lambda w: w IN {D.lst(L.UZBEK_COMMON_WORDS)})) AS uzbek_common_hits,
  len(list_filter(latin, lambda w: w IN {D.lst(L.ENGLISH_TEXT_STOPWORDS)})) AS english_word_hits,
  len(list_filter(list_transform(string_split(regexp_replace({_ascii_words('lower(n)')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
      lambda s: regexp_extract_all(s, '\\b[a-zA-Z'']+\\b')),
    lambda ws: len(ws) >= 6 AND len(list_filter(ws, lambda w: w IN {D.lst(L.ENGLISH_TEXT_STOPWORDS)})) / len(ws) >= 0.22)) AS english_sentence_hits
  FROM latin),
scored AS (SELECT *, greatest(0, cyrillic_total - cyrillic_uz) AS cyrillic_ru,
  cyrillic_uz * 1.7::DOUBLE + uzbek_latin_hits * 7.0::DOUBLE + uzbek_marker_hits * 10.0::DOUBLE + uzbek_common_hits * 3.0::DOUBLE
    + greatest(0, cyrillic_total - cyrillic_uz) * 0.75::DOUBLE AS mixed_score,
  english_word_hits * 10.0::DOUBLE + english_sentence_hits * 20.0::DOUBLE AS english_score FROM counted),
ratios AS (SELECT *, english_score / greatest(1.0, mixed_score + english_score) AS english_ratio, mixed_score / greatest(1.0, mixed_score + english_score) AS uzbek_ratio,
  {D.language_hint('final_text')} AS language_hint,
  CASE WHEN final_text = '' THEN TRUE ELSE coalesce(len(list_filter({D.words('lo2')}, lambda w: trim(w, '.,!?;:') IN {D.lst(L.NOT_UZBEK_WORDS)})) / nullif(len({D.words('lo2')}), 0), 0) > 0.5 END AS not_uzbek,
  len(heavy) >= 4 AND len(list_filter(heavy, lambda w: w IN {D.lst(L.ENGLISH_TITLE_STOPWORDS)})) >= 2
    AND len(list_filter(heavy, lambda w: w IN {D.lst(L.ENGLISH_TITLE_STOPWORDS)})) / greatest(len(heavy), 1) >= 0.2 AS english_heavy
  FROM (SELECT *, lower(final_text) AS lo2, regexp_extract_all(lower(final_text), '[a-zA-Z'']+') AS heavy FROM scored))"""
LANG_COLS = ["cyrillic_total", "cyrillic_uz", "cyrillic_ru", "uzbek_latin_hits", "uzbek_marker_hits", "uzbek_common_hits",
             "english_word_hits", "english_sentence_hits", "mixed_score", "english_score", "language_hint", "not_uzbek", "english_heavy"]
register("language_scores",
         lambda t: shape(text.language_scores(t.v_ai_news, "final_text").select("ai_news_id", *LANG_COLS, "english_ratio", "uzbek_ratio"),
                         english_ratio=6, uzbek_ratio=6, mixed_score=4),
         "v_ai_news", f"""SELECT ai_news_id, {', '.join(c for c in LANG_COLS if c != 'mixed_score')}, round(mixed_score, 4) AS mixed_score,
  round(english_ratio, 6) AS english_ratio, round(uzbek_ratio, 6) AS uzbek_ratio FROM ratios""", LANG)

TITLE = D.strip("coalesce(final_title, '')")
register("validate_articles",
         lambda t: shape(text.validate_articles(t.v_ai_news, "final_title", "final_text").select("ai_news_id", "title_rule", "text_rule", "reason")),
         "v_ai_news", f"""
SELECT ai_news_id, title_rule, text_rule, CASE WHEN final_title = '' OR final_text = '' THEN 'missing' WHEN title_rule IS NOT NULL THEN 'invalid_title'
  WHEN text_rule IS NOT NULL THEN 'invalid_text' WHEN len({D.strip('final_text')}) < 80 THEN 'too_short' WHEN not_uzbek THEN 'not_uzbek' ELSE 'ok' END AS reason
FROM (SELECT *, CASE WHEN {TITLE} = '' THEN 'empty' WHEN contains({TITLE}, 'Ã') THEN 'mojibake' WHEN contains({TITLE}, '<') AND contains({TITLE}, '>') THEN 'tags'
    WHEN len({D.words(TITLE)}) < 2 THEN 'few_words' WHEN len({D.words(TITLE)}) > 24 THEN 'many_words' WHEN len({TITLE}) > 220 THEN 'long' END AS title_rule,
  CASE WHEN final_text = '' THEN 'empty' WHEN {D.any_of('final_text', L.TEXT_MOJIBAKE)} THEN 'mojibake' WHEN contains(final_text, '<') AND contains(final_text, '>') THEN 'tags'
    WHEN {D.any_of('lower(final_text)', [p.lower() for p in L.FORBIDDEN_PHRASES])} THEN 'forbidden_phrase'
    WHEN len({D.words('final_text')}) < 50 THEN 'few_words' WHEN english_ratio >= 0.62 AND english_ratio > uzbek_ratio + 0.12 THEN 'english_dominant' END AS text_rule
  FROM ratios)""", LANG)

register("clean_text",
         lambda t: shape(t.pages.select("page_id", X.clean_text(F.col("html")).alias("cleaned"))
                         .unionByName(t.documents.select((-F.col("doc_id") - 1).alias("page_id"), X.clean_text(F.col("text")).alias("cleaned")))),
         "", f"SELECT page_id, {D.clean_text('html')} AS cleaned FROM pages UNION ALL SELECT -doc_id - 1, {D.clean_text('text')} FROM documents")

register("strip_artifacts", lambda t: shape(t.documents.select("doc_id", X.strip_artifacts(F.col("text")).alias("cleaned"))),
         "", f"SELECT doc_id, {D.strip_artifacts('text')} AS cleaned FROM documents")


def _embedding_text(t):
    a = t.v_ai_news.join(t.v_raw_news.select("raw_news_id", F.col("title").alias("raw_text")), "raw_news_id", "left")
    news = a.select(F.lit("article").alias("kind"), F.col("ai_news_id").alias("id"), text.article_embedding_text(
        F.col("final_title"), F.col("final_text"), F.col("category"), F.col("target_persona"), F.col("raw_text"), F.col("region")).alias("body"))
    users = t.v_users.select(F.lit("user").alias("kind"), F.col("user_id").alias("id"), text.user_embedding_text(
        F.col("interests"), F.col("location"), F.col("country_code"), F.col("username")).alias("body"))
    return news.unionByName(users)


NEWS_TEXT = D.normalize_text("""'title: ' || final_title || ' ' || chr(10) || 'category: ' || category || ' ' || chr(10) || 'persona: ' || target_persona || ' ' || chr(10)
    || 'region: ' || region || ' ' || chr(10) || 'body: ' || final_text || ' ' || chr(10) || 'source: ' || coalesce(title, '')""")
USER_TEXT = D.normalize_text("""array_to_string(list_filter(list_transform(list_concat(CAST(interests->'all_topics' AS VARCHAR[]),
    [interests->>'profession', location, country_code, username]), lambda p: lower(trim(p))), lambda p: p <> ''), ' ')""")
register("embedding_text", lambda t: shape(_embedding_text(t)), "v_ai_news v_raw_news v_users", f"""
SELECT 'article' AS kind, a.ai_news_id AS id, {NEWS_TEXT} AS body FROM v_ai_news a LEFT JOIN v_raw_news r USING (raw_news_id)
UNION ALL SELECT 'user', user_id, {USER_TEXT} FROM v_users""")

LOW = "lower(text)"
register("news_sentiment", lambda t: shape(t.documents.select("doc_id", text.news_sentiment(F.col("text")).alias("sentiment"))), "", f"""
SELECT doc_id, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS sentiment
FROM (SELECT doc_id, {D.contained(LOW, L.POSITIVE_MARKERS)} AS p, {D.contained(LOW, L.NEGATIVE_MARKERS)} AS n FROM documents)""")


def _quality_input(t):
    scored = t.documents.join(t.labels, "doc_id", "left")
    return scored.select("doc_id", "text", F.lit("uz").alias("geo"), F.concat_ws("|", F.lit("tech"), "lang").alias("persona"), F.col("quality").alias("model"))


TENS = "({0}) // 10 + CASE WHEN ({0}) % 10 > 5 OR (({0}) % 10 = 5 AND (({0}) // 10) % 2 = 1) THEN 1 ELSE 0 END"
QUALITY = f"""src AS (SELECT d.doc_id, text, 'uz' AS geo, 'tech|' || lang AS persona, quality AS model,
    {D.strip_artifacts('text')} AS clean, {D.strip_artifacts(D.strip_artifacts('text'))} AS cleaned FROM documents d LEFT JOIN labels l USING (doc_id)),
feats AS (SELECT *, lower(clean) AS lo, regexp_extract_all(lower(clean), '[\\p{{L}}\\p{{N}}_]+') AS ws, len({D.sentences('clean', '.!?;')}) AS ns,
    len({D.paragraphs('clean', 'cleaned')}) AS np, {D.contained("lower(text || ' ' || text)", L.POSITIVE_MARKERS)} AS pos, {D.contained("lower(text || ' ' || text)", L.NEGATIVE_MARKERS)} AS neg,
    {D.language_hint("(text || ' ' || persona || ' ' || geo)")} AS hint,
    list_filter(regexp_split_to_array(lower(persona), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: len(x) >= 3) AS pt FROM src),
quality AS (SELECT doc_id, model, clean, CASE WHEN pos > neg THEN 'positive' WHEN neg > pos THEN 'negative' ELSE 'neutral' END AS sentiment,
  least(2200, len(ws) * 2200 // 200)
  + CASE WHEN np >= 4 THEN 1800 WHEN np = 3 THEN 1200 ELSE 0 END
  + CASE WHEN hint <> 'ru' THEN 800 WHEN regexp_matches(clean, {D.q(L.CYRILLIC)}) THEN 1200 ELSE 200 END
  + CASE WHEN len(pt) = 0 OR len(list_filter(pt[1:4], lambda x: contains(lo, x))) > 0 THEN 1100 ELSE 0 END + 800
  + CASE WHEN NOT regexp_matches(text, '\\p{{Nd}}') OR regexp_matches(clean, '\\p{{Nd}}') THEN 1000 ELSE 0 END
  + CASE WHEN len(list_distinct(ws)) / greatest(len(ws), 1) BETWEEN 0.35 AND 0.78 THEN 900 ELSE 400 END
  + CASE WHEN len(ws) / greatest(ns, 1) BETWEEN 8.0 AND 26.0 THEN 800 ELSE 300 END
  + CASE WHEN regexp_matches(clean, '(?i)\\[\\+[0-9]+\\s+chars\\]|\\b(?:lid|yanglik)\\b') THEN 0 ELSE 800 END
  + CASE WHEN pos > neg AND {D.any_of('lo', L.CONGRATULATIONS)} THEN 800 WHEN neg > pos AND {D.any_of('lo', L.CONDOLENCES)} THEN 800
      WHEN pos = neg THEN 400 ELSE 0 END
  + CASE WHEN {D.any_of('lo', L.USER_FACT_PHRASES)} THEN 800 ELSE 0 END AS s FROM feats),
bounded AS (SELECT *, CASE WHEN clean = '' THEN 0 ELSE {TENS.format('least(10000, s)')} END AS q,
  CASE WHEN coalesce(nullif(model, 0), 7.5) BETWEEN 0 AND 1 THEN coalesce(nullif(model, 0), 7.5) * 10.0 ELSE coalesce(nullif(model, 0), 7.5) END AS m FROM quality)"""
register("quality_score",
         lambda t: shape(text.quality_score(_quality_input(t), "text", "text", "persona", "geo", "model").select("doc_id", "sentiment", "quality_score", "combined_score")),
         "", f"SELECT doc_id, sentiment, q / 100 AS quality_score, ({TENS.format('CAST(round(m * 100) AS BIGINT) * 4 + q * 6')}) / 100 AS combined_score FROM bounded", QUALITY)

CATEGORY = "CASE greatest({0}) WHEN 0 THEN 'other' {1} END".format(
    ", ".join(D.contained(LOW, k) for k in L.CATEGORY_KEYWORDS.values()),
    " ".join(f"WHEN {D.contained(LOW, k)} THEN '{n}'" for n, k in L.CATEGORY_KEYWORDS.items()))
register("classify_category", lambda t: shape(t.documents.select("doc_id", text.classify_category(F.col("text")).alias("category"))),
         "", f"SELECT doc_id, {CATEGORY} AS category FROM documents")

LEAD = f"array_to_string(({D.sentences(D.strip(D.collapse('text')))})[1:3], ' ')"
SUMMARY = f"""pieces AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]')) AS raw, generate_subscripts(regexp_split_to_array(text, '[.!?]'), 1) AS pos FROM documents),
long AS (SELECT doc_id, pos, {D.strip('raw')} AS s FROM pieces WHERE len({D.strip('raw')}) > 40),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len(list_filter(regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w NOT IN {D.lst(L.SUMMARY_STOPWORDS)})) DESC, pos) AS rn FROM long),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id, substr(s, 1, 50) ORDER BY pos) AS dup FROM ranked WHERE rn <= 3),
summ AS (SELECT doc_id, string_agg(s, '. ' ORDER BY pos) || '.' AS summary FROM top WHERE dup = 1 GROUP BY doc_id)"""
register("extractive_summary",
         lambda t: shape(t.documents.select("doc_id", text.lead_summary(F.col("text")).alias("lead"), text.extractive_summary(F.col("text")).alias("summary"))),
         "", f"SELECT d.doc_id, {LEAD} AS lead, CASE WHEN text = '' THEN '' ELSE coalesce(summary, {D.strip('substr(text, 1, 400)')} || '...') END AS summary FROM documents d LEFT JOIN summ USING (doc_id)",
         SUMMARY)

FACTS = f"""fs AS (SELECT doc_id, {D.sentences('c', '.!?;')} AS ss FROM (SELECT doc_id, {D.strip_artifacts('text')} AS c FROM documents)),
fx AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS pos FROM fs),
fr AS (SELECT doc_id, lower(s) AS k, arg_min(s, (o, pos)) AS s, min((o, pos)) AS o FROM (
  SELECT *, CASE WHEN regexp_matches(s, '\\p{{Nd}}') OR {D.any_of('lower(s)', L.QUANTITY_TOKENS)} THEN 0 ELSE 1 END AS o FROM fx) GROUP BY 1, 2),
fn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS rn FROM fr)"""
register("fact_sentences",
         lambda t: shape(t.documents.select("doc_id", text.fact_sentences(F.col("text")).alias("facts"),
                                            text.user_fact(F.col("text"), F.lit("tion"), F.lit("en")).alias("user_fact"))),
         "", f"""SELECT d.doc_id, coalesce(facts, '') AS facts, 'Relevant fact for you: ' || coalesce(named, first_fact, {D.q(L.FACT_PREFIXES['en'][1])}) AS user_fact
FROM documents d LEFT JOIN (SELECT doc_id, string_agg(s, {SEP} ORDER BY rn) FILTER (rn <= 3) AS facts, arg_min(s, rn) FILTER (rn <= 5 AND contains(lower(s), 'tion')) AS named,
  arg_min(s, rn) AS first_fact FROM fn GROUP BY 1) f USING (doc_id)""", FACTS)

PHRASES = f"""pc AS (SELECT ai_news_id, {D.strip_artifacts("final_title || ' ' || final_text")} AS src FROM v_ai_news),
px AS (SELECT ai_news_id, unnest(cs) AS c, generate_subscripts(cs, 1) AS pos FROM (SELECT ai_news_id, regexp_split_to_array(src, '[.!?;\\n\\r]+') AS cs FROM pc)),
ph AS (SELECT ai_news_id, pos, array_to_string((list_filter(string_split(c, ' '), lambda w: w <> ''))[1:8], ' ') AS p FROM (
  SELECT ai_news_id, pos, trim({D.collapse('c')}, ' -,:;') AS c FROM px) WHERE len(c) >= 8),
pd AS (SELECT *, row_number() OVER (PARTITION BY ai_news_id ORDER BY pos) AS rn FROM (
  SELECT ai_news_id, lower(p), arg_min(p, pos) AS p, min(pos) AS pos FROM ph WHERE p <> '' GROUP BY 1, 2))"""
register("topic_phrases",
         lambda t: shape(t.v_ai_news.select("ai_news_id", text.topic_phrases(F.col("final_title"), F.col("final_text"), F.col("category")).alias("phrases"))),
         "v_ai_news", f"SELECT a.ai_news_id, coalesce(p, trim(category)) AS phrases FROM v_ai_news a LEFT JOIN (SELECT ai_news_id, string_agg(p, {SEP} ORDER BY rn) AS p FROM pd WHERE rn <= 6 GROUP BY 1) x USING (ai_news_id)",
         PHRASES)

register("top_keywords", lambda t: shape(text.top_keywords(t.documents, "doc_id", "text")), "", f"""
SELECT doc_id, keyword, cnt, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, first_pos) AS rank FROM (
  SELECT doc_id, keyword, count(*) AS cnt, min(pos) AS first_pos FROM (
    SELECT doc_id, unnest(ks) AS keyword, generate_subscripts(ks, 1) AS pos FROM (SELECT doc_id, {D.keyword_words('text')} AS ks FROM documents)) GROUP BY 1, 2)) WHERE rank <= 6""")
register("title_keys", lambda t: shape(t.v_ai_news.select("ai_news_id", text.title_key_words(F.col("final_title")).alias("title_key"))), "v_ai_news", f"""
SELECT ai_news_id, CASE WHEN k = '' THEN 'news' ELSE k END AS title_key FROM (SELECT ai_news_id, array_to_string((list_filter(regexp_extract_all(lower(final_title), '[\\p{{L}}\\p{{N}}_]+'),
  lambda w: w NOT IN {D.lst(L.TITLE_KEY_STOPWORDS)}))[1:2], ' ') AS k FROM v_ai_news)""")

register("tokenize", lambda t: shape(t.documents.select("doc_id", X.tokenize(F.col("text")).alias("tokens"))),
         "", f"SELECT doc_id, {join(D.tokens('text'))} AS tokens FROM documents")

PREFIX = f"^\\s*(?:{L.TITLE_LABELS})\\s*[:\\-–—]+\\s*"


def _strip_prefix(x: str) -> str:
    cut = f"regexp_replace({D.strip(x)}, {D.q(PREFIX)}, '', 'i')"
    return f"trim({D.collapse(cut)}, ' -:' || chr(9))"


SITE = f"{D.strip(f'regexp_replace({D.strip(chr(116))}, {D.q(chr(92) + "|[^" + chr(92) + "n]*$")}, {D.q("")})')}"
TITLES = f"""tsrc AS (SELECT page_id AS id, title AS t, title AS fb FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
  UNION ALL SELECT -doc_id - 1, split_part(text, '.', 1), '' FROM documents),
t1 AS (SELECT id, t, fb, regexp_replace({D.strip('coalesce(nullif(' + D.strip('t') + ", ''), fb)")}, '^\\s*\\[ai\\]\\s*', '', 'i') AS s FROM tsrc),
t2 AS (SELECT *, {D.strip('string_split(' + D.strip_artifacts(_strip_prefix('s')) + ', chr(10))[1]')} AS s2 FROM t1),
t3 AS (SELECT *, {_strip_prefix('s2')} AS s3 FROM t2),
t4 AS (SELECT *, CASE WHEN len(s3) > 160 THEN regexp_replace(substr(s3, 1, 157), '\\s+$', '') || '...' ELSE s3 END AS s4, {D.language_hint("(s3 || ' ' || fb)")} AS hint FROM t3),
t5 AS (SELECT *, {D.strip('regexp_replace(' + D.strip('t') + ", '\\|[^\\n]*$', '')")} AS u FROM t4)"""


def _titles(t):
    page = t.pages.select(F.col("page_id").alias("id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("t"))
    page = page.withColumn("fb", F.col("t"))
    docs = t.documents.select((-F.col("doc_id") - 1).alias("id"), F.substring_index("text", ".", 1).alias("t"), F.lit("").alias("fb"))
    both = page.unionByName(docs)
    t_, fb = F.col("t"), F.col("fb")
    return both.select("id", text.site_title(t_).alias("site_title"), text.ensured_title(t_, fb, fb).alias("headline"))


register("clean_titles", lambda t: shape(_titles(t)), "", f"""
SELECT id, substr({D.strip("regexp_replace(u, '-[^\\n]*$', '')")}, 1, 120) AS site_title,
  CASE WHEN s3 = '' OR regexp_matches(s3, '^[^\\p{{L}}\\p{{N}}]+$') OR len(s3) < 4 THEN CASE WHEN hint = 'uz' THEN 'Dolzarb xabar' ELSE 'Top story' END ELSE s4 END AS headline
FROM t5""", TITLES)

PROMO = D.collapse("text")
PROMO = f"regexp_replace({PROMO}, 'http\\S+', '', 'g')"
for _phrase in L.PROMO_PHRASES:
    PROMO = f"regexp_replace({PROMO}, {D.q(_phrase)}, '', 'gi')"
SNIPPET = f"""CASE WHEN text = '' THEN '' ELSE {D.strip(f"substr(array_to_string(list_filter(list_transform(string_split({PROMO}, '.'), lambda p: {D.strip('p')}), lambda p: len(p) > 40), '. '), 1, 400)")} || '...' END"""
register("snippets",
         lambda t: shape(t.documents.select("doc_id", text.snippet(F.col("text")).alias("snippet"), text.drop_cut_word(F.substring("text", 1, 400)).alias("cut"))),
         "", f"""SELECT doc_id, {SNIPPET} AS snippet, CASE WHEN NOT regexp_matches(h, '[.!?]\\z') AND contains(h, ' ') THEN regexp_replace(h, ' [^ ]*\\z', '') ELSE h END AS cut
FROM (SELECT doc_id, text, substr(text, 1, 400) AS h FROM documents)""")

FIT = f"""p0 AS (SELECT doc_id, {D.strip("replace(text, chr(13), chr(10))")} AS raw, {D.strip_artifacts('text')} AS ca FROM documents),
p1 AS (SELECT doc_id, raw, ca, {D.strip_artifacts('raw')} AS cleaned, {D.strip_artifacts('ca')} AS cca FROM p0),
p2 AS (SELECT doc_id, {D.paragraphs('raw', 'cleaned')} AS ps, {D.paragraphs('ca', 'cca')} AS qs, ca FROM p1),
p3 AS (SELECT doc_id, w, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used, i FROM (
  SELECT doc_id, {D.words('x')} AS w, i FROM (SELECT doc_id, unnest(ps) AS x, generate_subscripts(ps, 1) AS i FROM p2)) WHERE len(w) > 0),
p4 AS (SELECT doc_id, string_agg(array_to_string(w[1:CAST(250 - coalesce(used, 0) AS INT)], ' '), chr(10) || chr(10) ORDER BY i) AS fitted FROM p3 WHERE coalesce(used, 0) < 250 GROUP BY 1)"""
register("fit_paragraphs",
         lambda t: shape(t.documents.withColumn("ps", X.paragraphs(F.col("text"))).select(
             "doc_id", F.size("ps").alias("n_paragraphs"), text.fit_words(F.col("ps")).alias("fitted"),
             text.structured_text(F.col("text"), F.lit("untitled")).alias("structured"))),
         "", """SELECT doc_id, CAST(len(ps) AS BIGINT) AS n_paragraphs, coalesce(fitted, '') AS fitted,
  coalesce(nullif(array_to_string(qs[1:3], chr(10) || chr(10)), ''), nullif(ca, ''), 'untitled') AS structured FROM p2 LEFT JOIN p4 USING (doc_id)""", FIT)

EN = f"lambda s: NOT (len(regexp_extract_all(lower(s), '[a-z'']+')) >= 5 AND len(list_filter(regexp_extract_all(lower(s), '[a-z'']+'), lambda w: w IN {D.lst(L.ENGLISH_TEXT_STOPWORDS)})) >= 2 AND len(list_filter(regexp_extract_all(lower(s), '[a-z'']+'), lambda w: w IN {D.lst(L.ENGLISH_TEXT_STOPWORDS)})) / greatest(len(regexp_extract_all(lower(s), '[a-z'']+')), 1) >= 0.2)"
register("drop_english_sentences", lambda t: shape(t.documents.select("doc_id", text.drop_english_sentences(F.col("text")).alias("kept"))),
         "", f"SELECT doc_id, array_to_string(list_filter({D.sentences('text')}, {EN}), ' ') AS kept FROM documents")

PERSONA = """regexp_split_to_array(lower(trim(target_persona)), '[^\\p{L}\\p{N}_]+')"""
INTEREST = f"""pr AS (SELECT ai_news_id, lower(final_title || ' ' || final_text) AS hay, list_filter({PERSONA}, lambda x: len(x) >= 3 AND x NOT IN {D.lst(L.PERSONA_STOPWORDS)})[1:8] AS tk,
  list_filter(list_transform(regexp_split_to_array(lower(trim(target_persona)), '[|,;]+'), lambda c: {D.strip(D.collapse('c'))}), lambda c: len(c) >= 4) AS ch FROM v_ai_news),
pg AS (SELECT *, (SELECT list(c ORDER BY -len(c), i) FROM (SELECT unnest(ch) AS c, generate_subscripts(ch, 1) AS i))[1:6] AS phr FROM pr),
pk AS (SELECT *, list_concat(list_filter(list_transform(range(1, len(tk) - 1), lambda i: array_to_string(tk[i:i + 2], ' ')), lambda g: len(g) >= 5),
  list_filter(list_transform(range(1, len(tk)), lambda i: array_to_string(tk[i:i + 1], ' ')), lambda g: len(g) >= 5), coalesce(phr, CAST([] AS VARCHAR[])), tk) AS cand FROM pg)"""
register("primary_interest",
         lambda t: shape(t.v_ai_news.select("ai_news_id", text.primary_interest(F.col("final_title"), F.col("final_text"), F.col("target_persona")).alias("interest"))),
         "v_ai_news", "SELECT ai_news_id, coalesce(list_filter(cand, lambda c: contains(hay, c))[1], phr[1], tk[1]) AS interest FROM pk", INTEREST)

DIM = 256


def embedding_ctes(name: str, source: str, id_col: str, body: str, dim: int = DIM) -> str:
    """CTEs ``name`` (id, idx, weight) of hashed vectors of ``body`` in ``source``."""
    return f"""{name}_t AS (SELECT {id_col} AS id, {D.tokens(body)} AS tk FROM {source}),
{name}_f AS (SELECT id, unnest(list_concat(list_transform(tk, lambda x: 'tok:' || x),
    list_transform(range(1, len(tk)), lambda i: 'bi:' || tk[i] || ':' || tk[i + 1]),
    list_transform(range(1, len(tk) - 1), lambda i: 'tri:' || tk[i] || ':' || tk[i + 1] || ':' || tk[i + 2]))) AS f FROM {name}_t),
{name}_u AS (SELECT id, CAST(('0x' || substr(sha256(f), 1, 16))::UBIGINT % {dim} AS BIGINT) AS idx,
    sum(CASE WHEN f LIKE 'tok:%' THEN 10 WHEN f LIKE 'bi:%' THEN 12 ELSE 8 END) AS units FROM {name}_f GROUP BY 1, 2),
{name} AS (SELECT id, idx, round_even(CAST(units AS DOUBLE) / sqrt(CAST(sum(units * units) OVER (PARTITION BY id) AS DOUBLE)), 8) AS weight FROM {name}_u)"""


register("hash_embedding", lambda t: shape(text.hash_embedding(t.documents, "doc_id", "text", DIM)),
         "", "SELECT id AS doc_id, idx, weight FROM emb", embedding_ctes("emb", "documents", "doc_id", "text"))


def _enriched(t):
    return t.documents.select(
        "doc_id", F.col("text").alias("raw_text"), text.classify_category(F.col("text")).alias("category"), text.extractive_summary(F.col("text")).alias("summary"))


register("enrichment_report", lambda t: shape(metrics.enrichment_report(_enriched(t))), "", f"""
SELECT 'items' AS name, count(*) AS cnt FROM docs UNION ALL SELECT 'summaries_non_empty', count(*) FILTER (summary <> '') FROM docs
UNION ALL SELECT 'full_text_equal', count(*) FILTER (summary <> '' AND summary = text) FROM docs
UNION ALL SELECT 'category:' || category, count(*) FROM docs GROUP BY category""",
         SUMMARY + f""", docs AS (SELECT d.doc_id, text, {CATEGORY} AS category,
  CASE WHEN text = '' THEN '' ELSE coalesce(summary, {D.strip('substr(text, 1, 400)')} || '...') END AS summary FROM documents d LEFT JOIN summ USING (doc_id))""")
