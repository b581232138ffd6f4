"""Text analytics over article tables.

Row-wise work stays in array expressions, so no operator here shuffles except
``top_keywords`` and ``hash_embedding``, which exchange the texts once, by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import lexicon as L
from newsloom.functions import texts as X
from newsloom.operators.common import top_rows

LATIN_WORD = r"(?U)\b[a-zA-Z'\-]+\b"
SENTENCE_WORD = r"(?U)\b[a-zA-Z']+\b"


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _hits(tokens: Column, vocabulary) -> Column:
    return F.size(F.filter(tokens, lambda w: w.isin(*vocabulary)))


def language_scores(df: DataFrame, text: str) -> DataFrame:
    """Letter, marker and stopword counts with the ratios made from them."""

    def english_sentence(s: Column) -> Column:
        found = _found(F.lower(s), SENTENCE_WORD)
        return (F.size(found) >= 6) & (_hits(found, L.ENGLISH_TEXT_STOPWORDS) / F.greatest(F.size(found), F.lit(1)) >= 0.22)

    out = df.withColumn("_norm", X.normalize_apostrophes(F.coalesce(F.col(text), F.lit(""))))
    out = out.withColumn("_lower", F.lower("_norm"))
    out = out.withColumn("_latin", _found(F.col("_lower"), LATIN_WORD))
    out = out.withColumns(
        {
            "cyrillic_total": F.regexp_count("_norm", F.lit(L.CYRILLIC)),
            "cyrillic_uz": F.regexp_count("_norm", F.lit(L.UZBEK_CYRILLIC)),
            "uzbek_latin_hits": F.size(F.filter("_latin", lambda w: w.rlike(L.UZBEK_LATIN_PATTERN))),
            "uzbek_marker_hits": X.count_contained(F.col("_lower"), L.UZBEK_MARKERS),
            "uzbek_common_hits": _hits(F.col("_latin"), L.UZBEK_COMMON_WORDS),
            "english_word_hits": _hits(F.col("_latin"), L.ENGLISH_TEXT_STOPWORDS),
            "english_sentence_hits": F.size(
                F.filter(F.split("_norm", rf"(?<=[.!?]){L.SPACE}+"), english_sentence)
            ),
        }
    )
    out = out.withColumn("cyrillic_ru", F.greatest(F.lit(0), F.col("cyrillic_total") - F.col("cyrillic_uz")))
    uzbek = (
        F.col("cyrillic_uz") * 1.7
        + F.col("uzbek_latin_hits") * 7.0
        + F.col("uzbek_marker_hits") * 10.0
        + F.col("uzbek_common_hits") * 3.0
    )
    out = out.withColumns(
        {
            "mixed_score": uzbek + F.col("cyrillic_ru") * 0.75,
            "english_score": F.col("english_word_hits") * 10.0 + F.col("english_sentence_hits") * 20.0,
        }
    )
    total = F.greatest(F.lit(1.0), F.col("mixed_score") + F.col("english_score"))
    return out.withColumns(
        {
            "english_ratio": F.col("english_score") / total,
            "uzbek_ratio": F.col("mixed_score") / total,
            "language_hint": X.language_hint(F.col(text)),
            "not_uzbek": not_uzbek(F.col(text)),
            "english_heavy": english_heavy(F.col(text)),
        }
    ).drop("_norm", "_lower", "_latin")


def not_uzbek(text: Column) -> Column:
    """More than half of the words are plain English words."""
    all_words = X.words(F.lower(F.coalesce(text, F.lit(""))))
    hits = F.size(F.filter(all_words, lambda w: F.btrim(w, F.lit(".,!?;:")).isin(*L.NOT_UZBEK_WORDS)))
    return F.when(F.coalesce(text, F.lit("")) == "", True).otherwise(F.coalesce(hits / F.nullif(F.size(all_words), F.lit(0)), F.lit(0.0)) > 0.5)


def english_heavy(text: Column) -> Column:
    """At least two title stopwords that make up a fifth of four or more tokens."""
    tokens = _found(F.lower(F.coalesce(text, F.lit(""))), "[a-zA-Z']+")
    hits = _hits(tokens, L.ENGLISH_TITLE_STOPWORDS)
    return (F.size(tokens) >= 4) & (hits >= 2) & (hits / F.greatest(F.size(tokens), F.lit(1)) >= 0.2)


def validate_articles(df: DataFrame, title: str, text: str) -> DataFrame:
    """Add ``title_rule``, ``text_rule`` (first failing rule, null if none) and ``reason``."""
    scored = language_scores(df, text)
    value = X.strip(F.coalesce(F.col(title), F.lit("")))
    body = F.coalesce(F.col(text), F.lit(""))
    n_title = F.size(X.words(value))
    title_rule = (
        F.when(value == "", "empty")
        .when(X.contains_any(value, L.TITLE_MOJIBAKE), "mojibake")
        .when(value.contains("<") & value.contains(">"), "tags")
        .when(n_title < 2, "few_words")
        .when(n_title > 24, "many_words")
        .when(F.length(value) > 220, "long")
    )
    dominant = (F.col("english_ratio") >= 0.62) & (F.col("english_ratio") > F.col("uzbek_ratio") + 0.12)
    text_rule = (
        F.when(body == "", "empty")
        .when(X.contains_any(body, L.TEXT_MOJIBAKE), "mojibake")
        .when(body.contains("<") & body.contains(">"), "tags")
        .when(X.contains_any(F.lower(body), [p.lower() for p in L.FORBIDDEN_PHRASES]), "forbidden_phrase")
        .when(F.size(X.words(body)) < 50, "few_words")
        .when(dominant, "english_dominant")
    )
    out = scored.withColumns({"title_rule": title_rule, "text_rule": text_rule})
    reason = (
        F.when((F.coalesce(F.col(title), F.lit("")) == "") | (body == ""), "missing")
        .when(F.col("title_rule").isNotNull(), "invalid_title")
        .when(F.col("text_rule").isNotNull(), "invalid_text")
        .when(F.length(X.strip(body)) < 80, "too_short")
        .when(F.col("not_uzbek"), "not_uzbek")
        .otherwise("ok")
    )
    return out.withColumn("reason", reason)


def article_embedding_text(
    title: Column, final_text: Column, category: Column, persona: Column, raw_text: Column, region: Column
) -> Column:
    """Labelled text of an article, the input of its vector."""

    def text(c: Column, default: str = "") -> Column:
        return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))

    parts = [
        F.concat(F.lit("title: "), text(title)),
        F.concat(F.lit("category: "), text(category, "general")),
        F.concat(F.lit("persona: "), text(persona, "general")),
        F.concat(F.lit("region: "), text(region)),
        F.concat(F.lit("body: "), text(final_text)),
        F.concat(F.lit("source: "), text(raw_text)),
    ]
    return X.normalize_text(F.concat_ws(" \n", *parts))


INTERESTS_SCHEMA = (
    "all_topics array<string>, topics array<string>, custom_topics array<string>, profession string, city string, "
    "country_name string, language string"
)


def user_embedding_text(interests: Column, location: Column, country_code: Column, username: Column) -> Column:
    """Profile text of a user: topics, profession, country, city, place, code, name."""
    data = F.from_json(interests, INTERESTS_SCHEMA)
    empty = F.array().cast("array<string>")
    lists = F.concat(*[F.coalesce(data[k], empty) for k in ("all_topics", "topics", "custom_topics")])
    scalars = F.array(data["profession"], data["country_name"], data["city"], location, country_code, username)
    parts = F.transform(F.concat(lists, scalars), lambda p: F.lower(F.trim(p)))
    return X.normalize_text(F.array_join(F.filter(parts, lambda p: p != ""), " "))


def news_sentiment(text: Column) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    positive, negative = X.count_contained(lowered, L.POSITIVE_MARKERS), X.count_contained(lowered, L.NEGATIVE_MARKERS)
    return F.when(positive > negative, "positive").when(negative > positive, "negative").otherwise("neutral")


def quality_score(df: DataFrame, text: str, raw_text: str, persona: str, geo: str, model_score: str | None = None) -> DataFrame:
    """Editorial score from 0 to 10; with ``model_score`` also the combined score."""

    def tokens(c: Column, n: int) -> Column:
        parts = F.split(F.lower(F.coalesce(c, F.lit(""))), L.NONWORD + "+")
        return F.slice(F.filter(parts, lambda t: F.length(t) >= 3), 1, n)

    def hit(toks: Column) -> Column:
        return (F.size(toks) == 0) | F.exists(toks, lambda t: F.contains(F.col("_lowered"), t))

    out = df.withColumn("_clean", X.strip_artifacts(F.col(text)))
    out = out.withColumns(
        {
            "_lowered": F.lower("_clean"),
            "_words": X.word_tokens(F.lower("_clean")),
            "_n_sent": X.sentence_count(F.col("_clean"), ".!?;"),
            "_n_par": X.paragraph_count(F.col("_clean")),
            "sentiment": news_sentiment(F.concat_ws(" ", F.coalesce(F.col(raw_text), F.lit("")), F.coalesce(F.col(text), F.lit("")))),
            "_hint": X.language_hint(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in (raw_text, persona, geo)])),
        }
    )
    out = out.withColumns({"_n": F.size("_words"), "_unique": F.size(F.array_distinct("_words"))})
    n = F.col("_n")
    per_sentence = n / F.greatest(F.col("_n_sent"), F.lit(1))
    diversity = F.col("_unique") / F.greatest(n, F.lit(1))
    lowered = F.col("_lowered")
    has_digit = r"\p{Nd}"
    artifacts = F.col("_clean").rlike(rf"(?iU){L.TRUNCATION_MARK}|\b(?:lid|yanglik)\b")
    tone_bonus = (
        F.when((F.col("sentiment") == "positive") & X.contains_any(lowered, L.CONGRATULATIONS), 800)
        .when((F.col("sentiment") == "negative") & X.contains_any(lowered, L.CONDOLENCES), 800)
        .when(F.col("sentiment") == "neutral", 400)
        .otherwise(0)
    )
    # every term is a whole number of thousandths, so the sum is exact
    score = (
        F.least(F.lit(2200), F.floor(n * 2200 / L.MIN_QUALITY_WORDS))
        + F.when(F.col("_n_par") >= 4, 1800).when(F.col("_n_par") == 3, 1200).otherwise(0)
        + F.when(F.col("_hint") != "ru", 800).when(X.contains_cyrillic(F.col("_clean")), 1200).otherwise(200)
        + F.when(hit(tokens(F.col(persona), 4)), 1100).otherwise(0)
        + F.when(hit(tokens(F.col(geo), 3)), 800).otherwise(0)
        + F.when(~F.coalesce(F.col(raw_text), F.lit("")).rlike(has_digit) | F.col("_clean").rlike(has_digit), 1000).otherwise(0)
        + F.when(diversity.between(0.35, 0.78), 900).otherwise(400)
        + F.when(per_sentence.between(8.0, 26.0), 800).otherwise(300)
        + F.when(artifacts, 0).otherwise(800)
        + tone_bonus
        + F.when(X.contains_any(lowered, L.USER_FACT_PHRASES), 800).otherwise(0)
    )
    hundredths = F.when(F.col("_clean") == "", 0).otherwise(tens_half_even(F.least(F.lit(10000), score)))
    out = out.withColumn("_quality", hundredths).withColumn("quality_score", F.col("_quality") / 100)
    if model_score:
        model = F.round(normalize_model_score(F.col(model_score)) * 100).cast("bigint")
        out = out.withColumn("combined_score", tens_half_even(model * 4 + F.col("_quality") * 6) / 100)
    out = out.drop("_quality")
    return out.drop("_clean", "_lowered", "_words", "_n_sent", "_n_par", "_hint", "_n", "_unique")


def tens_half_even(n: Column) -> Column:
    """Whole number divided by ten, rounded half to even without floating point."""
    tens, rest = F.floor(n / 10), F.pmod(n, F.lit(10))
    return tens + F.when((rest > 5) | ((rest == 5) & (F.pmod(tens, F.lit(2)) == 1)), 1).otherwise(0)


def normalize_model_score(score: Column, fallback: float = 7.5) -> Column:
    """Zero or missing becomes the fallback; scores in 0..1 stretch to 0..10."""
    value = F.coalesce(F.nullif(score.cast("double"), F.lit(0.0)), F.lit(fallback))
    return F.bround(F.when(value.between(0.0, 1.0), value * 10.0).otherwise(value), 2)


def classify_category(text: Column) -> Column:
    """Category with the most keywords; the first listed wins ties, none gives "other"."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    ranked = [
        F.struct(X.count_contained(lowered, kws).alias("hits"), F.lit(-i).alias("order"), F.lit(name).alias("name"))
        for i, (name, kws) in enumerate(L.CATEGORY_KEYWORDS.items())
    ]
    best = F.array_max(F.array(*ranked))
    return F.when(best["hits"] > 0, best["name"]).otherwise("other")


def lead_summary(text: Column, n: int = 3) -> Column:
    """First ``n`` sentences of the text."""
    return F.array_join(F.slice(X.sentences(X.strip(X.collapse_space(F.coalesce(text, F.lit("")))) ), 1, n), " ")


def extractive_summary(text: Column, n: int = 3) -> Column:
    """The ``n`` most informative long sentences in text order, near-repeats dropped."""
    body = F.coalesce(text, F.lit(""))
    pieces = F.transform(F.split(body, "[.!?]"), lambda s, i: F.struct(X.strip(s).alias("s"), i.alias("pos")))
    long_ones = F.filter(pieces, lambda p: F.length(p["s"]) > 40)

    def informative(s: Column) -> Column:
        return F.size(F.filter(X.word_tokens(F.lower(s)), lambda w: ~w.isin(*L.SUMMARY_STOPWORDS)))

    scored = F.transform(long_ones, lambda p: F.struct((-informative(p["s"])).alias("key"), p["pos"].alias("pos"), p["s"].alias("s")))
    top = F.array_sort(F.transform(F.slice(F.array_sort(scored), 1, n), lambda p: F.struct(p["pos"], p["s"])))

    def unlike_earlier(items: Column) -> Column:
        # at most n entries, so comparing each with the earlier ones is cheap
        return F.filter(
            items,
            lambda p, i: ~F.exists(F.slice(items, 1, i), lambda e: F.substring(e["s"], 1, 50) == F.substring(p["s"], 1, 50)),
        )

    joined = F.array_join(F.transform(X.bind(top, unlike_earlier), lambda p: p["s"]), ". ")
    fallback = F.concat(X.strip(F.substring(body, 1, 400)), F.lit("..."))
    return F.when(body == "", "").otherwise(F.coalesce(F.concat(F.nullif(joined, F.lit("")), F.lit(".")), fallback))


def fact_sentences(text: Column, n: int = 3) -> Column:
    """Up to ``n`` distinct sentences, those with digits or quantities first."""
    found = X.sentences(X.strip_artifacts(text), ".!?;")

    def quantified(s: Column) -> Column:
        return s.rlike(r"\p{Nd}") | X.contains_any(F.lower(s), L.QUANTITY_TOKENS)

    def ordered(ss: Column) -> Column:
        marked = F.transform(ss, lambda s: F.struct(quantified(s).alias("q"), s.alias("s")))
        return X.bind(marked, lambda m: F.concat(F.filter(m, lambda e: e["q"]), F.filter(m, lambda e: ~e["q"])))

    return distinct_folded(F.transform(X.bind(found, ordered), lambda e: e["s"]), n)


def distinct_folded(items: Column, n: int) -> Column:
    """First ``n`` entries that differ when case is ignored.

    The state holds at most ``n`` entries, so the walk is linear in the text.
    """
    empty = F.array().cast("array<string>")

    def step(acc: Column, s: Column) -> Column:
        known = F.exists(acc, lambda a: F.lower(a) == F.lower(s))
        return F.when((F.size(acc) < n) & ~known, F.concat(acc, F.array(s))).otherwise(acc)

    return F.aggregate(items, empty, step)


def user_fact(text: Column, interest: Column, hint: Column) -> Column:
    """One fact sentence with a localized lead; the one that names the interest if any."""

    def best(facts: Column) -> Column:
        named = F.filter(facts, lambda f: (F.coalesce(interest, F.lit("")) != "") & F.contains(F.lower(f), F.lower(interest)))
        return F.coalesce(F.get(named, F.lit(0)), F.get(facts, F.lit(0)))

    def prefix(part: int) -> Column:
        c = F.lit(L.FACT_PREFIXES["en"][part])
        for code in ("uz", "ru"):
            c = F.when(hint == code, L.FACT_PREFIXES[code][part]).otherwise(c)
        return c

    return F.concat(prefix(0), F.lit(": "), F.coalesce(X.bind(fact_sentences(text, 5), best), prefix(1)))


def topic_phrases(title: Column, text: Column, category: Column, n: int = 6) -> Column:
    """Up to six distinct clause heads of at most eight words; else the category."""
    source = X.strip_artifacts(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))
    chunks = F.transform(F.split(source, r"[.!?;\n\r]+"), lambda c: F.btrim(X.collapse_space(c), F.lit(" -,:;")))
    long_ones = F.filter(chunks, lambda c: F.length(c) >= 8)
    heads = F.transform(long_ones, lambda c: F.array_join(F.slice(F.filter(F.split(c, " "), lambda w: w != ""), 1, 8), " "))
    found = distinct_folded(F.filter(heads, lambda h: h != ""), n)
    fallback = F.filter(F.array(F.trim(category)), lambda c: c != "")
    return X.bind(found, lambda f: F.when(F.size(f) > 0, f).otherwise(fallback))


def top_keywords(df: DataFrame, id_col: str, text: str, k: int = 6) -> DataFrame:
    """(id, keyword, cnt, rank): most frequent long words, earlier word first on ties."""
    # texts stay where they are: only counts per word move
    exploded = df.select(id_col, F.posexplode(X.keyword_words(F.coalesce(F.col(text), F.lit("")))).alias("pos", "keyword"))
    counts = exploded.groupBy(id_col, "keyword").agg(F.count(F.lit(1)).alias("cnt"), F.min("pos").alias("first_pos"))
    return top_rows(counts, [id_col], [F.col("cnt").desc(), F.col("first_pos")], k, "rank").drop("first_pos")


def keyword_arrays(df: DataFrame, id_col: str, text: str, k: int = 6) -> DataFrame:
    """(id, keywords): the top keywords as one array of at most ``k`` entries."""
    top = top_keywords(df, id_col, text, k)
    packed = F.array_sort(F.collect_list(F.struct("rank", "keyword")))
    return top.groupBy(id_col).agg(F.transform(packed, lambda e: e["keyword"]).alias("keywords"))


def title_key_words(title: Column) -> Column:
    """First two title words that are not stopwords; "news" when there are none."""
    kept = F.filter(X.word_tokens(F.lower(F.coalesce(title, F.lit("")))), lambda w: ~w.isin(*L.TITLE_KEY_STOPWORDS))
    key = F.array_join(F.slice(kept, 1, 2), " ")
    return F.when(key == "", "news").otherwise(key)


def site_title(title: Column) -> Column:
    """Title before the first bar and the first hyphen of its line, at most 120 characters."""
    t = X.strip(F.coalesce(title, F.lit("")))
    t = X.strip(F.regexp_replace(t, r"\|[^\n]*$", ""))
    t = X.strip(F.regexp_replace(t, r"-[^\n]*$", ""))
    return F.substring(t, 1, 120)


def strip_heading_prefix(title: Column) -> Column:
    t = F.regexp_replace(X.strip(F.coalesce(title, F.lit(""))), rf"(?iU)^\s*(?:{L.TITLE_LABELS})\s*[:\-–—]+\s*", "")
    return F.btrim(X.collapse_space(t), F.lit(" -:\t"))


def inferred_headline(source: Column) -> Column:
    """Headline from source text: a world-cup line when it tells of a win, else its first sentence."""

    def subject(raw: Column) -> Column:
        flat = F.btrim(X.collapse_space(raw), F.lit(" .,:;!-"))
        head = F.btrim(F.get(F.split(flat, rf"(?iU)\b{L.WIN_SPLIT}\b", 2), F.lit(0)), F.lit(" -,:;!"))
        leading = F.array_join(F.slice(X.words(head), 1, 5), " ")
        bare = F.slice(F.split(X.strip(F.regexp_replace(raw, r"[^\p{L}\p{N}_\s\-]", "")), " "), 1, 3)
        return F.coalesce(F.nullif(leading, F.lit("")), F.nullif(X.strip(F.array_join(bare, " ")), F.lit("")))

    def cup_line(raw: Column) -> Column:
        """Null when the text is no world-cup win or has no subject."""
        lowered = F.lower(raw)
        hint = X.language_hint(raw)
        tail = (
            F.when(hint == "ru", " победитель чемпионата мира")
            .when(hint == "uz", " jahon chempionati g'olibi")
            .otherwise(" wins the World Cup")
        )
        is_cup = X.contains_any(lowered, L.WORLD_CUP_MARKERS) & X.contains_any(lowered, L.WIN_MARKERS)
        return F.when(is_cup, F.concat(subject(raw), tail))

    def first_line(raw: Column) -> Column:
        first = X.strip(F.get(F.split(raw, rf"(?<=[.!?]){L.SPACE}+"), F.lit(0)))
        first = X.collapse_space(F.regexp_replace(first, "^[\"'“”‘’\\-\\s]+", ""))
        return F.btrim(F.substring(first, 1, 120), F.lit(" -,:;"))

    return X.bind(X.strip_artifacts(source), lambda raw: F.when(raw == "", "").otherwise(F.coalesce(cup_line(raw), first_line(raw))))


def ensured_title(title: Column, fallback: Column, source_text: Column) -> Column:
    """Publishable headline: labels cut, 160 characters at most, never empty."""
    source = F.coalesce(F.nullif(X.strip(title), F.lit("")), X.strip(F.coalesce(fallback, F.lit(""))), F.lit(""))
    source = X.strip(F.regexp_replace(source, r"(?i)^\s*\[ai\]\s*", ""))
    source = X.strip(F.get(F.split(X.strip_artifacts(strip_heading_prefix(source)), "\n"), F.lit(0)))
    source = F.btrim(strip_heading_prefix(source), F.lit(" -:\t"))
    context = F.concat_ws(" ", F.coalesce(fallback, F.lit("")), F.coalesce(source_text, F.lit("")))

    def default(s: Column) -> Column:
        hint = X.language_hint(F.concat_ws(" ", s, F.coalesce(fallback, F.lit(""))))
        headline = F.lit(L.DEFAULT_HEADLINES["en"])
        for code in ("uz", "ru"):
            headline = F.when(hint == code, L.DEFAULT_HEADLINES[code]).otherwise(headline)
        return headline

    def finish(s: Column) -> Column:
        cut = F.concat(F.regexp_replace(F.substring(s, 1, 157), f"{L.SPACE}+$", ""), F.lit("..."))
        unusable = s.rlike(r"^[^\p{L}\p{N}]+$") | (F.length(s) < 4)
        return (
            F.when(unusable, default(s))
            .when(F.lower(s).isin(*L.GENERIC_TITLES), F.coalesce(F.nullif(inferred_headline(X.strip(context)), F.lit("")), s))
            .when(F.length(s) > 160, cut)
            .otherwise(s)
        )

    return X.bind(source, finish)


def snippet(text: Column, max_len: int = 400) -> Column:
    """Teaser: no links or promo phrases, only long sentence pieces, capped."""
    s = F.regexp_replace(X.collapse_space(F.coalesce(text, F.lit(""))), r"http\S+", "")
    for phrase in L.PROMO_PHRASES:
        s = F.regexp_replace(s, "(?iu)" + phrase, "")
    parts = F.filter(F.transform(F.split(s, r"\."), X.strip), lambda p: F.length(p) > 40)
    teaser = F.concat(X.strip(F.substring(F.array_join(parts, ". "), 1, max_len)), F.lit("..."))
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(teaser)


def drop_cut_word(text: Column) -> Column:
    """Cut the last word of a text that does not end in a sentence mark."""
    return F.when(~text.rlike(r"[.!?]\z") & text.contains(" "), F.regexp_replace(text, r" [^ ]*\z", "")).otherwise(text)


def fit_word_bounds(text: Column, max_words: int = 250) -> Column:
    """Paragraphs joined by blank lines, cut where the running word count reaches the limit."""
    return fit_words(X.paragraphs(text), max_words)


def fit_words(paragraphs: Column, max_words: int = 250) -> Column:
    """``fit_word_bounds`` of paragraphs at hand; no more words are split off than there is room for."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"))

    def step(acc: Column, p: Column) -> Column:
        room = F.lit(max_words) - acc["used"]

        def grown(taken: Column) -> Column:
            kept = F.concat(acc["kept"], F.array(F.array_join(taken, " ")))
            return F.when(F.size(taken) > 0, F.struct(kept.alias("kept"), (acc["used"] + F.size(taken)).alias("used"))).otherwise(acc)

        return F.when(room > 0, X.bind(F.slice(X.words(p, max_words), F.lit(1), room), grown)).otherwise(acc)

    return F.array_join(F.aggregate(paragraphs, start, step)["kept"], "\n\n")


def structured_text(text: Column, title: Column, max_paragraphs: int = 3, max_chars: int = 0) -> Column:
    """First paragraphs of the cleaned text; the title when nothing is left."""

    def finish(cleaned: Column) -> Column:
        joined = F.array_join(F.slice(X.clean_paragraphs(cleaned), 1, max_paragraphs), "\n\n")
        if max_chars > 0:
            joined = F.substring(joined, 1, max_chars)
        return F.coalesce(F.nullif(joined, F.lit("")), F.nullif(cleaned, F.lit("")), title)

    return X.bind(X.strip_artifacts(text), finish)


def drop_english_sentences(text: Column) -> Column:
    """Remove sentences of five or more words with two or more, and a fifth, English stopwords."""

    def english(s: Column) -> Column:
        found = _found(F.lower(s), "[a-z']+")
        hits = _hits(found, L.ENGLISH_TEXT_STOPWORDS)
        return (F.size(found) >= 5) & (hits >= 2) & (hits / F.greatest(F.size(found), F.lit(1)) >= 0.2)

    return F.array_join(F.filter(X.sentences(F.coalesce(text, F.lit(""))), lambda s: ~english(s)), " ")


def primary_interest(title: Column, text: Column, persona: Column) -> Column:
    """Longest persona phrase or token run that the article names, else the first one."""
    raw = F.lower(X.strip(F.coalesce(persona, F.lit(""))))
    tokens = F.filter(
        F.split(raw, L.NONWORD + "+"), lambda t: (F.length(t) >= 3) & ~t.isin(*L.PERSONA_STOPWORDS)
    )
    tokens = F.slice(tokens, 1, 8)
    chunks = F.filter(F.transform(F.split(raw, "[|,;]+"), lambda c: X.strip(X.collapse_space(c))), lambda c: F.length(c) >= 4)
    by_length = F.array_sort(F.transform(chunks, lambda c, i: F.struct((-F.length(c)).alias("k"), i.alias("i"), c.alias("c"))))
    phrases = F.slice(F.transform(by_length, lambda e: e["c"]), 1, 6)

    def runs(n: int) -> Column:
        grams = F.transform(tokens, lambda t, i: F.array_join(F.slice(tokens, i + 1, n), " "))
        whole = F.slice(grams, 1, F.greatest(F.size(tokens) - (n - 1), F.lit(0)))
        return F.filter(whole, lambda g: F.length(g) >= 5)

    candidates = F.concat(runs(3), runs(2), phrases, tokens)
    haystack = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))
    named = F.filter(candidates, lambda c: F.contains(haystack, c))
    return F.coalesce(F.get(named, F.lit(0)), F.get(phrases, F.lit(0)), F.get(tokens, F.lit(0)))


def feature_index(feature: Column, dim: int) -> Column:
    """First eight sha256 bytes, big-endian and unsigned, modulo ``dim``.

    The 64-bit value is taken as two 32-bit halves to stay in longs; where ``dim``
    divides a power of 16 up to 16^8, its last hex digits alone decide.
    """
    digest = F.sha2(feature, 256)
    digits = next((n for n in range(1, 9) if 16**n % dim == 0), None)
    if digits:
        return F.conv(F.substring(digest, 17 - digits, digits), 16, 10).cast("bigint") % dim
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("bigint")
    return ((high % dim) * (2**32 % dim) + low % dim) % dim


def hash_embedding(df: DataFrame, id_col: str, text: str, dim: int = 256) -> DataFrame:
    """(id, idx, weight): unit vector of hashed word uni-, bi- and trigrams.

    Feature weights 1.0, 1.2 and 0.8 are counted in tenths, so sums are exact
    whatever the order; the common factor 1/sqrt(tokens) cancels in the norm.
    """
    def feature(prefix: str, parts: list[Column], weight: int) -> Column:
        return F.struct(F.concat(F.lit(prefix), F.concat_ws(":", *parts)).alias("f"), F.lit(weight).alias("w"))

    tokens = df.select(id_col, X.tokenize(F.col(text)).alias("t"))
    t = F.col("t")
    size = F.size(t)

    def after(i: Column, n: int) -> Column:
        return F.get(t, i + n)

    features = F.flatten(
        F.transform(
            t,
            lambda x, i: F.concat(
                F.array(feature("tok:", [x], 10)),
                F.when(i + 1 < size, F.array(feature("bi:", [x, after(i, 1)], 12))).otherwise(F.array().cast("array<struct<f:string,w:int>>")),
                F.when(i + 2 < size, F.array(feature("tri:", [x, after(i, 1), after(i, 2)], 8))).otherwise(F.array().cast("array<struct<f:string,w:int>>")),
            ),
        )
    )
    exploded = tokens.select(id_col, F.inline(features))
    units = exploded.groupBy(id_col, feature_index(F.col("f"), dim).alias("idx")).agg(F.sum("w").alias("units"))
    norm = F.sqrt(F.sum(F.col("units") * F.col("units")).over(Window.partitionBy(id_col)))
    return units.select(id_col, "idx", F.bround(F.col("units") / norm, 8).alias("weight"))


def dense_vectors(vectors: DataFrame, id_col: str, dim: int = 256) -> DataFrame:
    """(id, vector): dense arrays from the long form; at most ``dim`` entries each."""
    packed = F.map_from_entries(F.collect_list(F.struct(F.col("idx").cast("int"), "weight")))
    filled = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0)))
    return vectors.groupBy(id_col).agg(packed.alias("m")).select(id_col, filled.alias("vector"))
