"""Substring matching between a text table and a term table.

Term lists of a checked size become one prefix-tree pattern: each text is read
once, in its row, and only its hits leave the row.  For longer lists it is an
equi-join: a text that contains a term contains the term's first three
characters, so texts are cut into their distinct three-character pieces (two or
one where terms are that short), pieces meet terms by hash join, and the few
candidates are verified.  Both give the same rows, and nothing is compared
all-to-all, whatever the number of terms.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.texts import collapse_space, strip

# Term lists up to this size are compiled into a pattern; the driver sees no more of a longer one.
MAX_COMPILED_TERMS, MAX_COMPILED_CHARS, MAX_TERM_CHARS = 2_000, 50_000, 200

# Topic aliases used when articles are searched.
TOPIC_ALIASES = {
    "cs": ("counter-strike", "counter strike", "counter-strike 2", "cs2", "esports"),
    "cs2": ("counter-strike 2", "counter strike 2", "cs2", "esports"),
    "dota": ("dota 2", "dota2", "the international", "esports"),
    "dota2": ("dota 2", "dota2", "the international", "esports"),
    "valorant": ("valorant", "vct", "esports"),
}
ALIAS_ONLY_TOPICS = ("cs",)
SHORT_VARIANT = 2
# A short variant stands between characters other than these.
BOUND_BEFORE, BOUND_AFTER = "(?<![a-z0-9])", "(?![a-z0-9])"


def pieces(text: Column, size: int) -> Column:
    """Distinct substrings of one length, overlapping."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def small_list(terms: DataFrame, term: str) -> list[str] | None:
    """The distinct non-empty terms in order, or nothing if they are too many to compile."""
    rows = terms.select(F.col(term).alias("t")).where("t <> ''").distinct().limit(MAX_COMPILED_TERMS + 1).collect()
    found = sorted(r["t"] for r in rows)
    small = len(found) <= MAX_COMPILED_TERMS and sum(map(len, found)) <= MAX_COMPILED_CHARS
    return found if small and all(len(t) <= MAX_TERM_CHARS for t in found) else None


def _quoted(char: str) -> str:
    return char if char.isalnum() or ord(char) > 127 else "\\" + char


def prefix_tree_pattern(terms: Sequence[str]) -> str:
    """Pattern of the longest term at a place, each shared beginning written once."""
    tree: dict = {}
    for term in terms:
        node = tree
        for char in term:
            node = node.setdefault(char, {})
        node[""] = {}

    def written(node: dict) -> str:
        rest = [_quoted(c) + written(child) for c, child in node.items() if c]
        if not rest:
            return ""
        if len(rest) == 1 and "" not in node:
            return rest[0]
        return f"(?:{'|'.join(rest)})" + ("?" if "" in node else "")

    return written(tree)


def terms_in(text: Column, terms: Sequence[str], before: str = "", after: str = "") -> Column:
    """Distinct terms that occur in a text, by one pass; ``before`` and ``after`` are zero-width conditions around a term."""
    if not terms:
        return F.array().cast("array<string>")
    firsts = "".join(sorted({_quoted(t[0]) for t in terms}))
    pattern = rf"(?s){before}(?=[{firsts}])(?=({prefix_tree_pattern(terms)}){after})"
    hits = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
    # a longer term hides those it begins with
    listed = set(terms)
    hidden = {t: [t[:k] for k in range(1, len(t)) if t[:k] in listed] for t in terms}
    hidden = {t: [*shorter, t] for t, shorter in hidden.items() if shorter}
    if not hidden:
        return hits
    table = F.from_json(F.lit(json.dumps(hidden)), "map<string,array<string>>")
    return F.array_distinct(F.flatten(F.transform(hits, lambda t: F.coalesce(F.try_element_at(table, t), F.array(t)))))


def substring_matches(texts: DataFrame, text_id: str, text: str, terms: DataFrame, term: str, sizes: tuple[int, ...] = (3,)) -> DataFrame:
    """Distinct (text_id, term) where the text contains the term.

    ``sizes`` lists the piece lengths to try where terms are joined: 3 for terms
    of three or more characters, 1 and 2 for shorter ones.
    """
    listed = small_list(terms, term)
    if listed is not None:
        return texts.select(text_id, F.explode(terms_in(F.col(text), listed)).alias(term)).distinct()
    keyed = terms.select(F.col(term).alias("_term"), F.substring(term, 1, 3).alias("_key")).where("_term <> ''").distinct()
    cut = F.array_distinct(F.concat(*[pieces(F.col(text), n) for n in sizes]))
    exploded = texts.select(text_id, F.explode(cut).alias("_key"))
    # the pair table is narrow; texts come back only for pairs that share a piece
    pairs = exploded.join(keyed, "_key").select(text_id, "_term")
    verified = pairs.join(texts.select(text_id, text), text_id).where(F.contains(F.col(text), F.col("_term")))
    return verified.select(text_id, F.col("_term").alias(term)).distinct()


def normalize_topic(topic: Column) -> Column:
    return F.lower(strip(collapse_space(F.coalesce(topic, F.lit("")))))


def alias_table(spark) -> DataFrame:
    """(topic, variant, pos): the alias rules as rows; a fixed, tiny table."""
    rows = [(t, v, i) for t, vs in TOPIC_ALIASES.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "topic string, variant string, pos int")


def topic_variants(topics: DataFrame, alias: DataFrame, topic: str = "topic") -> DataFrame:
    """(topic, variant, pos): aliases in order, then the topic itself unless it stands for its aliases only."""
    names = topics.select(normalize_topic(F.col(topic)).alias("topic")).where("topic <> ''").distinct()
    own = names.where(~F.col("topic").isin(*ALIAS_ONLY_TOPICS)).select("topic", F.col("topic").alias("variant"), F.lit(1000).alias("pos"))
    both = names.join(alias, "topic").select("topic", "variant", "pos").unionByName(own)
    return both.groupBy("topic", "variant").agg(F.min("pos").alias("pos"))


def expand_topics(user_topics: DataFrame, alias: DataFrame) -> DataFrame:
    """(user_id, queries): search terms of each user's topic list.

    ``user_topics`` is (user_id, topics array).  Topics are normalised and
    distinct in order, aliases expanded, variants of up to two characters
    dropped; "general news" when no specific topic is left, the topics
    themselves when no variant is.
    """
    normal = F.array_distinct(F.filter(F.transform("topics", normalize_topic), lambda t: t != ""))
    lists = user_topics.select("user_id", F.filter(normal, lambda t: t != "general").alias("topics"))
    exploded = lists.select("user_id", F.posexplode("topics").alias("tpos", "topic"))
    variants = topic_variants(exploded, alias)
    usable = exploded.join(variants, "topic").where(F.length("variant") > SHORT_VARIANT)
    first = usable.groupBy("user_id", "variant").agg(F.min(F.struct("tpos", "pos")).alias("at"))
    # a user's own topic list is short, and so is its expansion
    packed = F.array_sort(F.collect_list(F.struct("at", "variant")))
    expanded = first.groupBy("user_id").agg(F.transform(packed, lambda e: e["variant"]).alias("expanded"))
    queries = (
        F.when(F.size("topics") == 0, F.array(F.lit("general news")))
        .otherwise(F.coalesce("expanded", "topics"))
    )
    return lists.join(expanded, "user_id", "left").select("user_id", queries.alias("queries"))


def match_articles_topics(articles: DataFrame, variants: DataFrame, id_col: str, haystack: str) -> DataFrame:
    """Distinct (id, topic) of articles that name a topic by one of its variants.

    ``haystack`` is lower-case text; ``variants`` is (topic, variant).  Variants
    of up to two characters must stand alone, longer ones may be part of a word.
    The topic "general" matches every article and needs no join: see callers.
    """
    listed = small_list(variants, "variant")
    if listed is not None:
        # terms of one length hide none of each other, so each short length has a pass of its own
        found = [terms_in(F.col(haystack), [v for v in listed if len(v) > SHORT_VARIANT])]
        found += [terms_in(F.col(haystack), [v for v in listed if len(v) == n], BOUND_BEFORE, BOUND_AFTER) for n in range(1, SHORT_VARIANT + 1)]
        kept = articles.select(id_col, F.explode(F.concat(*found)).alias("variant"))
    else:
        hits = substring_matches(articles, id_col, haystack, variants.select("variant"), "variant", (1, 2, 3))
        short = hits.where(F.length("variant") <= SHORT_VARIANT)
        quoted = F.regexp_replace("variant", r"([^\p{L}\p{N}])", r"\\$1")
        bounded = F.concat(F.lit(BOUND_BEFORE), quoted, F.lit(BOUND_AFTER))
        alone = short.join(articles.select(id_col, haystack), id_col).where(F.rlike(F.col(haystack), bounded)).select(id_col, "variant")
        kept = hits.where(F.length("variant") > SHORT_VARIANT).unionByName(alone)
    return kept.join(variants.select("topic", "variant"), "variant").select(id_col, "topic").distinct()
