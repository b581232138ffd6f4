"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a built-in expression over the row itself, so the job is a
scan and a projection: nothing is shuffled and nothing leaves the JVM.

Null texts count as empty: no words, all counts 0, dropped by the base rule.
A null id stays null; repeated rows are each judged alone.  Extra columns are
left out of the result unless ``keep`` names them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.texts import bind
from newsloom.llm.common import WORD_GAP

SYMBOLS = "#*$%&|<>"
#: Frequent words of the languages that the corpus holds.
STOP_WORDS = tuple(
    "the of and to in is that for with was on as are by at from this it be or "
    "der die das und ist nicht mit von den ein zu im auf für sich des "
    "le la les de et est dans que qui pour sur une un du par des en avec "
    "el los las una por con del para se su es y".split()
)


@dataclass(frozen=True)
class Rule:
    """A document stays while ``low <= measure <= high``; a missing bound is open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: Measures are per word or per line, so they mean the same at any length.
RULES = (
    Rule("mean_word_chars", 2.0, 20.0),
    Rule("symbols_per_word", high=0.1),
    Rule("stop_words", low=2),
    Rule("shouted_words_ratio", high=0.3),
    Rule("exclaims_per_word", high=0.3),
    Rule("dup_lines_ratio", high=0.3),
    Rule("ellipsis_lines_ratio", high=0.3),
    Rule("bullet_lines_ratio", high=0.9),
)


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the row."""

    def count(starts: Column) -> Column:
        # starts ascend: each window adds what the next one does not cover
        steps = F.transform(starts, lambda s, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - s, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def twice(ordered: Column) -> Column:
        same = F.filter(
            ordered,
            lambda e, k: F.coalesce(F.get(ordered, k - 1)["h"] == e["h"], F.lit(False))
            | F.coalesce(F.get(ordered, k + 1)["h"] == e["h"], F.lit(False)),
        )
        return bind(F.sort_array(F.transform(same, lambda e: e["i"])), count)

    def windows(grams: Column) -> Column:
        ordered = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(bind(ordered, twice))

    def grams(hashed: Column) -> Column:
        heads = F.slice(hashed, F.lit(1), F.greatest(F.size(hashed) - 2, F.lit(0)))
        return bind(F.transform(heads, lambda h, i: F.xxhash64(h, F.get(hashed, i + 1), F.get(hashed, i + 2))), windows)

    return bind(F.transform(words, lambda w: F.xxhash64(w)), grams)


#: The characters of WORD_GAP one by one.
_GAPS = " \t\n\x0b\x0c\r"


def _without(text: Column, letters: str) -> Column:
    for letter in letters:
        text = F.replace(text, F.lit(letter), F.lit(""))
    return text


def _measures(text: Column, stop_words: Sequence[str]) -> Column:
    """All counts of a text as one struct.

    Plain searches and replacements run on bytes and cost far less than a lambda
    per word, so only the repeated windows go word by word.
    """
    has_words = F.rlike(text, F.lit(r"[^\x20\x09-\x0D]"))
    words = F.when(has_words, F.split(F.btrim(text, F.lit(_GAPS)), WORD_GAP)).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    symbols = F.when(F.rlike(text, F.lit(f"[{SYMBOLS}]")), F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", "")))
    stops = F.array(*map(F.lit, stop_words))

    def of(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).alias("n_words"),
            F.length(_without(text, _GAPS)).alias("word_chars"),
            F.coalesce(symbols, F.lit(0)).alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            _repeat_words(words).alias("n_repeat_words"),
            F.size(lines).alias("n_lines"),
            F.size(F.array_intersect(words, stops)).alias("stop_words"),
            F.size(F.regexp_extract_all(text, F.lit(r"(?:^|[\x20\x09-\x0D])(\p{Lu}{2})"), F.lit(1))).alias("n_shouted"),
            (F.length(text) - F.length(_without(text, "!"))).alias("n_exclaims"),
            F.size(F.filter(lines, lambda x: F.endswith(F.rtrim(x), F.lit("...")))).alias("n_ellipsis"),
            F.size(F.filter(lines, lambda x: F.ltrim(x).substr(1, 1).isin("-", "•", "*"))).alias("n_bullet"),
        )

    return bind(words, lambda w: bind(lines, lambda x: of(w, x)))


def quality_rules(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: Sequence[Rule] = RULES,
    stop_words: Sequence[str] = STOP_WORDS,
    min_words: int = 50,
    max_repeat_pct: int = 50,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Counts of each document and whether it passes the base rule and ``rules``."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    m = F.col("_measures")
    words, lines = F.greatest(m["n_words"], F.lit(1)), F.greatest(m["n_lines"], F.lit(1))
    measures = {
        "mean_word_chars": m["word_chars"] / words,
        "symbols_per_word": m["n_symbols"] / words,
        "stop_words": m["stop_words"],
        "shouted_words_ratio": m["n_shouted"] / words,
        "exclaims_per_word": m["n_exclaims"] / words,
        "dup_lines_ratio": m["n_dup_lines"] / lines,
        "ellipsis_lines_ratio": m["n_ellipsis"] / lines,
        "bullet_lines_ratio": m["n_bullet"] / lines,
    }
    passed = F.lit(True)
    for rule in rules:
        value = measures[rule.measure]
        if rule.low is not None:
            passed = passed & (value >= rule.low)
        if rule.high is not None:
            passed = passed & (value <= rule.high)
    failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"].cast("long") > max_repeat_pct * m["n_words"].cast("long"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    # the measures are an array's only element, so the optimizer cannot copy them into each use
    rows = df.select(
        F.col(f"`{id_col}`").alias(id_col),
        *(F.col(f"`{c}`") for c in keep),
        F.explode(F.array(_measures(text, stop_words))).alias("_measures"),
    )
    return rows.select(
        id_col,
        *keep,
        *(m[c].cast("long").alias(c) for c in counts),
        failed.alias("base_failed"),
        (~failed & passed).alias("kept"),
    )
