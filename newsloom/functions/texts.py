"""Text column builders: cleaning, splitting, tokens.  No Python UDFs."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import lexicon as L


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse_space(c: Column) -> Column:
    return F.regexp_replace(c, L.SPACE + "+", " ")


def strip(c: Column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.regexp_replace(c, f"{_NO_MARK}(?:^{L.SPACE}+|{L.SPACE}+$)", "")


# Most characters are no white space, and this says so at once where the class of all white space goes through its parts.
_NO_MARK = "(?![!-~])"


def words(c: Column, first: int = 0) -> Column:
    """White-space separated pieces; of the ``first`` if given at least, and what comes after may be one piece."""
    # a blank start makes one more piece, the rest another
    return F.filter(F.split(c, L.SPACE + "+", first + 2 if first else -1), lambda w: w != "")


def sentences(c: Column, enders: str = ".!?") -> Column:
    """Stripped sentences; a sentence ends at a mark that white space follows."""
    parts = F.split(c, rf"(?<=[{enders}]){L.SPACE}+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def sentence_count(c: Column, enders: str = ".!?") -> Column:
    """How many ``sentences`` a text has: one more than the gaps between them."""
    gaps = F.regexp_count(c, F.lit(rf"(?<=[{enders}]){L.SPACE}+(?!{L.SPACE}|\z)"))
    return F.when(c.rlike(rf"[^{L.SPACE}]"), gaps + 1).otherwise(0)


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({L.WORD}+)"), F.lit(1))


def contains_any(c: Column, terms: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(t) for t in terms])


def count_contained(c: Column, terms: Sequence[str]) -> Column:
    """How many of ``terms`` occur in the text at least once."""
    return reduce(lambda a, b: a + b, [c.contains(t).cast("int") for t in terms])


def normalize_apostrophes(c: Column) -> Column:
    return F.translate(c, L.APOSTROPHES, "'" * len(L.APOSTROPHES))


# The standard's named references, from the standard library: names that need
# the semicolon, and the few legacy ones that work without it.
_NAMED = {n[:-1]: v for n, v in html5.items() if n.endswith(";")}
_NAMED_JSON = json.dumps(_NAMED)
_LEGACY = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)
_ENTITY = rf"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;|{'|'.join(_LEGACY)})"


def _code_point(number: Column) -> Column:
    """Character of a code point; the replacement character when it has none."""
    valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
    utf32 = F.unhex(F.lpad(F.hex(F.when(valid, number).otherwise(0xFFFD)), 8, "0"))
    return F.decode(utf32, "UTF-32")


def unescape_html(c: Column) -> Column:
    """Named and numeric character references to characters.

    The text is cut at ``&`` and each piece resolves its own reference; texts
    without ``&`` skip the work.
    """
    # one foldable literal instead of thousands of expression nodes
    table = F.from_json(F.lit(_NAMED_JSON), "map<string,string>")

    def resolve(piece: Column, i: Column) -> Column:
        ref = F.regexp_extract(piece, _ENTITY, 1)
        name = F.rtrim(ref, F.lit(";"))
        decimal = F.conv(F.substring(name, 2, 12), 10, 10).cast("bigint")
        hexa = F.conv(F.substring(name, 3, 12), 16, 10).cast("bigint")
        char = (
            F.when(name.rlike("^#[0-9]"), _code_point(decimal))
            .when(name.rlike("^#[xX]"), _code_point(hexa))
            .otherwise(F.try_element_at(table, name))
        )
        rest = F.substring(piece, F.length(ref) + 1, F.length(piece))
        # an unknown reference makes the concat null and keeps the piece as it is
        return F.when(i == 0, piece).otherwise(F.coalesce(F.concat(char, rest), F.concat(F.lit("&"), piece)))

    return bind(c, lambda x: F.when(x.contains("&"), F.array_join(F.transform(F.split(x, "&"), resolve), "")).otherwise(x))


def strip_tags(c: Column, replacement: str = "") -> Column:
    return F.regexp_replace(c, "<[^>]+>", replacement)


def clean_text(c: Column) -> Column:
    """Readable text: references, apostrophes, tags, cut marks and white space."""
    text = strip_tags(normalize_apostrophes(unescape_html(F.coalesce(c, F.lit("")))))
    text = F.regexp_replace(text, "(?i)" + L.TRUNCATION_MARK, "")
    return strip(collapse_space(text))


def normalize_text(c: Column) -> Column:
    """Cut marks dropped and white space collapsed; the input of vectors."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), "(?i)" + L.TRUNCATION_MARK, "")
    return strip(collapse_space(text))


def strip_artifacts(c: Column) -> Column:
    """Remove encoding debris, template labels and cut marks; tidy each line."""
    text = F.replace(unescape_html(F.coalesce(c, F.lit(""))), F.lit("\xa0"), F.lit(" "))
    for old, new in L.ARTIFACT_REPLACEMENTS:
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.regexp_replace(text, "(?i)" + L.TRUNCATION_MARK, "")
    return tidy_lines(F.replace(drop_labels(text), F.lit("\r"), F.lit("\n")))


def drop_labels(c: Column) -> Column:
    """Template labels cut; texts that hold none of their first words skip the patterns."""

    def cut(x: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(x, _LABELS + r"\s*:?", ""), _LINE_LABELS + r"\s*", "$1")
        return F.when(may_hold_labels(x), bare).otherwise(x)

    return bind(c, cut)


def may_hold_labels(c: Column) -> Column:
    """Whether a label's first word occurs anywhere, ignoring case; without it no label pattern matches."""
    # the only other letters that the patterns take for i, s and k
    return bind(F.lower(c), lambda low: contains_any(low, _LABEL_STARTS)) | contains_any(c, ("\u0131", "\u0130", "\u017f", "\u212a"))


_LABEL_STARTS = sorted({w.split(r"\s")[0] for w in f"{L.LABEL_WORDS}|{L.LINE_LABELS}".split("|")})
_LABELS = rf"(?iU)\b(?:{L.LABEL_WORDS})\b"
_LINE_LABELS = rf"(?iU)(^|\n)\s*(?:{L.LINE_LABELS})\s*:"


def tidy_lines(c: Column) -> Column:
    """Each line stripped, its white space collapsed, blank lines dropped; all lines in one pass."""
    gap, other = f"[{L.SPACE}&&[^\\n]]", f"[{L.SPACE}&&[^\\n ]]"
    # a single blank stays as it is, so that it costs no replacement
    blanks = F.regexp_replace(c, f"{_NO_MARK}(?:{other}{gap}*| {gap}+)", " ")
    return F.btrim(F.regexp_replace(blanks, " ?\\n[ \\n]+| \\n", "\n"), F.lit(" \n"))


def has_artifacts(c: Column) -> Column:
    """Whether ``strip_artifacts`` may change what it returned before."""
    marks = contains_any(c, ("&", "\xa0", "\r", "[+", *(old for old, _ in L.ARTIFACT_REPLACEMENTS)))
    return marks | (may_hold_labels(c) & (c.rlike(_LABELS) | c.rlike(_LINE_LABELS)))


def paragraph_count(c: Column) -> Column:
    """How many ``paragraphs`` a text has that ``strip_artifacts`` returned: its lines are stripped and none is blank."""
    again = F.when(has_artifacts(c), strip_artifacts(c)).otherwise(c)
    return bind(again, lambda x: F.when(x == "", 0).otherwise(bind(F.size(F.split(x, "\n")), lambda n: F.when(n >= 3, n).otherwise(1))))


def paragraphs(c: Column) -> Column:
    """Blank-line blocks, else lines when there are three or more, else one block."""
    blank = rf"\n{L.SPACE}*\n"
    none = F.array().cast("array<string>")

    def filled(parts: Column) -> Column:
        return F.filter(parts, lambda p: p != "")

    def blocks(raw: Column) -> Column:
        cleaned = filled(F.transform(F.split(raw, blank), strip_artifacts))
        return F.when(raw.rlike(blank), bind(cleaned, lambda b: F.when(F.size(b) > 0, b)))

    def lines(cleaned: Column) -> Column:
        whole = F.when(cleaned != "", F.array(cleaned)).otherwise(none)
        return bind(filled(F.split(cleaned, "\n")), lambda x: F.when(F.size(x) >= 3, x).otherwise(whole))

    raw = strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\r"), F.lit("\n")))
    return bind(raw, lambda r: F.coalesce(blocks(r), bind(strip_artifacts(r), lines)))


def clean_paragraphs(c: Column) -> Column:
    """``paragraphs`` of a text that ``strip_artifacts`` returned: it has no blank lines, and mostly nothing to remove again."""
    again = F.when(has_artifacts(c), strip_artifacts(c)).otherwise(c)
    none = F.array().cast("array<string>")
    return bind(again, lambda x: bind(F.split(x, "\n"), lambda ls: F.when(x == "", none).when(F.size(ls) >= 3, ls).otherwise(F.array(x))))


def tokenize(c: Column) -> Column:
    """Lower-case tokens of at least two characters that are not stopwords."""
    tokens = F.regexp_extract_all(F.lower(normalize_text(c)), F.lit(r"([\p{L}\p{N}_']+)"), F.lit(1))
    return F.filter(tokens, lambda t: (F.length(t) >= 2) & ~t.isin(*L.VECTOR_STOPWORDS))


def keyword_words(c: Column) -> Column:
    """Pieces longer than three characters, lower-cased, punctuation trimmed."""
    long_words = F.filter(words(c), lambda w: F.length(w) > 3)
    return F.transform(long_words, lambda w: F.btrim(F.lower(w), F.lit(L.KEYWORD_STRIP)))


def keyword_set(c: Column) -> Column:
    return F.array_distinct(keyword_words(c))


def contains_cyrillic(c: Column) -> Column:
    return c.rlike(L.CYRILLIC)


def language_hint(c: Column) -> Column:
    """ru for any Cyrillic letter, uz for two markers, else en."""
    text = F.lower(F.coalesce(c, F.lit("")))
    return (
        F.when(contains_cyrillic(text), "ru").when(count_contained(text, L.UZBEK_MARKERS) >= 2, "uz").otherwise("en")
    )
