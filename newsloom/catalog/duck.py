"""DuckDB text fragments that oracle queries share."""

from __future__ import annotations

from collections.abc import Sequence

from newsloom.functions import lexicon as L
from newsloom.functions import urls as U


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(items: Sequence[str]) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


def arr(items: Sequence[str]) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, {q(L.SPACE + '+')}, ' ', 'g')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{L.SPACE}+|{L.SPACE}+$')}, '', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(L.SPACE + '+')}), lambda w: w <> '')"


def sentences(x: str, enders: str = ".!?") -> str:
    marked = f"regexp_replace({x}, {q(f'([{enders}]){L.SPACE}+')}, '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"


def contained(x: str, terms: Sequence[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {q(t)}) AS INT)" for t in terms) + ")"


def any_of(x: str, terms: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(t)})" for t in terms) + ")"


def apostrophes(x: str) -> str:
    return f"translate({x}, {q(L.APOSTROPHES)}, {q(chr(39) * len(L.APOSTROPHES))})"


def unescape(x: str) -> str:
    """The character references that occur in the test tables."""
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("nbsp", "\xa0")):
        x = f"replace({x}, '&{name};', {q(char)})"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def normalize_text(x: str) -> str:
    return strip(collapse(f"regexp_replace(coalesce({x}, ''), {q(L.TRUNCATION_MARK)}, '', 'gi')"))


def clean_text(x: str) -> str:
    text = apostrophes(unescape(f"coalesce({x}, '')"))
    text = f"regexp_replace({text}, '<[^>]+>', '', 'g')"
    text = f"regexp_replace({text}, {q(L.TRUNCATION_MARK)}, '', 'gi')"
    return strip(collapse(text))


def strip_artifacts(x: str) -> str:
    text = f"replace({unescape(f'coalesce({x}, {q(str())})')}, {q(chr(0xA0))}, ' ')"
    for old, new in L.ARTIFACT_REPLACEMENTS:
        text = f"replace({text}, {q(old)}, {q(new)})"
    text = f"regexp_replace({text}, {q(L.TRUNCATION_MARK)}, '', 'gi')"
    text = f"regexp_replace({text}, {q(rf'\b(?:{L.LABEL_WORDS})\b\s*:?')}, '', 'gi')"
    text = f"regexp_replace({text}, {q(rf'(^|\n)\s*(?:{L.LINE_LABELS})\s*:\s*')}, '\\1', 'gi')"
    lines = f"list_transform(string_split(replace({text}, chr(13), chr(10)), chr(10)), lambda x: {strip(collapse('x'))})"
    return f"array_to_string(list_filter({lines}, lambda x: x <> ''), chr(10))"


def paragraphs(raw: str, cleaned: str) -> str:
    """``raw`` and ``cleaned`` are column names: stripped text and its artifact-free form."""
    blank = f"\n{L.SPACE}*\n"
    blocks = (
        f"list_filter(list_transform(regexp_split_to_array({raw}, {q(blank)}), lambda p: {strip_artifacts('p')}), lambda p: p <> '')"
    )
    lines = f"list_filter(string_split({cleaned}, chr(10)), lambda p: p <> '')"
    return (
        f"CASE WHEN regexp_matches({raw}, {q(blank)}) AND len({blocks}) > 0 THEN {blocks} "
        f"WHEN len({lines}) >= 3 THEN {lines} WHEN {cleaned} <> '' THEN [{cleaned}] ELSE CAST([] AS VARCHAR[]) END"
    )


def tokens(x: str) -> str:
    found = f"regexp_extract_all(lower({normalize_text(x)}), '[\\p{{L}}\\p{{N}}_'']+')"
    return f"list_filter({found}, lambda t: len(t) >= 2 AND t NOT IN {lst(L.VECTOR_STOPWORDS)})"


def keyword_words(x: str) -> str:
    return f"list_transform(list_filter({words(x)}, lambda w: len(w) > 3), lambda w: trim(lower(w), {q(L.KEYWORD_STRIP)}))"


def language_hint(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches(lower({x}), {q(L.CYRILLIC)}) THEN 'ru' "
        f"WHEN {contained(f'lower({x})', L.UZBEK_MARKERS)} >= 2 THEN 'uz' ELSE 'en' END"
    )


def hostname(x: str) -> str:
    host = f"lower(regexp_extract({x}, {q(U.HOST_PATTERN)}, 1))"
    return f"CASE WHEN {host} = '' THEN {x} ELSE {host} END"


def url_part(x: str, group: int) -> str:
    return f"regexp_extract({x}, {q(U.URL_PATTERN)}, {group})"


def decode_component(x: str) -> str:
    return f"url_decode(replace({x}, '+', ' '))"


def encode_component(x: str) -> str:
    return f"replace(url_encode({x}), '%20', '+')"


def normalize_source_url(x: str) -> str:
    scheme = f"lower(coalesce(nullif({url_part(x, 1)}, ''), 'http'))"
    authority = f"lower({url_part(x, 2)})"
    path = f"regexp_replace({url_part(x, 3)}, ';[^/]*$', '')"
    path = f"CASE WHEN len({path}) > 1 THEN regexp_replace({path}, '/+$', '') ELSE {path} END"
    name = decode_component("string_split(p, '=')[1]")
    value = decode_component("regexp_extract(p, '^[^=]*=(.*)$', 1)")
    kept = f"p <> '' AND NOT (starts_with({name}, 'utm_') OR {name} IN {lst(U.TRACKING_PARAMS)})"
    pairs = f"list_filter(string_split({url_part(x, 4)}, '&'), lambda p: {kept})"
    query = f"array_to_string(list_transform({pairs}, lambda p: {encode_component(name)} || '=' || {encode_component(value)}), '&')"
    return (
        f"CASE WHEN {x} <> '' THEN CASE WHEN {authority} <> '' THEN {scheme} || '://' || {authority} || {path} "
        f"ELSE {scheme} || CASE WHEN ({path}) = '' OR starts_with({path}, '/') THEN '://' ELSE ':' END || {path} END "
        f"|| CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END"
    )
