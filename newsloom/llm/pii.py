"""Personal data in texts: fixed patterns, and more spans by weak supervision.

The base patterns (email, ip, card, phone) always count.  Besides them, words
with digits are candidates for secrets, and so are words without one that begin
with a listed prefix or are assigned to a word for a secret.  Several labelers - patterns, word lists
and context - each vote for, against or not at all; expectation-maximisation
estimates how reliable each labeler is and how likely each voting pattern means
personal data, without any labelled rows.  A logistic classifier on features of
the span learns these likelihoods and decides.

What the fit gathers is a count per (votes, features) pair, bounded by the
number of patterns, not by the corpus: at most 3**LABELERS voting patterns and
2**FEATURES feature patterns, each summed by Spark.

Positions are code points, ends exclusive.  Null texts count as empty.  Ids are
not looked at, so null or repeated ids are fine; extra columns pass through.
Every scan is linear in the text, however long.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import in_worker, staged

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")

# possessive repeats match as the plain ones do here, since what follows never fits them
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: A candidate: a word of letters, digits and joiners with a digit in it.
_WORD = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z_/+-]*+[0-9][A-Za-z0-9_/+-]*+")
MIN_CANDIDATE = 6

# word lists of the labelers
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "glpat-", "sk-", "sk_", "pk_", "xoxb-", "xoxp-", "eyJ", "AIza")
SECRET_WORDS = re.compile(r"(?i)(?:token|passw(?:or)?d|pwd|secret|api.?key|access.?key|bearer|credential)")
_ASSIGNED = re.compile(
    r"(?:[tT]oken|TOKEN|[pP]assw(?:or)?d|PASSW(?:OR)?D|[pP]wd|PWD|[sS]ecret|SECRET|(?:[aA]pi|API|[aA]ccess|ACCESS)[ _-]?(?:[kK]ey|KEY)|[bB]earer|[cC]redential)s?"
    r"[\"']?[ \t]*[=:][ \t]*[\"']?(?=([A-Za-z0-9_/+-]+))"
)
_PREFIXED = re.compile("(?<![A-Za-z0-9_/+-])(?=(?:" + "|".join(map(re.escape, KEY_PREFIXES)) + ")([A-Za-z0-9_/+-]*))")
PLAIN_WORDS = re.compile(r"(?i)(?:version|chapter|section|page|figure|table|vol|isbn|doi|license|edition|rev)\W*\Z")

LABELERS = ("prefix", "secret_word", "plain_word", "assigned", "entropy", "shape")
FEATURES = 10
#: Characters before a span that the context labelers read.
CONTEXT = 24


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_LETTERS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        # letters before an @ are looked at once: no match can start before it again
        done = max(done, at + 1)
        at = text.find("@", done)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if len(m[0]) <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the fixed patterns, by start, then kind."""
    found: list[tuple[int, int, int]] = []
    if "@" in text:
        found += [(s, e, 0) for s, e in _emails(text)]
    if _DIGIT.search(text):
        found += [(s, e, 1) for s, e in _ips(text)]
        found += [(s, e, 2) for s, e in _cards(text)]
        if "+" in text:
            found += [(s, e, 3) for s, e in _phones(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def _words(text: str) -> Iterator[tuple[int, int]]:
    """Words with a digit, and words without one that a prefix or an assignment points at; by start."""
    found = [m.span() for m in _WORD.finditer(text)] if _DIGIT.search(text) else []
    pointed = [(m.start(), m.end(1)) for m in _PREFIXED.finditer(text)]
    if "=" in text or ":" in text:
        pointed += [m.span(1) for m in _ASSIGNED.finditer(text)]
    more = [(s, e) for s, e in pointed if not _DIGIT.search(text, s, e)]
    return iter(sorted({*found, *more}) if more else found)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Words that may be secrets and that no base span cuts or covers; a word may hold base spans."""
    spans = sorted({(s, e) for s, e, _ in taken})
    ends = np.maximum.accumulate([e for _, e in spans]) if spans else []
    starts, same = [s for s, _ in spans], set(spans)
    for start, end in _words(text):
        while end > start and text[end - 1] in "_/+-":
            end -= 1
        if end - start < MIN_CANDIDATE:
            continue
        if spans:
            left, inner = np.searchsorted(starts, (start, end))
            if (start, end) in same or left and ends[left - 1] > start or inner and ends[inner - 1] > end:
                continue
        yield start, end


def _entropy(word: str) -> float:
    n = len(word)
    return -sum(c / n * math.log2(c / n) for c in Counter(word).values())


def describe(text: str, start: int, end: int) -> tuple[int, int]:
    """Votes of the labelers as a base-3 number, and the feature bits."""
    word, before = text[start:end], text[max(0, start - CONTEXT) : start]
    n = len(word)
    digits, lower, upper = (sum(map(f, word)) for f in (str.isdigit, str.islower, str.isupper))
    mixed = digits >= 2 and lower + upper >= 2
    hexed = all(c in "0123456789abcdef" for c in word) or all(c in "0123456789ABCDEF" for c in word)
    spread = _entropy(word)
    near, plain = SECRET_WORDS.search(before) is not None, PLAIN_WORDS.search(before) is not None
    assigned = before.rstrip(" \"'")[-1:] in ("=", ":") or before[-1:] in ("\"", "'")
    known = word.startswith(KEY_PREFIXES)
    votes = (
        1 if known else 0,
        1 if near else 0,
        -1 if plain else 0,
        1 if assigned else 0,
        1 if n >= 16 and spread >= 3 else -1 if spread < 2.2 else 0,
        1 if n >= 16 and mixed else -1 if digits == n and n < 9 else 0,
    )
    code = 0
    for v in votes:
        code = 3 * code + v + 1
    bits = (mixed, hexed, n >= 12, n >= 16, n >= 32, spread >= 3, upper + digits == n and upper > 0, digits == n, near or assigned, known)
    return code, sum(1 << i for i, b in enumerate(bits) if b)


@dataclass(frozen=True)
class SpanModel:
    """Reliability of each labeler, and the classifier's weights."""

    reliability: dict[str, float]
    weights: tuple[float, ...]
    bias: float

    def chance(self, bits: int) -> float:
        z = self.bias + sum(w for i, w in enumerate(self.weights) if bits >> i & 1)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _vote_matrix(codes: np.ndarray) -> np.ndarray:
    """Votes (0 against, 1 none, 2 for) of each labeler from the base-3 numbers."""
    powers = 3 ** np.arange(len(LABELERS) - 1, -1, -1)
    return codes[:, None] // powers % 3


def estimate(codes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, dict[str, float]]:
    """EM over voting patterns: each pattern's chance to mean personal data, each labeler's reliability.

    Votes are independent given the class; a labeler is known by its chances to
    vote for, against or not at all in either class.
    """
    votes = _vote_matrix(codes)
    post = 1 / (1 + np.exp(-1.5 * (votes - 1).sum(1) + 0.75))
    table = np.zeros((2, len(LABELERS), 3))
    for _ in range(rounds):
        prior = np.clip((counts * post).sum() / counts.sum(), 1e-6, 1 - 1e-6)
        for k, share in enumerate((1 - post, post)):
            for v in range(3):
                # a labeler is taken to be rather right than wrong until the counts say otherwise
                table[k, :, v] = ((votes == v) * (counts * share)[:, None]).sum(0) + (1.0 if v == 2 * k else 0.5)
        chances = table / table.sum(2, keepdims=True)
        log = [np.log(chances[k][np.arange(len(LABELERS)), votes]).sum(1) for k in (0, 1)]
        fresh = 1 / (1 + np.exp(np.clip(log[0] - log[1] + np.log((1 - prior) / prior), -50, 50)))
        done = np.abs(fresh - post).max() < 1e-7
        post = fresh
        if done:
            break
    cast = table[:, :, [0, 2]].sum(2)
    right = table[1, :, 2] + table[0, :, 0]
    return post, dict(zip(LABELERS, np.round(right / (cast.sum(0) + 1e-9), 4).tolist()))


def fit_bits(bits: np.ndarray, positive: np.ndarray, total: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression on feature bits with soft labels, by Newton steps."""
    x = np.hstack([(bits[:, None] >> np.arange(FEATURES)) & 1, np.ones((len(bits), 1))]).astype(float)
    w = np.zeros(FEATURES + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (total * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (positive - total * p) - ridge * w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(df: DataFrame, text_col: str = "text") -> SpanModel:
    """Estimate labelers and classifier from all texts of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    base = base_spans(text)
                    found.update(describe(text, s, e) for s, e in candidates(text, base))
        rows = list(found.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _ in rows], pa.int64()), pa.array([k[1] for k, _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.int64())],
            names=["votes", "bits", "n"],
        )

    spans = df.select(text_col).mapInArrow(in_worker(run), "votes bigint, bits bigint, n bigint")
    spans = staged(spans.groupBy("votes", "bits").agg(F.sum("n").alias("n")), "votes")
    # at most 3**LABELERS and 2**FEATURES rows
    patterns = spans.groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").toPandas()
    if patterns.empty:
        return SpanModel({}, (0.0,) * FEATURES, -30.0)
    post, reliability = estimate(patterns["votes"].to_numpy(), patterns["n"].to_numpy(float))
    chances = df.sparkSession.createDataFrame(
        [(int(v), float(p)) for v, p in zip(patterns["votes"], post)], "votes bigint, chance double"
    )
    soft = (
        spans.join(F.broadcast(chances), "votes").groupBy("bits").agg(F.sum(F.col("n") * F.col("chance")).alias("positive"), F.sum("n").alias("n"))
    ).orderBy("bits").toPandas()
    weights, bias = fit_bits(soft["bits"].to_numpy(int), soft["positive"].to_numpy(float), soft["n"].to_numpy(float))
    return SpanModel(reliability, tuple(weights.tolist()), bias)


def all_spans(text: str, model: SpanModel, threshold: float = 0.5) -> list[tuple[int, int, int, bool]]:
    """(start, end, kind number, base) of base spans and of what the classifier adds."""
    base = base_spans(text)
    found = [(s, e, k, True) for s, e, k in base]
    for s, e in candidates(text, base):
        if model.chance(describe(text, s, e)[1]) >= threshold:
            found.append((s, e, len(BASE_KINDS), False))
    return sorted(found, key=lambda x: (x[0], x[2]))


_SPAN = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())])
)
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def _masked(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    out, done = [], 0
    for start, end, kind, _ in spans:
        if start >= done:
            out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join(out) + text[done:]


def find(df: DataFrame, model: SpanModel, text_col: str = "text", spans_col: str = "pii_spans", mask: bool = False, drop_text: bool = False) -> DataFrame:
    """Add the spans of each text; ``mask`` also replaces them in the text by their kind."""
    if spans_col in df.columns:
        raise ValueError(f"column {spans_col} exists already")
    at = df.columns.index(text_col)
    kept = [i for i in range(len(df.columns)) if i != at or not drop_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = [all_spans(t, model) if t else [] for t in texts]
            named = pa.array([[{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, e, k, b in x] for x in found], _SPAN_ARROW)
            columns = {i: batch.column(i) for i in kept}
            if mask and at in columns:
                columns[at] = pa.array([_masked(t, x) if x else t for t, x in zip(texts, found)], pa.string())
            yield pa.RecordBatch.from_arrays([*columns.values(), named], names=[*(batch.schema.names[i] for i in kept), spans_col])

    return df.mapInArrow(in_worker(run), T.StructType([*(df.schema.fields[i] for i in kept), T.StructField(spans_col, _SPAN)]))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    """How many of the spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
