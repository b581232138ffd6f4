"""Document quality by pairwise ranking.

A Bradley-Terry model: document scores are linear in features of the text, and
the chance that one document is preferred to another is the logistic function
of the difference of their scores.  It is fitted on pairs of a preferred and a
rejected document, by Newton steps on the logistic loss of feature differences;
the decision threshold is a quantile of the training scores.

Only the training sample meets the driver: at most ``max_rows`` labelled rows of
a few numbers each.  Scoring is one pass over the table.

Null texts count as empty and get a score like all others; null or repeated
labels of a document count once (the smallest).  Without two classes to compare
every score is 0.5.  Extra columns pass through.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import in_worker

#: Labelled rows that a fit may use; which ones a hash of the id decides.
MAX_TRAINING_ROWS = 20_000

_SYMBOLS, _EXCLAIM, _UPPER, _DIGIT, _STOP, _OTHER = range(6)


def _classes() -> np.ndarray:
    kinds = np.full(0x250, _OTHER, np.uint8)
    for c in range(0x250):
        x = chr(c)
        if x in "#*$%&|<>~^_=+\\{}[]@":
            kinds[c] = _SYMBOLS
        elif x in "!?":
            kinds[c] = _EXCLAIM
        elif x.isupper():
            kinds[c] = _UPPER
        elif x.isdigit():
            kinds[c] = _DIGIT
        elif x in ".,;:":
            kinds[c] = _STOP
    return kinds


_KINDS = _classes()
FEATURES = ("words", "word_chars", "symbols", "exclaims", "upper", "digits", "stops", "repeats", "distinct", "dup_lines", "line_words")


def features(text: str) -> list[float]:
    """Length-independent measures of a whole text; ratios by their square root."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(_KINDS[np.minimum(codes, 0x24F)], minlength=6)
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(codes))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    repeats = sum(map(operator.eq, words, words[1:]))
    ratios = (
        kinds[_SYMBOLS] / chars,
        kinds[_EXCLAIM] / chars,
        kinds[_UPPER] / chars,
        kinds[_DIGIT] / chars,
        kinds[_STOP] / chars,
        repeats / n,
        # new words come more slowly in long texts: compare with a square-root law
        min(1.0, len(set(words)) / n**0.75),
        (len(lines) - len(set(lines))) / max(1, len(lines)),
    )
    return [
        np.log1p(len(words)) / 10,
        np.log1p(sum(map(len, words)) / n),
        *np.sqrt(ratios),
        np.log1p(n / max(1, len(lines))) / 10,
    ]


@dataclass(frozen=True)
class Ranking:
    """A fitted model: score = logistic(weights . (x - mean) / scale - threshold)."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    threshold: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - np.array(self.mean)) / np.array(self.scale) @ np.array(self.weights) - self.threshold
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(id_col: Column) -> Column:
    """Rows that must not teach the model: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", pairs_per_row: int = 8, ridge: float = 1e-2, seed: int = 7) -> Ranking:
    """Fit on labelled rows outside the held-out third.

    ``max_rows`` bounds the sample, taken by smallest hash of the id.
    """
    marked = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"))
        .where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_id")))
        .groupBy("_id")
        .agg(F.min("_label").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_rows)
    )
    # at most max_rows rows of two numbers: safe to copy to every task
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(marked), "_id")
    found = _featured(rows, "_text", "_features").select("_id", "_label", "_features").toPandas()
    found = found.sort_values("_id").drop_duplicates("_id")
    x = np.array(found["_features"].tolist(), float).reshape(-1, len(FEATURES))
    return fit_pairs(x, found["_label"].to_numpy(int), pairs_per_row, ridge, seed)


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs_per_row: int = 8, ridge: float = 1e-2, seed: int = 7) -> Ranking:
    """Newton's method on log(1 + exp(-w . (preferred - rejected))) + ridge * |w|^2 / 2."""
    width = x.shape[1]
    if not len(y) or y.min() == y.max():
        return Ranking((0.0,) * width, (1.0,) * width, (0.0,) * width, 0.0)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - mean) / scale
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(seed)
    n = pairs_per_row * max(len(good), len(bad))
    # every row meets several partners of the other class
    diff = z[np.resize(rng.permutation(good), n)] - z[rng.choice(bad, n)]
    w = np.zeros(width)
    for _ in range(50):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / n + ridge * np.eye(width), diff.T @ p / n - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    scores = np.sort(z @ w)
    cut = min(max(len(bad), 1), len(scores) - 1)
    threshold = (scores[cut - 1] + scores[cut]) / 2
    return Ranking(tuple(mean), tuple(scale), tuple(w), float(threshold))


def _featured(df: DataFrame, text_col: str, target: str) -> DataFrame:
    at = df.columns.index(text_col)
    width = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t or "") for t in batch.column(at).to_pylist()]
            flat = pa.array(np.array(x, float).reshape(-1), pa.float64())
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, width * len(x) + 1, width, dtype=np.int32)), flat)
            others = [(n, c) for i, (n, c) in enumerate(zip(batch.schema.names, batch.columns)) if i != at]
            yield pa.RecordBatch.from_arrays([*(c for _, c in others), rows], names=[*(n for n, _ in others), target])

    fields = [f for f in df.schema.fields if f.name != text_col]
    return df.mapInArrow(in_worker(run), T.StructType([*fields, T.StructField(target, T.ArrayType(T.DoubleType()))]))


def score(df: DataFrame, model: Ranking, text_col: str = "text", score_col: str = "score", drop_text: bool = False) -> DataFrame:
    """Add ``score_col``: 0 to 1, at least 0.5 where the document is above the threshold."""
    if score_col in df.columns:
        raise ValueError(f"column {score_col} exists already")
    at = df.columns.index(text_col)
    kept = [i for i in range(len(df.columns)) if i != at or not drop_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t or "") for t in batch.column(at).to_pylist()], float).reshape(-1, len(FEATURES))
            rest = batch.select(kept)
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(model.scores(x), pa.float64())], names=[*rest.schema.names, score_col])

    return df.mapInArrow(in_worker(run), T.StructType([*(df.schema.fields[i] for i in kept), T.StructField(score_col, T.DoubleType())]))
