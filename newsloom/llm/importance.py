"""Documents drawn so that their words come to resemble those of a target corpus.

A text's ASCII letters are lower-cased and an untrained ``Split`` pre-tokeniser
of the tokenizers library cuts it into words with offsets.  Windows of one to
``max_n`` neighbouring offset pairs are the features; each counts in bucket
crc32 modulo ``buckets``.  Both corpora's histograms give each bucket a gain in
thousandths of a nat, a document's weight is the mean gain of its features, and
Gumbel noise from a hash of its id turns "highest scores" into a draw without
replacement in proportion to exp(weight).

Each text is read once: what is kept of it is its buckets with counts, at most
``buckets`` entries however long it is.  Of the corpus only ``buckets`` sums
come to the driver.  Ranks come from a histogram of the whole-numbered scores
and a window inside each score, so no task sees all rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from newsloom.llm.common import release, staged, text_slices

#: A word: neither ASCII control, blank nor punctuation.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000

_FEATURES = "doc_id bigint, n_words bigint, n_features bigint, buckets array<int>, counts array<bigint>"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_features", pa.int64()),
        ("buckets", pa.list_(pa.int32())),
        ("counts", pa.list_(pa.int64())),
    ]
)


def splitter() -> pre_tokenizers.PreTokenizer:
    return pre_tokenizers.Split(Regex(WORD), "removed", invert=True)


def windows(text: str, split: pre_tokenizers.PreTokenizer, max_n: int) -> Iterator[tuple[int, list[str]]]:
    """(new words, features that end in them) of each piece of a text."""
    tail: list[str] = []
    for piece in text_slices(text):
        # bytes.lower() changes A-Z only
        lowered = piece.encode().lower().decode()
        spans = [span for _, span in split.pre_tokenize_str(lowered)]
        words = tail + [lowered[a:b] for a, b in spans]
        features = words[len(tail) :]
        for n in range(2, max_n + 1):
            first = max(0, len(tail) - n + 1)
            features = features + [" ".join(words[i : i + n]) for i in range(first, len(words) - n + 1)]
        yield len(spans), features
        if max_n > 1:
            tail = words[-(max_n - 1) :]


def bucket_counts(text: str, split: pre_tokenizers.PreTokenizer, max_n: int, buckets: int) -> tuple[int, Counter]:
    """Words of a text and its features per bucket."""
    n_words, found = 0, Counter()
    for new, features in windows(text, split, max_n):
        n_words += new
        for feature, n in Counter(features).items():
            found[zlib.crc32(feature.encode()) % buckets] += n
    return n_words, found


def features(docs: DataFrame, doc_id: Column, text_col: str, max_n: int, buckets: int) -> DataFrame:
    """doc_id, n_words, n_features and the buckets with counts of every row; a null text has none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n_words, found = bucket_counts(text.as_py() or "", split, max_n, buckets)
                at = sorted(found)
                rows.append((doc, n_words, found.total(), at, [found[b] for b in at]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)

    return docs.select(doc_id.cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, _FEATURES)


def histogram(found: DataFrame, buckets: int) -> np.ndarray:
    """Features per bucket over all rows: ``buckets`` sums, whatever the corpus holds."""
    pairs = found.select(F.inline(F.arrays_zip("buckets", "counts")))
    sums = np.zeros(buckets, np.int64)
    for r in pairs.groupBy("buckets").agg(F.sum("counts").alias("n")).collect():
        sums[r["buckets"]] = r["n"]
    return sums


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed bucket shares, rounded down."""
    s, t = source.astype(float), target.astype(float)
    ratio = (t + 1) * (source.sum() + float(len(s))) / ((s + 1) * (target.sum() + float(len(t))))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weighted(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """The mean gain of each row's features, rounded down; 0 without any."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy()
            at, counts = batch.column(3), batch.column(4)
            ends = np.concatenate([[0], np.cumsum(gain[at.flatten().to_numpy()] * counts.flatten().to_numpy())])
            lengths = np.concatenate([[0], np.cumsum(at.value_lengths().to_numpy())])
            sums = ends[lengths[1:]] - ends[lengths[:-1]]
            weight = np.where(n > 0, sums // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def ranked(scored: DataFrame, share: tuple[int, int]) -> DataFrame:
    """``rank`` of the ``share`` (numerator, denominator) of eligible rows with the highest scores, null elsewhere.

    Scores are whole numbers within some ten thousands, so their histogram is
    small at every size; it gives the cut and each score's first rank.  A window
    inside each score numbers the rest: noise spreads even equal texts, so a
    score holds some ten-thousandths of the rows, and only those above the cut.
    """
    sizes = scored.where("eligible").groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    over = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        sizes.withColumn("wanted", F.expr(f"sum(n) OVER () * {int(share[0])} div {int(share[1])}"))
        .withColumn("above", F.coalesce(F.sum("n").over(over), F.lit(0)))
        .where("above < wanted")
        .select(F.col("score").alias("_score"), "above", "wanted")
    )
    near = scored.join(cut, F.col("eligible") & (F.col("score") == F.col("_score")), "left")
    inside = Window.partitionBy("score").orderBy("doc_id", "weight", "n_features")
    chosen = near.where("above IS NOT NULL").withColumn("rank", F.col("above") + F.row_number().over(inside))
    kept = F.when(F.col("rank") <= F.col("wanted"), F.col("rank"))
    columns = ("doc_id", "n_words", "n_features", "weight", "score")
    return chosen.select(*columns, kept.alias("rank")).unionByName(
        near.where("above IS NULL").select(*columns, F.lit(None).cast("bigint").alias("rank"))
    )


def resample(
    docs: DataFrame,
    target: DataFrame,
    share: tuple[int, int] = (10, 100),
    seed: int = 2024,
    min_words: int = 20,
    max_n: int = 2,
    buckets: int = BUCKETS,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score and rank (null: not drawn).

    Documents under ``min_words`` words are scored and never drawn.  Null and
    empty texts have no features and weight 0; a null id hashes as an empty one.
    Rows that repeat an id are documents of their own with the same noise; ties
    go to the smaller id (null first), then the smaller weight.  Columns other
    than id and text are not read.  ``share`` is exact: floor(n * a / b) rows.
    """
    found = staged(features(docs, F.col(id_col), text_col, max_n, buckets), "features")
    wanted = features(target, F.lit(None), target_col, max_n, buckets)
    gain = gains(histogram(found, buckets), histogram(wanted, buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = _weighted(found, gain).select(
        "*", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= min_words).alias("eligible")
    )
    scored = staged(scored, "scored")
    release(found)
    return ranked(scored, share)


def drawn(docs: DataFrame, ranks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``resample`` drew, with all their columns."""
    ids = ranks.where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn"))
    return docs.join(ids, docs[id_col].eqNullSafe(F.col("_drawn")), "left_semi")
