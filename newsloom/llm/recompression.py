"""Long repeats across documents, found by recompression.

A text's words are renamed in rounds: runs of one symbol become a symbol, then
pairs of a left and a right symbol become a symbol, where a bit of each symbol's
name says which side it is on.  Names are hashes of what they stand for, so all
documents name alike without a common table, and equal passages get equal
symbols except near their ends.  Each symbol carries the stretch of words that
its making depended on; if that stretch lies within a window, every equal window
holds the same symbol.

Each window is represented by the smallest symbol it is sure to hold, together
with the stretch that made it (a window without one stands for itself).  Symbols
that occur once cannot belong to a repeated window and drop out, which leaves a
small part of the corpus; the
windows of shared symbols are compared by a 128-bit BLAKE2 digest of their words,
and all but the first occurrence (by id, then place) are removed.

Ids are taken to be unique; rows that repeat a row get its result.  Rows with a
null id, a null text or fewer words than a window stay as they are and take no
part.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import WORD_GAP, mix64, release, staged, text_slices

WINDOW = 20
LEVELS = 2
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_BLANK = 0x20


def words(text: Column) -> Column:
    """Words of a text; none for null."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, WORD_GAP))


def word_line(text: str) -> bytes:
    """Words of a text in UTF-8 with one blank between; ``bytes.split`` knows the same gaps as WORD_GAP."""
    return b" ".join(filter(None, (b" ".join(part.encode().split()) for part in text_slices(text))))


def word_codes(text: str) -> np.ndarray:
    """64-bit hash of each word."""
    return np.concatenate([np.fromiter(map(xxhash.xxh3_64_intdigest, part.encode().split()), np.uint64) for part in text_slices(text)])


def window_digests(line: bytes, at: np.ndarray, window: int) -> np.ndarray:
    """Digest of the words of the windows that start at the words ``at``, each as two 64-bit numbers."""
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == _BLANK)
    starts, ends = np.r_[0, gaps + 1], np.r_[gaps, len(line)]
    view = memoryview(line)
    found = [blake2b(view[a:b], digest_size=16).digest() for a, b in zip(starts[at].tolist(), ends[at + window - 1].tolist())]
    return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)


def without_words(line: bytes, gone: np.ndarray) -> str:
    """What is left of a line once the words marked in ``gone`` are out."""
    data = np.frombuffer(line + b" ", np.uint8)
    sizes = np.diff(np.r_[0, np.flatnonzero(data == _BLANK) + 1])
    return data[np.repeat(~gone, sizes)].tobytes()[:-1].decode()


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of several documents in one array, a gap before, between and after; and where each starts."""
    sizes = np.array([len(p) for p in parts])
    starts = np.cumsum(np.r_[1, sizes[:-1] + 1])
    out = np.zeros(int(sizes.sum()) + len(parts) + 1, np.uint64)
    for s, p in zip(starts, parts):
        out[s : s + len(p)] = p
    return out, starts


def symbols(codes: np.ndarray, gaps: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first, end): symbols after some rounds, with the stretch each depends on."""
    name = mix64(codes + _STEP)
    gap = gaps.copy()
    first = np.arange(len(name))
    end = first + 1
    for level in range(levels):
        # runs: a symbol's run ends where its neighbours differ, so it depends on both
        start = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | gap[1:] | gap[:-1]])
        stop = np.r_[start[1:], len(name)]
        count = (stop - start).astype(np.uint64)
        lo, hi = first[np.maximum(start - 1, 0)], end[np.minimum(stop, len(name) - 1)]
        name = np.where(count > 1, mix64(name[start] ^ (count * _STEP)), name[start])
        gap, first, end = gap[start], lo, hi
        # pairs: a left symbol takes a right one after it; what stays alone depends on its neighbour
        side = (mix64(name + np.uint64((level + 1) * int(_STEP) % 2**64)) & np.uint64(1)).astype(bool)
        opens = ~side[:-1] & side[1:] & ~gap[:-1] & ~gap[1:]
        opener, closer = np.r_[opens, False], np.r_[False, opens]
        lo = np.where(side & ~closer, first[np.maximum(np.arange(len(name)) - 1, 0)], first)
        hi = np.where(~side & ~opener, end[np.minimum(np.arange(len(name)) + 1, len(name) - 1)], end)
        at = np.flatnonzero(opener)
        name[at] = mix64(mix64(name[at] + _STEP) ^ name[at + 1])
        hi[at] = hi[at + 1]
        kept = ~closer
        name, gap, first, end = name[kept], gap[kept], lo[kept], hi[kept]
    return name[~gap], np.minimum.accumulate(first[::-1])[::-1][~gap], np.maximum.accumulate(end)[~gap]


def stretch_keys(codes: np.ndarray, first: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """64-bit hash of the words in each stretch."""
    power = np.cumprod(np.r_[np.uint64(1), np.full(len(codes), base, np.uint64)])
    back = np.cumprod(np.r_[np.uint64(1), np.full(len(codes), pow(base, -1, 2**64), np.uint64)])
    sums = np.r_[np.uint64(0), np.cumsum(codes * power[:-1])]
    return mix64((sums[end] - sums[first]) * back[first] + (end - first).astype(np.uint64) * _STEP)


def anchors(parts: list[np.ndarray], window: int = WINDOW, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document number, symbol, first window, windows): what represents the windows of each document."""
    codes, starts = _joined(parts)
    sizes = np.array([len(p) for p in parts])
    gaps = np.ones(len(codes), bool)
    for s, n in zip(starts, sizes):
        gaps[s : s + n] = False
    counts = np.maximum(sizes - window + 1, 0)
    doc = np.repeat(np.arange(len(parts)), counts)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[doc]
    name, first, end = symbols(codes, gaps, levels)
    low, high = np.searchsorted(first, at, "left"), np.searchsorted(end, at + window, "right")
    inside = high - low
    best = np.full(len(at), 2**64 - 1, np.uint64)
    which = np.full(len(at), -1)
    padded = np.r_[name, np.zeros(1, np.uint64)]
    for k in range(int(inside.max(initial=0))):
        here = padded[np.minimum(low + k, len(name))]
        less = (k < inside) & (here < best)
        best[less], which[less] = here[less], (low + k)[less]
    # a symbol together with the words that made it: short symbols are met everywhere, those words are not
    alone = which < 0
    lo, hi = (np.where(alone, at + d, np.r_[x, 0][which]) for d, x in ((0, first), (window, end)))
    # neighbouring windows with the same occurrence of a symbol make one row
    new = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | alone[1:] | (doc[1:] != doc[:-1])]) if len(at) else np.empty(0, int)
    length = np.diff(np.r_[new, len(at)])
    keys = stretch_keys(mix64(codes + _STEP), lo[new], hi[new])
    return doc[new], keys, (at - starts[doc])[new], length


#: Words handled at once in a task; bounds its memory.
_AT_ONCE = 1 << 19


def _grouped(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    parts, start, held = [], 0, 0
    for i in range(batch.num_rows):
        parts.append(word_codes(batch.column(column)[i].as_py()))
        held += len(parts[-1])
        if held >= _AT_ONCE or i + 1 == batch.num_rows:
            yield start, parts
            parts, start, held = [], i + 1, 0


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for start, parts in _grouped(batch, 1):
                doc, name, first, length = anchors(parts, window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name.view(np.int64)), pa.array(ids[start + doc]), pa.array(first * window + length - 1)],
                    names=["symbol", "id", "span"],
                )

    # a span is one number, first * window + length - 1: at most a window's words share an occurrence
    return docs.mapInArrow(run, "symbol bigint, id bigint, span bigint")


def _window_rows(held: DataFrame, window: int) -> DataFrame:
    """(key, key2, id, place, repeated) of the candidate windows of each document.

    Windows that repeat one of the same document are known as such here; the
    others meet those of other documents by their keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, spans = batch.columns
            for i in range(batch.num_rows):
                first, length = np.divmod(spans[i].values.to_numpy(), window)
                length = length + 1
                at = np.unique(np.repeat(first - np.cumsum(length) + length, length) + np.arange(int(length.sum())))
                keys = window_digests(word_line(texts[i].as_py()), at, window).T
                order = np.lexsort((at, *keys))
                again = np.zeros(len(at), bool)
                again[order[1:]] = (keys[:, order[1:]] == keys[:, order[:-1]]).all(0)
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, keys), pa.array(np.full(len(at), ids[i].as_py())), pa.array(at.astype(np.int32)), pa.array(again)],
                    names=["key", "key2", "id", "place", "again"],
                )

    return held.mapInArrow(run, "key bigint, key2 bigint, id bigint, place int, again boolean")


def _sizes(docs: DataFrame, window: int) -> DataFrame:
    """(id, n_words, copy) of documents with a window; ``copy`` is the digest of all their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = (word_line(t.as_py()) for t in batch.column(1))
            found = [(line.count(b" ") + 1 if line else 0, blake2b(line, digest_size=16).digest()) for line in lines]
            sized = pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([d for _, d in found], pa.binary())], names=["id", "n_words", "copy"]
            )
            yield sized.filter(pa.array([n >= window for n, _ in found], pa.bool_()))

    return docs.mapInArrow(run, "id bigint, n_words bigint, copy binary")


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Documents that lose words: id, n_words, n_removed and ``kept_text`` (kept words, one blank between).

    A word goes if a window of ``window`` words covers it whose words occur, as a
    window, at an earlier place of the same document or in one of smaller id.
    Documents that keep all their words have no row.
    """
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    sized = staged(_sizes(docs, window), "sized")
    heads = sized.groupBy("copy").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head <> last")
    # all words of a later copy go, and what it repeats its first copy repeats as well
    copies = staged(sized.join(heads, "copy").where("id <> head").select("id", "n_words"), "copies")
    rest = docs.join(copies.select("id"), "id", "left_anti")
    rows = staged(_anchor_rows(rest, window), "anchors")
    # a table of its own, not a sum inside the join: then the join can split a frequent symbol
    shared = staged(rows.groupBy("symbol").agg(F.count("*").alias("n")).where("n > 1").select("symbol"), "shared")
    spans = staged(rows.join(shared, "symbol", "left_semi").groupBy("id").agg(F.collect_list("span").alias("spans")), "spans")
    release(rows, shared, sized)
    # only documents with shared symbols go on
    held = staged(docs.join(spans, "id"), "held")
    windows = staged(_window_rows(held.select("id", "text", "spans"), window), "windows")
    fresh = windows.where("NOT again")
    first = staged(fresh.groupBy("key", "key2").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").drop("high"), "first")
    later = fresh.join(first, ["key", "key2"]).where("id <> low").select("id", "place").union(windows.where("again").select("id", "place"))
    places = staged(later.groupBy("id").agg(F.collect_set("place").alias("places")), "places")
    release(windows, first, spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, places = batch.columns
            total, removed, kept = [], [], []
            for i in range(batch.num_rows):
                line = word_line(texts[i].as_py())
                at = places[i].values.to_numpy()
                step = np.zeros(line.count(b" ") + 2, np.int64)
                np.add.at(step, at, 1)
                np.add.at(step, at + window, -1)
                gone = np.cumsum(step[:-1]) > 0
                total.append(len(gone))
                removed.append(int(gone.sum()))
                kept.append(without_words(line, gone))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept_text"]
            )

    changed = held.select("id", "text").join(places, "id").mapInArrow(run, "id bigint, n_words bigint, n_removed bigint, kept_text string")
    gone = copies.select("id", "n_words", F.col("n_words").alias("n_removed"), F.lit("").alias("kept_text"))
    return changed.union(gone).withColumnRenamed("id", id_col)
