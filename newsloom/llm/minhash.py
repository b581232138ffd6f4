"""Near-duplicate documents by BagMinHash, banding and an exact check.

A document is the multiset of its five-word shingles.  BagMinHash gives a
signature whose components agree with probability equal to the weighted Jaccard
similarity: each shingle owns Poisson processes over the unit steps of its
multiplicity, arranged in doubling blocks; points come in ascending order, fall
on a random component and a random step, and a process stops once its points
come later than every component's best.  Documents that agree on a whole band of
components are candidates, and the overlap of the multisets themselves decides.

Exact copies are set aside first, so a group of them costs one row each.  In a
bucket the members are compared with one of them, not with each other, so a
bucket costs as many rows as it has members.  Where members of a bucket are still
in different classes then, an exact join on rare shingles finds every link that
is missing (see ``_missing_pairs``).

Documents of one to four words are one shingle as a whole.  Null texts and texts
without words have no shingle and stand alone.  Ids name documents: of rows that
share an id and differ in text the smallest class counts; rows with a null id get
no class and are left out.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import WORD_GAP, in_worker, mix64, staged

WORDS_PER_SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_codes(text: Column) -> Column:
    """32-bit codes of the words of a text, in order."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")
    return F.transform(words, lambda w: F.hash(w))


def shingles(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of all windows of five words, repeats included."""
    codes = codes.astype(np.uint32).astype(np.uint64)
    size = min(WORDS_PER_SHINGLE, len(codes))
    if not size:
        return np.empty(0, np.uint64)
    out = np.zeros(len(codes) - size + 1, np.uint64)
    for i in range(size):
        out = mix64((out ^ codes[i : i + len(out)]) + _STEP)
    return out


def _uniform(seeds: np.ndarray, n: int) -> np.ndarray:
    return ((mix64(seeds + np.uint64(n * int(_STEP) & (2**64 - 1))) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def signatures(bags: list[np.ndarray], width: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash signatures of several multisets at once, one row each."""
    sizes = np.array([len(b) for b in bags])
    owner = np.repeat(np.arange(len(bags)), sizes)
    values = np.concatenate(bags) if len(bags) else np.empty(0, np.uint64)
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])]) if len(values) else np.empty(0, int)
    weight = np.diff(np.r_[first, len(values)])
    owner, values = owner[first], values[first]
    # steps [0,1), [1,2), [2,4), [4,8), ... as far as each weight reaches
    parts = [(owner, values, weight, 0, 1)]
    low = 1
    while (more := weight > low).any():
        parts.append((owner[more], values[more], weight[more], low, 2 * low))
        low *= 2
    doc = np.concatenate([p[0] for p in parts])
    lows = np.concatenate([np.full(len(p[0]), p[3]) for p in parts])
    span = np.concatenate([np.full(len(p[0]), p[4] - p[3]) for p in parts])
    weight = np.concatenate([p[2] for p in parts])
    seed = mix64(np.concatenate([p[1] for p in parts]) + _STEP * (lows.astype(np.uint64) + np.uint64(1)))
    best = np.full(len(bags) * width, np.inf)
    time, turn = np.zeros(len(doc)), 0
    while len(doc):
        time = time - np.log(_uniform(seed, 3 * turn)) / (width * span)
        place = (_uniform(seed, 3 * turn + 1) * width).astype(np.int64)
        step = lows + (_uniform(seed, 3 * turn + 2) * span).astype(np.int64)
        hit = step < weight
        np.minimum.at(best, doc[hit] * width + place[hit], time[hit])
        going = time < best.reshape(-1, width).max(1)[doc]
        doc, lows, span, weight, seed, time = (x[going] for x in (doc, lows, span, weight, seed, time))
        turn += 1
    return best.reshape(-1, width)


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of components; the band's number is part of it."""
    bits = np.ascontiguousarray(sigs).view(np.uint64).reshape(len(sigs), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP, (len(sigs), BANDS))
    for i in range(ROWS):
        keys = mix64((keys ^ bits[:, :, i]) + _STEP)
    return keys.view(np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two multisets given as sorted arrays."""
    if not len(a) or not len(b):
        return 0.0
    u, n = np.unique(a, return_counts=True)
    v, m = np.unique(b, return_counts=True)
    at = np.searchsorted(v, u)
    at[at == len(v)] = 0
    shared = int(np.minimum(n, m[at])[v[at] == u].sum())
    return shared / (len(a) + len(b) - shared)


#: Shingles handled at once in a task; bounds its memory.
_AT_ONCE = 1 << 18


def _sketched(docs: DataFrame) -> DataFrame:
    """(id, copy key, band keys) of every document; no words: no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, codes = batch.columns
            bags, start, held = [], 0, 0
            for i in range(batch.num_rows):
                bags.append(shingles(codes[i].values.to_numpy()))
                held += len(bags[-1])
                if held >= _AT_ONCE or i + 1 == batch.num_rows:
                    bands = pa.array(band_keys(signatures(bags)).reshape(-1))
                    ends = pa.array(np.arange(0, BANDS * len(bags) + 1, BANDS, dtype=np.int32))
                    n = len(bags)
                    yield pa.RecordBatch.from_arrays([ids.slice(start, n), keys.slice(start, n), pa.ListArray.from_arrays(ends, bands)], names=["id", "copy", "bands"])
                    bags, start, held = [], i + 1, 0

    return docs.mapInArrow(in_worker(run), "id bigint, copy binary, bands array<bigint>")


def _verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """The pairs whose multisets overlap enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            a, b, codes_a, codes_b = batch.columns
            keep = []
            for i in range(batch.num_rows):
                if a[i].as_py() != last:
                    last, held = a[i].as_py(), shingles(codes_a[i].values.to_numpy())
                other = shingles(codes_b[i].values.to_numpy())
                if min(len(held), len(other)) >= SIMILARITY * max(len(held), len(other)) and overlap(held, other) >= SIMILARITY:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([a.take(pa.array(keep, pa.int64())), b.take(pa.array(keep, pa.int64()))], names=["a", "b"])

    wide = (
        pairs.join(bags.select(F.col("id").alias("b"), F.col("codes").alias("codes_b")), "b")
        .join(bags.select(F.col("id").alias("a"), F.col("codes").alias("codes_a")), "a")
        .select("a", "b", "codes_a", "codes_b")
    )
    return wide.mapInArrow(in_worker(run), "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(id, class): the smallest id that links lead to, for every id in ``links`` (a, b).

    Alternating large-star and small-star steps; each is one minimum per node and
    one join, and links stay as many as there are.  Every step is a written table.
    """
    both = lambda e: e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        near = both(edges)
        low = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        edges = near.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        low = edges.groupBy("a").agg(F.min("b").alias("low"))
        edges = edges.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        edges = staged(edges, "links")
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    # every edge now leads to its class
    return edges.select(F.col("a").alias("id"), F.col("b").alias("class")).union(edges.select("b", "b").distinct())


def _elements(bags: DataFrame) -> DataFrame:
    """(id, class, n, element): the shingles of each multiset, the k-th copy of one as an element of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, classes, codes = batch.columns
            for i in range(batch.num_rows):
                bag = np.sort(shingles(codes[i].values.to_numpy()))
                first = np.flatnonzero(np.r_[True, bag[1:] != bag[:-1]])
                copy = np.arange(len(bag)) - np.repeat(first, np.diff(np.r_[first, len(bag)]))
                element = mix64(bag + _STEP * copy.astype(np.uint64)).view(np.int64)
                n = len(bag)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, ids[i].as_py())), pa.array(np.full(n, classes[i].as_py())), pa.array(np.full(n, n, np.int32)), pa.array(element)],
                    names=["id", "class", "n", "element"],
                )

    return bags.mapInArrow(in_worker(run), "id bigint, class bigint, n int, element bigint")


def _missing_pairs(buckets: DataFrame, classes: DataFrame, bags: DataFrame) -> DataFrame:
    """Candidate pairs across the classes that still meet in a bucket; no link among them is left out.

    Two multisets that are similar enough share most of their elements, so each
    must have that share of elements that other classes hold too, and, all
    elements put in one order, the first few of both must have one in common.
    Rare elements come first in that order: a passage that many documents hold
    brings none of them together.
    """
    rows = buckets.join(classes, "id", "left").withColumn("class", F.coalesce("class", "id"))
    mixed = rows.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("bucket")
    left = rows.join(mixed, "bucket", "left_semi").select("id", "class").distinct()
    elements = staged(_elements(bags.join(left, "id").select("id", "class", "codes")), "elements")
    shared = (
        elements.groupBy("element")
        .agg(F.count("*").alias("n_docs"), F.min("class").alias("low"), F.max("class").alias("high"))
        .where("low <> high")
        .select("element", "n_docs")
    )
    least = F.ceil(F.col("n") * F.lit(SIMILARITY) - 1e-9)
    first = (
        elements.join(shared, "element")
        .groupBy("id", "class", "n")
        .agg(F.sort_array(F.collect_list(F.struct("n_docs", "element"))).alias("held"))
        .where(F.size("held") >= least)
        # elements that no other class holds come first in the order and need no rows
        .select(
            "id", "class", "n", (F.col("n") - F.size("held")).alias("alone"),
            F.slice(F.transform("held", lambda e: e["element"]), F.lit(1), F.greatest(F.size("held") - least + 1, F.lit(0)).cast("int")).alias("head"),
        )
        .select("id", "class", "n", "alone", "head", F.posexplode("head"))
        .select("id", "class", "n", (F.col("alone") + F.col("pos")).alias("before"), F.slice("head", F.lit(1), F.col("pos")).alias("earlier"), F.col("col").alias("element"))
    )
    first = staged(first, "first")
    a, b = first.alias("a"), first.alias("b")
    # elements that two such multisets must share, and so may come from the first one on
    both = F.ceil((F.col("a.n") + F.col("b.n")) * F.lit(SIMILARITY / (1 + SIMILARITY)) - 1e-9)
    near = (F.col("a.n") - F.col("a.before") >= both) & (F.col("b.n") - F.col("b.before") >= both)
    similar = F.least("a.n", "b.n") >= F.lit(SIMILARITY) * F.greatest("a.n", "b.n")
    # a pair meets once, at the first element that both hold
    once = ~F.arrays_overlap("a.earlier", "b.earlier")
    return (
        a.join(b, (F.col("a.element") == F.col("b.element")) & F.expr("a.class < b.class") & similar & near & once)
        .select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))
    )


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col`` and ``class_id``, the smallest id of its class.

    Classes are the connected groups of documents that are copies or have a
    weighted Jaccard similarity of at least 0.8.
    """
    docs = (
        df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
        .where("id IS NOT NULL")
        .select(
            "id",
            word_codes(F.col("text")).alias("codes"),
            F.unhex(F.md5(F.regexp_replace(F.coalesce("text", F.lit("")), WORD_GAP, " "))).alias("copy"),
        )
    )
    sketches = staged(_sketched(docs.where(F.size("codes") > 0).select("id", "copy", "codes")), "sketches")
    copies = staged(sketches.groupBy("copy").agg(F.min("id").alias("id"), F.min_by("bands", "id").alias("bands")), "copies")
    members = copies.select("id", F.explode("bands").alias("bucket"))
    heads = members.groupBy("bucket").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head <> last").select("bucket", "head")
    buckets = staged(members.join(heads, "bucket"), "buckets")
    bags = staged(docs.select("id", "codes").join(buckets.select("id").distinct(), "id", "left_semi"), "bags")
    # each member against the smallest of its bucket
    pairs = buckets.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    links = staged(_verified(pairs, bags), "verified")
    more = _verified(_missing_pairs(buckets.select("id", "bucket"), components(links), bags), bags)
    classes = components(links.union(more))
    known = sketches.select("id", "copy").join(copies.select("copy", F.col("id").alias("kept")), "copy")
    found = known.join(classes.select(F.col("id").alias("kept"), "class"), "kept", "left")
    found = found.groupBy("id").agg(F.min(F.coalesce("class", "kept")).alias("class_id"))
    ids = df.select(F.col(id_col).cast("bigint").alias("id")).where("id IS NOT NULL").distinct()
    return ids.join(found, "id", "left").select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"))
