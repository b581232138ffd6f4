"""Exact top-k inner products by MaxScore, shard by shard.

Vectors are rounded to integers and packed into shards, one list of values per
component (its postings).  A query's components are its terms.  Within a shard a
term cannot add more than its largest product; sorted by what they can add, the
terms split into *essential* ones, without which no row can reach the current
k-th best score, and the rest.  Essential postings are traversed for all rows;
the others are probed in small groups, and only for rows that are still
competitive.  Each task keeps its k best per query over all its shards, so the
threshold rises as it goes; the tasks' lists are merged at the end.

Queries meet shards block against block: the work is that of the stated query
set against all rows, and no row is expanded into pairs outside a task's arrays.

Rows without id take no part, nor do vectors that are null or hold a null, NaN
or infinite component (or one that is infinite once multiplied).  All other
vectors count, whatever their size: a block's sums are taken in doubles, in 64
bits or in Python's integers, whichever its largest values need to be exact, and
a score beyond 64 bits counts as the largest or smallest one that fits.  Of rows
that share an id the smallest vector counts.  Shorter vectors count as filled up
with zeros.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Scores are kept within these bounds, so that their negative fits too.
LARGEST = (1 << 63) - 1


def rounded(vector: Column, factor: int = 1024) -> Column:
    """floor(factor * x) of each component as whole doubles; null if one cannot be used."""

    def floor(y: Column) -> Column:
        # doubles from 2**53 on are whole numbers
        return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)

    values = F.transform(vector, lambda x: F.lit(float(factor)) * x.cast("double"))
    usable = F.forall(vector, lambda x: x.isNotNull() & (F.abs(F.lit(float(factor)) * x.cast("double")) < float("inf")))
    return F.when(vector.isNotNull() & usable, F.transform(values, floor))


def whole(values: np.ndarray, kind: type) -> np.ndarray:
    """Whole doubles or integers as doubles, 64-bit integers or Python's integers."""
    if kind is object:
        return np.array([int(x) for x in values.ravel()], object).reshape(values.shape)
    return values.astype(kind)


def kept_to_64_bits(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object:
        return np.array([min(max(x, -LARGEST), LARGEST) for x in scores], np.int64)
    return scores.astype(np.int64)


class TopK:
    """The k best (score, id) per query so far; ties go to the smaller id."""

    def __init__(self, k: int):
        self.k, self.best = k, {}

    def threshold(self, query: int) -> float:
        found = self.best.get(query)
        return -np.inf if found is None or len(found[0]) < self.k else int(found[0][-1])

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if query in self.best:
            scores, ids = np.concatenate([self.best[query][0], scores]), np.concatenate([self.best[query][1], ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.best[query] = scores[order], ids[order]


class Shard:
    """Postings of a block of rows, with each term's largest and smallest value."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids = ids
        self.rows = np.ascontiguousarray(rows.T)
        self.largest = float(np.abs(self.rows).max(initial=0))
        self.forms: dict[type, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def form(self, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Postings, largest and smallest values in numbers of one kind."""
        if kind not in self.forms:
            postings = whole(self.rows, kind)
            self.forms[kind] = postings, postings.max(1), postings.min(1)
        return self.forms[kind]

    def search(self, query: int, terms: np.ndarray, best: TopK, group: int = 8) -> None:
        width = min(len(terms), len(self.rows))
        # a bound of all sums below, with room for the range of a term and rounding
        bound = 4 * float(np.abs(terms).max(initial=0)) * max(self.largest, 1.0) * max(width, 1)
        kind = np.float64 if bound < 2.0**53 else np.int64 if bound < 2.0**63 else object
        postings, top, bottom = self.form(kind)
        terms = whole(terms[:width], kind)
        high = np.maximum(terms * top[:width], terms * bottom[:width])
        low = np.minimum(terms * top[:width], terms * bottom[:width])
        order = np.argsort(low - high, kind="stable")
        # what the terms from a place on can add at most
        rest = np.append(np.cumsum(high[order][::-1])[::-1], 0)
        threshold = best.threshold(query)
        if threshold == -np.inf:
            essential = width
        else:
            # terms whose whole range together cannot lift a row to the threshold are not essential
            spread = np.append(np.cumsum((high - low)[order][::-1])[::-1], 0)
            essential = int(np.argmax(spread < threshold - low.sum()))
            essential = essential if spread[essential] < threshold - low.sum() else width
            essential = min(width, -(-max(essential, 1) // group) * group)
        used = order[:essential]
        score = terms[used] @ postings[used]
        alive = np.flatnonzero((score + rest[essential] >= threshold) & (self.ids != query))
        score = score[alive]
        for start in range(essential, width, group):
            used = order[start : start + group]
            score = score + terms[used] @ postings[used][:, alive]
            stay = score + rest[min(start + group, width)] >= threshold
            alive, score = alive[stay], score[stay]
        if len(alive):
            best.add(query, kept_to_64_bits(score), self.ids[alive])


def _packed(vectors: DataFrame, rows: int) -> DataFrame:
    """Blocks of up to ``rows`` vectors as bytes; a task packs what it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        lists: list[list[float]] = []

        def block() -> pa.RecordBatch:
            width = max(map(len, lists))
            matrix = np.zeros((len(lists), width))
            for i, x in enumerate(lists):
                matrix[i, : len(x)] = x
            if np.abs(matrix).max(initial=0) < 2.0**31:
                matrix = matrix.astype(np.int32)
            data = [np.array(ids, np.int64).tobytes()], [matrix.tobytes()], [width]
            return pa.RecordBatch.from_arrays([pa.array(data[0], pa.binary()), pa.array(data[1], pa.binary()), pa.array(data[2], pa.int32())], names=["ids", "matrix", "width"])

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                lists.append(x)
                if len(ids) == rows:
                    yield block()
                    ids.clear()
                    lists.clear()
        if ids:
            yield block()

    return vectors.mapInArrow(run, "ids binary, matrix binary, width int")


def _unpacked(ids: bytes, matrix: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(ids, np.int64)
    wide = len(matrix) > 4 * len(rows) * width
    return rows, np.frombuffer(matrix, np.float64 if wide else np.int32).reshape(len(rows), width)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
          factor: int = 1024, shard_rows: int = 4096, query_rows: int = 256) -> DataFrame:
    """The k rows with the largest integer inner product for each query row, itself left out.

    ``is_query`` is a condition on ``id_col``.  Returns query_id, rank, vec_id, score.
    """
    if id_col == vector_col:
        raise ValueError("id and vector are different columns")
    rows = (
        vectors.select(F.col(id_col).alias(id_col), rounded(F.col(vector_col), factor).alias("_terms"))
        .where(F.col(id_col).isNotNull() & F.col("_terms").isNotNull())
        .groupBy(id_col)
        .agg(F.min("_terms").alias("_terms"))
    )
    queries = _packed(rows.where(is_query), query_rows).select(F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.col("width").alias("q_width"))
    blocks = queries.crossJoin(_packed(rows, shard_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = TopK(k)
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q_matrix, q_width, ids, matrix, width = (c[i].as_py() for c in batch.columns)
                shard = Shard(*_unpacked(ids, matrix, width))
                for query, terms in zip(*_unpacked(q_ids, q_matrix, q_width)):
                    shard.search(int(query), terms, best)
        for query, (scores, ids) in best.best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), query, np.int64)), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"]
            )

    found = blocks.mapInArrow(run, T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "vec_id", "score")]))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
