"""Shared shapes: first row per key, top-k per key, rank of a large group.

``row_number() <= k`` plans with a map-side WindowGroupLimit, so at most k rows
per key and map task reach the shuffle; a key that holds a third of all rows
therefore stays cheap.  ``ordered_rank`` is for full ranks, where no such limit
applies: it numbers rows inside small buckets and adds bucket offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per key in ``order``; ``rank`` keeps the 1-based number."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key; ``order`` must be total for a repeatable result."""
    return top_rows(df, keys, order, 1)


def ordered_rank(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], name: str) -> DataFrame:
    """1-based rank per key where one key may hold a third of the rows.

    ``bucket`` must be monotone in ``order`` (a day, a minute, an id range).
    Rows are numbered per (key, bucket); the offsets come from one small
    aggregate over buckets.
    """
    keyed = df.withColumn("_bucket", bucket)
    sizes = keyed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
    )
    inside = keyed.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)))
    same = F.col("_bucket").eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (
        inside.join(offsets, same)
        .withColumn(name, F.col(name) + F.col("_offset"))
        .drop("_bucket", "_b", "_offset", *[f"_k{i}" for i in range(len(keys))])
    )
