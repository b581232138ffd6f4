"""Registry of queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.fixtures import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# timestamps compare as text on both sides
TS_SPARK = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def ts(expr: str) -> str:
    """DuckDB text form of a timestamp, equal to ``shape``'s."""
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


def shape(df: DataFrame, **rounding: int) -> DataFrame:
    """Output types both engines share: bigint, double, boolean, text."""
    cols = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(kind, (T.FloatType, T.DecimalType)):
            c = c.cast("double")
        elif isinstance(kind, T.TimestampType):
            c = F.date_format(c, TS_SPARK)
        elif isinstance(kind, T.DateType):
            c = c.cast("string")
        elif isinstance(kind, T.ArrayType):
            c = F.array_join(c, "¦")
        if field.name in rounding:
            c = F.round(c, rounding[field.name])
        cols.append(c.alias(field.name))
    return df.select(*cols)


def register(key: str, run: Callable[[Tables], DataFrame], views: str | None = None, body: str = "", ctes: str = "") -> None:
    """Add query ``key``; without ``views`` it has no oracle (rows-only check)."""
    if key in QUERIES:
        raise ValueError(f"query {key} registered twice")
    QUERIES[key] = lambda spark, sf_dir: run(Tables(spark, sf_dir))
    if views is not None:
        ORACLES[key] = oracle(views, body, ctes)
