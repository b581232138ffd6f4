"""Table scans and list columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.common import top_rows


def latest_rows(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """The ``n`` rows with the highest ids: a top-k per task, then of the winners."""
    return df.orderBy(F.col(id_col).desc()).limit(n)


def coerce_json_list(c: Column) -> Column:
    """Array of text from a JSON array, a ``{a,b}`` literal or comma-separated text.

    Null stays null; blank text and JSON that is no array give an empty array.
    """
    value = F.trim(c)
    empty = F.array().cast("array<string>")

    def pieces(text: Column) -> Column:
        # commas inside double quotes do not separate
        parts = F.split(text, r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
        return F.filter(F.transform(parts, lambda p: F.btrim(F.trim(p), F.lit('"'))), lambda p: p != "")

    literal = value.startswith("{") & value.endswith("}") & F.try_parse_json(value).isNull()
    is_json = F.try_parse_json(value).isNotNull()
    return (
        F.when(value == "", empty)
        .when(literal | (value == "{}"), pieces(F.substring(value, F.lit(2), F.length(value) - 2)))
        .when(value.startswith("["), F.coalesce(F.from_json(value, "array<string>"), pieces(value)))
        .when(is_json, empty)
        .otherwise(pieces(value))
    )


def vector_from_json(c: Column) -> Column:
    """Array of doubles from JSON text, missing entries as 0; null when it is no array."""
    parsed = F.from_json(c, "array<double>")
    return F.transform(parsed, lambda x: F.coalesce(x, F.lit(0.0)))


def source_summary(df: DataFrame, source: str, example_cols: list[str], order: str, examples: int = 5) -> DataFrame:
    """(source, cnt, examples): row counts with at most five example rows, first in ``order``."""
    name = F.coalesce(F.nullif(F.col(source), F.lit("")), F.lit("UNKNOWN"))
    keyed = df.select(name.alias("_source"), order, *[c for c in example_cols if c != order])
    counts = keyed.groupBy("_source").agg(F.count(F.lit(1)).alias("cnt"))
    first = top_rows(keyed, ["_source"], [F.col(order)], examples, "_rank")
    shown = first.groupBy("_source").agg(F.array_sort(F.collect_list(F.struct("_rank", *example_cols))).alias("examples"))
    return counts.join(shown, "_source").withColumnRenamed("_source", "source")
