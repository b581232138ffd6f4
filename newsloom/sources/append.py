"""Bulk save of new article rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.common import first_row
from newsloom.operators.dedup import content_sha256, dedupe_first_by_url


def append_new(new: DataFrame, existing: DataFrame, order_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows to insert and one row of counts (total, inserted, skipped).

    Rows without URL and repeated URLs are skipped; so are rows whose URL or
    content hash the table or an earlier row of the batch already has.
    ``existing`` needs (source_url, content_hash) only.
    """
    batch = dedupe_first_by_url(new, order_col)
    hashed = batch.withColumn("content_hash", content_sha256(F.col("title"), F.col("raw_text"), F.col("source_url")))
    unseen = hashed.join(existing.select("source_url"), "source_url", "left_anti")
    unseen = unseen.join(existing.select("content_hash"), "content_hash", "left_anti")
    inserts = first_row(unseen, ["content_hash"], [F.col(order_col)])
    n_insert = inserts.agg(F.count(F.lit(1)))
    stats = new.agg(F.count(F.lit(1)).alias("total")).withColumn("inserted", n_insert.scalar())
    return inserts, stats.withColumn("skipped", F.col("total") - F.col("inserted"))


def write_appended(inserts: DataFrame, path: str, created_at: str = "created_at") -> None:
    """Append to the day-partitioned table; one shuffle by day keeps files few."""
    dated = inserts.withColumn("ingest_date", F.to_date(created_at))
    dated.repartition("ingest_date").write.mode("append").partitionBy("ingest_date").parquet(path)
