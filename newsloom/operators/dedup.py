"""Row deduplication and identity keys.

All keepers are "first row per key" windows: with the map-side group limit a
hot key costs one row per map task, not its whole group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.urls import normalize_source_url
from newsloom.operators.common import first_row

def content_sha256(title: Column, text: Column, url: Column) -> Column:
    """Identity of an article row: title, body and address joined by bars."""
    parts = [F.trim(F.coalesce(c, F.lit(""))) for c in (title, text, url)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def content_md5(title: Column, text: Column, head_chars: int | None = None) -> Column:
    """Looser identity: case-folded title plus the body, or plus its first ``head_chars`` characters only."""
    body = F.coalesce(text, F.lit(""))
    body = body if head_chars is None else F.substring(body, 1, head_chars)
    return F.md5(F.lower(F.concat(F.trim(F.coalesce(title, F.lit(""))), body)))


def image_md5(url: Column) -> Column:
    return F.when(F.length(url) > 0, F.md5(F.lower(F.trim(url))))


def content_hashes(df: DataFrame, title: str, text: str, url: str) -> DataFrame:
    """Add ``content_hash`` (sha256) and ``near_hash`` (md5)."""
    return df.withColumns(
        {
            "content_hash": content_sha256(F.col(title), F.col(text), F.col(url)),
            "near_hash": content_md5(F.col(title), F.col(text)),
        }
    )


def dedupe_first_by_url(df: DataFrame, order_col: str, url: str = "source_url") -> DataFrame:
    """First row per trimmed URL; rows without URL are left out."""
    keyed = df.withColumn(url, F.trim(F.col(url))).where(F.length(url) > 0)
    return first_row(keyed, [url], [F.col(order_col)])


def dedupe_first_by_url_stats(df: DataFrame, url: str = "source_url") -> DataFrame:
    """One row: total, without URL, kept, repeated."""
    clean = F.nullif(F.trim(F.col(url)), F.lit(""))
    per_url = df.groupBy(clean.alias("u")).agg(F.count(F.lit(1)).alias("n"))
    return per_url.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("u").isNull(), F.col("n"))), F.lit(0)).alias("skipped_no_url"),
        F.count("u").alias("kept"),
        F.coalesce(F.sum(F.when(F.col("u").isNotNull(), F.col("n") - 1)), F.lit(0)).alias("repeated"),
    )


def dedupe_url_or_title(df: DataFrame, order_col: str, url: str = "source_url", title: str = "final_title") -> DataFrame:
    """Key is the lower-case URL or, when blank, the lower-case title; no key, no row."""
    key = F.coalesce(*[F.nullif(F.lower(F.trim(F.col(c))), F.lit("")) for c in (url, title)])
    keyed = df.withColumn("_key", key).where(F.col("_key").isNotNull())
    return first_row(keyed, ["_key"], [F.col(order_col)]).drop("_key")


def dedupe_url_else_hash(df: DataFrame, order_col: str, url: str, title: str, text: str) -> DataFrame:
    """Key is the normalized URL when present, else the content hash, in separate key spaces."""
    norm = normalize_source_url(F.col(url))
    key = F.coalesce(F.concat(F.lit("u:"), norm), F.concat(F.lit("h:"), content_md5(F.col(title), F.col(text))))
    return first_row(df.withColumn("_key", key), ["_key"], [F.col(order_col)]).drop("_key")


def dedupe_content_hash(batches: list[DataFrame], order_col: str, title: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Merge batches in the given order and keep the first row per content hash.

    Returns the kept rows (with ``batch`` and ``near_hash``) and a one-row
    frame with the counts before and after.
    """
    numbered = [b.withColumn("batch", F.lit(i)) for i, b in enumerate(batches)]
    merged = reduce(DataFrame.unionByName, numbered).withColumn("near_hash", content_md5(F.col(title), F.col(text)))
    kept = first_row(merged, ["near_hash"], [F.col("batch"), F.col(order_col)])
    counts = merged.groupBy("near_hash").agg(F.count(F.lit(1)).alias("n"))
    stats = counts.agg(F.sum("n").alias("total_before"), F.count(F.lit(1)).alias("total_after"))
    return kept, stats


def compact_duplicates(raw: DataFrame, enriched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge raw rows that share a URL and the enriched rows below them.

    Newest raw row per URL survives; enriched rows move to the survivor, and
    of several for one persona the newest stays.  Rows without URL and
    enriched rows of unknown parents are untouched.
    """
    newest_first = [F.coalesce(F.col("created_at"), F.lit(0).cast("timestamp")).desc(), F.col("raw_news_id").desc()]
    urls = raw.select("raw_news_id", "source_url", "created_at").where(F.col("source_url").isNotNull())
    survivors = first_row(urls, ["source_url"], newest_first).select("source_url", F.col("raw_news_id").alias("keep_id"))
    # only URLs with several rows need a mapping; that side is small
    groups = urls.groupBy("source_url").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("source_url")
    moves = (
        urls.join(groups, "source_url", "left_semi")
        .join(survivors, "source_url")
        .select(F.col("raw_news_id").alias("old_id"), "keep_id")
    )
    raw2 = raw.join(moves.where("old_id <> keep_id"), raw["raw_news_id"] == F.col("old_id"), "left_anti")
    mapped = enriched.join(moves, enriched["raw_news_id"] == F.col("old_id"), "left").drop("old_id")
    untouched = mapped.where(F.col("keep_id").isNull()).drop("keep_id")
    merged = first_row(
        mapped.where(F.col("keep_id").isNotNull()),
        ["keep_id", "target_persona"],
        [F.coalesce(F.col("created_at"), F.lit(0).cast("timestamp")).desc(), F.col("ai_news_id").desc()],
    )
    merged = merged.withColumn("raw_news_id", F.col("keep_id")).drop("keep_id")
    return raw2, untouched.unionByName(merged)


def latest_interaction(df: DataFrame, id_col: str = "seq") -> DataFrame:
    """Row with the highest id per (user, article)."""
    return first_row(df, ["user_id", "ai_news_id"], [F.col(id_col).desc()])


def title_key(title: Column) -> Column:
    """sha256 of the lower-case title with whitespace collapsed."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"\s+", " ")), 256)


def dedupe_feed(df: DataFrame, rank: str = "rank_pos") -> DataFrame:
    """Drop repeats inside each feed, by article id and then by title key.

    Chained windows equal the greedy walk because ids are unique in a feed:
    candidates come from a primary-key scan.
    """
    by_id = first_row(df, ["user_id", "ai_news_id"], [F.col(rank)])
    keyed = by_id.withColumn("_title", title_key(F.col("final_title")))
    return first_row(keyed, ["user_id", "_title"], [F.col(rank)]).drop("_title")


def duplicate_report(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")


def unique_image_hash(df: DataFrame, order: list[Column], image_hash: str = "image_hash") -> DataFrame:
    """At most one row per non-null image hash; rows without hash all stay."""
    present = first_row(df.where(F.col(image_hash).isNotNull()), [image_hash], order)
    return present.unionByName(df.where(F.col(image_hash).isNull()))
