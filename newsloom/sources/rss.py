"""Landed RSS and Atom payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.dates import parse_published_at
from newsloom.functions.texts import strip
from newsloom.functions.urls import hostname

LINK = "struct<_VALUE:string,_href:string,_rel:string>"
MEDIA = "struct<_url:string,_href:string,_type:string>"
ITEM_SCHEMA = (
    "title string, link string, description string, `content:encoded` string, pubDate string, `dc:date` string, "
    f"`media:content` {MEDIA}, `media:thumbnail` {MEDIA}, enclosure {MEDIA}"
)
ENTRY_SCHEMA = f"title string, link array<{LINK}>, summary string, content string, published string, updated string, `media:thumbnail` {MEDIA}"
IMAGE_SUFFIX = r"(?i)\.(jpg|jpeg|png|webp|avif)$"


def _first(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in cols])


def _media(c: Column, typed: bool = False) -> Column:
    url = F.coalesce(c["_url"], c["_href"])
    ok = url.rlike("(?i)^https?://")
    if typed:
        ok = ok & (F.coalesce(c["_type"], F.lit("")).contains("image/") | url.rlike(IMAGE_SUFFIX))
    return F.when(ok, url)


def rss_items(spark: SparkSession, path: str, sources: DataFrame) -> DataFrame:
    """(title, url, description, image_url, published_at, source_priority) of all items and entries.

    Schemas are given, so no pass over the files infers them.  Items without
    title or link are left out.  ``sources`` is (host, priority).
    """
    def xml(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)

    c = F.col
    items = xml("item", ITEM_SCHEMA).select(
        _first(c("title")).alias("title"),
        _first(c("link")).alias("url"),
        _first(c("description"), c("`content:encoded`")).alias("description"),
        F.coalesce(_media(c("`media:content`")), _media(c("`media:thumbnail`")), _media(c("enclosure"), True)).alias("image_url"),
        parse_published_at(F.coalesce(c("pubDate"), c("`dc:date`"))).alias("published_at"),
    )
    link = F.get(F.filter(F.transform("link", lambda x: F.coalesce(x["_href"], x["_VALUE"])), lambda u: strip(u) != ""), F.lit(0))
    entries = xml("entry", ENTRY_SCHEMA).select(
        _first(c("title")).alias("title"),
        _first(link).alias("url"),
        _first(c("summary"), c("content")).alias("description"),
        _media(c("`media:thumbnail`")).alias("image_url"),
        parse_published_at(F.coalesce(c("published"), c("updated"))).alias("published_at"),
    )
    both = items.unionByName(entries).where(F.col("title").isNotNull() & F.col("url").isNotNull())
    known = sources.groupBy("host").agg(F.max("priority").alias("source_priority"))
    joined = both.join(known, hostname(F.col("url")) == F.col("host"), "left").drop("host")
    return joined.withColumn("source_priority", F.coalesce("source_priority", F.lit(0)))
