"""Ingest cleaning: article rows, gates, source priority and mixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import texts as X
from newsloom.functions import urls as U
from newsloom.operators.common import top_rows
from newsloom.operators.dedup import dedupe_url_or_title

# Gate words, ages, source list and country domains.
MAX_AGE_HOURS, RECENT_HOURS = 48, 24
BAD_SOURCE_WORDS = ("spam", "ads", "clickbait")
GARBAGE_WORDS = ("comic", "preview", "trailer")
SOURCE_PRIORITIES = (
    ("global", "BBC World", "http://feeds.bbci.co.uk/news/world/rss.xml", 120),
    ("global", "BBC Technology", "http://feeds.bbci.co.uk/news/technology/rss.xml", 118),
    ("global", "CNN World", "http://rss.cnn.com/rss/edition_world.rss", 116),
    ("global", "CNN Top", "http://rss.cnn.com/rss/edition.rss", 114),
    ("global", "Reuters World", "https://feeds.reuters.com/Reuters/worldNews", 112),
    ("global", "DW World", "https://rss.dw.com/rdf/rss-en-world", 110),
    ("uz", "Kun.uz", "https://kun.uz/news/rss", 106),
    ("uz", "Gazeta.uz", "https://www.gazeta.uz/rss/", 104),
    ("uz", "Daryo", "https://daryo.uz/feed", 102),
)
HOME_BONUS = 4
COUNTRY_DOMAINS = {
    "UZ": ("kun.uz", "gazeta.uz", "daryo.uz", "uznews.uz"),
    "RU": ("ria.ru", "rbc.ru", "lenta.ru", "vesti.ru"),
    "KZ": ("tengrinews.kz", "inform.kz"),
    "US": ("apnews.com", "reuters.com", "cnn.com"),
}
COUNTRY_SHARE = 0.6


def normalize_article(df: DataFrame) -> DataFrame:
    """Canonical article row from (title, description, content, url, source_name, image_url, published_at)."""

    def text(c: str) -> Column:
        return X.strip(F.coalesce(c, F.lit("")))

    body = F.array_join(F.filter(F.array(text("description"), text("content")), lambda p: p != ""), "\n\n")
    title = text("title")
    return df.select(
        F.when(title == "", "Untitled").otherwise(title).alias("title"),
        body.alias("raw_text"),
        U.unwrap_redirect_url(F.col("url")).alias("source_url"),
        F.lit("general").alias("category"),
        F.coalesce(F.nullif("source_name", F.lit("")), F.lit("global")).alias("region"),
        F.lit(False).alias("is_urgent"),
        "image_url",
        "published_at",
    )


ALTERNATIVE_FIELDS = {
    "title": ("title",),
    "source_url": ("source_url", "url"),
    "image_url": ("image_url", "image", "img"),
    "raw_text": ("raw_text", "content", "text"),
    "category": ("category", "section"),
    "region": ("region",),
}


def canonical_items(df: DataFrame, domains: list[str] | None = None, order: list[Column] | None = None, limit: int | None = None) -> DataFrame:
    """Canonical rows from items whose fields go by alternative names.

    ``domains`` keeps items whose ``source`` host ends with one of them;
    ``limit`` is the save cap of a run, in ``order``.
    """
    kept = df
    if domains:
        host = F.lower(U.part(F.col("source"), U.AUTHORITY))
        kept = kept.where(F.exists(F.array(*[F.lit(d) for d in domains]), lambda d: F.endswith(host, d)))
    if limit:
        kept = kept.orderBy(*(order or [])).limit(limit)
    present = set(df.columns)

    def pick(names: tuple[str, ...]) -> Column:
        found = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in present]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    out = kept.select(*[pick(names).alias(field) for field, names in ALTERNATIVE_FIELDS.items()])
    return out.where(F.col("source_url").isNotNull()).withColumn("raw_text", F.coalesce("raw_text", F.lit("")))


def plain_text(c: Column) -> Column:
    """Character references resolved and white space collapsed, as rows are stored."""
    return X.strip(X.collapse_space(X.unescape_html(F.coalesce(c, F.lit("")))))


def ingest_gate(df: DataFrame, as_of: Column) -> DataFrame:
    """Add ``normalized_url``, the cleaned ``title`` and ``raw_text``, and one ``gate`` status.

    Order: older than 48 hours, bad source, empty, garbage, test, pending.
    ``published_at`` is a timestamp; unknown times pass.
    """
    cleaned = df.withColumns(
        {
            "normalized_url": U.normalize_source_url(F.col("source_url")),
            "title": plain_text(F.col("title")),
            "raw_text": plain_text(F.col("raw_text")),
        }
    )
    address = F.lower(F.coalesce(F.nullif("normalized_url", F.lit("")), "source_url", F.lit("")))
    haystack = F.concat_ws(" ", F.lower("title"), F.lower("raw_text"), address)
    old = F.col("published_at") < as_of - F.make_interval(hours=F.lit(MAX_AGE_HOURS))
    status = (
        F.when(old, "dropped")
        .when((address == "") | X.contains_any(address, BAD_SOURCE_WORDS), "ignored_source")
        .when((F.col("title") == "") & (F.col("raw_text") == ""), "ignored_empty")
        .when(X.contains_any(haystack, GARBAGE_WORDS), "ignored_garbage")
        .when(F.lower("title").contains("test"), "ignored_test")
        .otherwise("pending")
    )
    return cleaned.withColumn("gate", status)


def gate_funnel(gated: DataFrame) -> DataFrame:
    return gated.groupBy("gate").agg(F.count(F.lit(1)).alias("cnt"))


def source_table(spark: SparkSession) -> DataFrame:
    """(grp, name, host, priority) of the known sources: a fixed table of nine rows."""
    rows = spark.createDataFrame(list(SOURCE_PRIORITIES), "grp string, name string, url string, priority int")
    host = U.hostname(F.col("url"))
    return rows.select("grp", "name", host.alias("host"), "priority")


def source_priority(df: DataFrame, sources: DataFrame, countries: list[str], url: str = "source_url") -> DataFrame:
    """Add ``source_priority``: that of the known host, raised for home sources; 0 for others."""
    codes = {c.strip().upper() for c in countries if c and c.strip()}
    bonus = F.when((F.col("grp") == "uz") & F.lit("UZ" in codes), HOME_BONUS).otherwise(0)
    per_host = sources.groupBy("host").agg(F.max(F.col("priority") + bonus).alias("source_priority"))
    joined = df.join(per_host, U.hostname(F.col(url)) == F.col("host"), "left").drop("host")
    return joined.withColumn("source_priority", F.coalesce("source_priority", F.lit(0)))


def preferred_domains(countries: list[str]) -> list[str]:
    """Domains of the given countries, in order, without repeats."""
    codes = [c.strip().upper() for c in countries if c and c.strip()]
    return list(dict.fromkeys(d for code in codes for d in COUNTRY_DOMAINS.get(code, ())))


def prioritize_recent(df: DataFrame, as_of: Column, n: int, id_col: str, priority: str = "source_priority", published: str = "published_at") -> DataFrame:
    """First ``n`` rows: high priority, then younger than a day, then newest; unknown times last."""
    recent = F.col(published) >= as_of - F.make_interval(hours=F.lit(RECENT_HOURS))
    bucket = F.when(F.coalesce(recent, F.lit(False)), 0).otherwise(1)
    return df.orderBy(F.col(priority).desc(), bucket, F.col(published).desc_nulls_last(), F.col(id_col)).limit(n)


def country_global_mix(df: DataFrame, domains: list[str], n: int, id_col: str, url: str = "source_url", title: str = "final_title", published: str = "created_at") -> DataFrame:
    """60 % of ``n`` from preferred domains, the rest from others, then URL/title dedupe.

    Adds ``is_preferred``; preferred rows come first in the dedupe order.
    """
    host = F.regexp_replace(U.hostname(F.col(url)), r"^www\.", "")
    home = max(1, int(n * COUNTRY_SHARE))
    marked = df.withColumn("is_preferred", host.isin(*domains))
    # two top-k scans of bounded size
    parts = [
        top_rows(marked.where("is_preferred"), ["is_preferred"], [F.col(published).desc(), F.col(id_col)], home, "_rank"),
        top_rows(marked.where("NOT is_preferred"), ["is_preferred"], [F.col(published).desc(), F.col(id_col)], max(1, n - home), "_rank"),
    ]
    both = parts[0].unionByName(parts[1]).withColumn("mix_pos", F.when(F.col("is_preferred"), F.col("_rank")).otherwise(F.col("_rank") + home))
    return dedupe_url_or_title(both.drop("_rank"), "mix_pos", url, title)
