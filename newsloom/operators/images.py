"""Choice of images per post: uniqueness, variants, ranking, diversity.

Images arrive as (post, pos, url) rows; every group is one post or one image
key and is cut by a top-k window before it grows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import images as I
from newsloom.functions import lexicon as L
from newsloom.functions import urls as U
from newsloom.functions.html import bare_host
from newsloom.functions.texts import bind, contains_any
from newsloom.operators.common import first_row, top_rows
from newsloom.operators.feed import soft_image_url

# Limits and topic words without meaning.
POST_LIMIT = 4
PREFERRED_POSITIONS = (0, 1)
TOPIC_STOPWORDS = (
    "news", "latest", "today", "update", "report", "story", "world", "global", "general", "yangilik", "yangiliklar", "uzbek",
    "uzbekiston",
)
MAX_TOPIC_TOKENS, RANKED_TOKENS = 12, 8


def image_url_filter(df: DataFrame, url: str = "url") -> DataFrame:
    """One flag per usability rule, plus the address without its query."""
    c = F.col(url)
    return df.withColumns(
        {
            "soft_ok": soft_image_url(c).isNotNull(),
            "candidate_ok": I.candidate_ok(c),
            "news_photo": I.news_photo(c),
            "extractor_ok": I.extractor_ok(c),
            "rejected": I.rejected(c),
            "bare_url": I.without_query(c),
        }
    )


def image_keys(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumns({"canonical_key": I.canonical_image_key(F.col(url)), "visual_key": I.visual_image_key(F.col(url))})


def unique_images_across_posts(images: DataFrame, reserved: DataFrame | None = None, limit: int = POST_LIMIT, post: str = "ai_news_id") -> DataFrame:
    """Each post keeps up to ``limit`` images whose key no earlier post used.

    One pass is exact because posts bring at most ``limit`` images.
    ``reserved`` holds canonical keys already in use.
    """
    keyed = images.withColumn("url", F.trim("url")).where("url <> ''").withColumn("canonical_key", I.canonical_image_key(F.col("url")))
    if reserved is not None:
        keyed = keyed.join(reserved.select("canonical_key"), "canonical_key", "left_anti")
    owned = first_row(keyed, ["canonical_key"], [F.col(post), F.col("pos")])
    return top_rows(owned, [post], [F.col("pos")], limit)


def best_image_variant(images: DataFrame, post: str = "ai_news_id") -> DataFrame:
    """One image per (post, picture): preferred positions first, else the largest, else the earliest.

    ``group_pos`` numbers the pictures by their first appearance.
    """
    size = I.image_size(F.col("url"))
    area = F.coalesce(size["width"] * size["height"], F.lit(0))
    keyed = images.withColumns({"visual_key": I.visual_image_key(F.col("url")), "area": area})
    keyed = keyed.withColumn("first_pos", F.min("pos").over(Window.partitionBy(post, "visual_key")))
    preferred = F.col("pos").isin(*PREFERRED_POSITIONS).cast("int")
    best = first_row(keyed, [post, "visual_key"], [preferred.desc(), F.col("area").desc(), F.col("pos")])
    return best.withColumn("group_pos", F.row_number().over(Window.partitionBy(post).orderBy("first_pos"))).drop("first_pos")


def largest_variant(images: DataFrame, order: str, post: str = "ai_news_id") -> DataFrame:
    """One image per (post, picture): the largest, else the first in ``order``; keeps the picture's first place."""
    size = I.image_size(F.col("url"))
    keyed = images.withColumns({"visual_key": I.visual_image_key(F.col("url")), "area": F.coalesce(size["width"] * size["height"], F.lit(0))})
    keyed = keyed.withColumn("group_at", F.min(order).over(Window.partitionBy(post, "visual_key")))
    return first_row(keyed, [post, "visual_key"], [F.col("area").desc(), F.col(order)])


def topic_tokens(topic: Column) -> Column:
    """Distinct meaningful topic words, then their runs of two and three, at most twelve.

    Runs of three are taken over words and two-word runs together.
    """
    words = F.split(F.lower(F.coalesce(topic, F.lit(""))), L.NONWORD + "+")
    words = F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.rlike(r"^\d+$") & ~w.isin(*TOPIC_STOPWORDS)))

    def with_runs(tokens: Column, n: int) -> Column:
        runs = F.transform(tokens, lambda t, i: F.array_join(F.slice(tokens, i + 1, n), " "))
        whole = F.slice(runs, 1, F.greatest(F.size(tokens) - (n - 1), F.lit(0)))
        return F.array_distinct(F.concat(tokens, F.filter(whole, lambda r: F.length(r) >= 6)))

    def grow(base: Column) -> Column:
        two = with_runs(base, 2)
        return F.when(F.size(base) >= 3, bind(two, lambda t: with_runs(t, 3))).when(F.size(base) == 2, two).otherwise(base)

    return F.slice(bind(words, grow), 1, MAX_TOPIC_TOKENS)


def _haystack(url: Column) -> Column:
    return F.lower(F.concat_ws(" ", U.part(url, U.AUTHORITY), I.path_and_query(url)))


def _source_hit(url: Column, source_url: Column) -> Column:
    domain = bare_host(F.coalesce(source_url, F.lit("")))
    return (domain != "") & F.contains(F.lower(U.part(url, U.AUTHORITY)), domain)


def rank_images(images: DataFrame, post: str = "ai_news_id") -> DataFrame:
    """Add ``score`` and ``image_rank`` per post.

    ``images`` carries ``topic``, ``source_url`` and ``context`` (text around
    the image, may be null) beside (post, pos, url).
    """
    url = F.col("url")
    context = F.lower(F.coalesce("context", F.lit("")))
    prepared = images.withColumns(
        {
            "_tokens": F.slice(topic_tokens(F.col("topic")), 1, RANKED_TOKENS),
            "_hay": _haystack(url),
            "_size": I.image_size(url),
            "_photo": I.news_photo(url),
        }
    )
    url_hits = F.size(F.filter("_tokens", lambda t: F.contains(F.col("_hay"), t)))
    context_hits = F.size(F.filter("_tokens", lambda t: F.contains(context, t)))
    prepared = prepared.withColumns({"_url_hits": url_hits, "_ctx_hits": context_hits})
    width, height = F.col("_size.width"), F.col("_size.height")
    area = width * height
    no_hits = (F.col("_url_hits") == 0) & (F.col("_ctx_hits") == 0)
    stock = contains_any(F.lower(F.concat_ws(" ", url, context)), I.STOCK_TERMS)
    score = (
        F.when(_source_hit(url, F.col("source_url")), 60.0).otherwise(0.0)
        + F.when(F.col("_photo"), 30.0).otherwise(0.0)
        + F.when(width >= 1600, 18.0).when(width >= 1280, 14.0).when(width >= 1024, 10.0).when(width >= I.MIN_PUBLIC_WIDTH, 6.0).otherwise(0.0)
        + F.when(area >= 1600 * 900, 12.0).when(area >= 1280 * 720, 8.0).when(area >= 1024 * 576, 5.0)
        .when(width.isNull() & height.isNull(), -6.0).otherwise(0.0)
        + F.when(height >= 900, 8.0).when(height >= 720, 6.0).when(height >= 480, 3.0).when(height >= I.MIN_PUBLIC_HEIGHT, 1.5).otherwise(0.0)
        + F.least(F.col("_url_hits") * 4.0, F.lit(20.0))
        + F.least(F.col("_ctx_hits") * 6.0, F.lit(30.0))
        + F.when(stock & no_hits, -30.0).when(stock, -10.0).otherwise(0.0)
        + F.when((bare_host(F.coalesce("source_url", F.lit(""))) == "") & no_hits, -8.0).otherwise(0.0)
        - F.col("pos") * 0.05
    )
    ranked = prepared.withColumn("score", F.round(score, 4)).drop("_tokens", "_hay", "_size", "_photo", "_url_hits", "_ctx_hits")
    return ranked.withColumn("image_rank", F.row_number().over(Window.partitionBy(post).orderBy(F.col("score").desc(), F.col("pos"))))


def diverse_images(ranked: DataFrame, limit: int = POST_LIMIT, post: str = "ai_news_id") -> DataFrame:
    """On-topic pictures in rank order, few per domain first, then the rest, up to ``limit``."""
    per_domain = 2 if limit >= 4 else 3
    url = F.col("url")
    context = F.lower(F.coalesce("context", F.lit("")))
    tokens = topic_tokens(F.col("topic"))
    hay = _haystack(url)
    on_topic = (
        (F.size("_tokens") == 0)
        | F.exists("_tokens", lambda t: F.contains(F.col("_hay"), t) | F.contains(context, t))
        | (_source_hit(url, F.col("source_url")) & I.news_photo(url))
    )
    topical = ranked.withColumns({"_tokens": tokens, "_hay": hay}).where(on_topic).drop("_tokens", "_hay")
    variants = largest_variant(topical, "image_rank", post).where(~F.lower(F.trim("url")).isin(*I.BLOCKED_URLS))
    domain = bare_host(url)
    nth = F.row_number().over(Window.partitionBy(post, "domain").orderBy("group_at"))
    marked = variants.withColumn("domain", domain).withColumn("second_pass", (F.col("domain") != "") & (nth > per_domain))
    return top_rows(marked, [post], [F.col("second_pass"), F.col("group_at")], limit, "place").drop("group_at", "second_pass", "domain")
