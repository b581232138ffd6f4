"""Metrics and monitoring aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.urls import hostname

# Status groups and alert thresholds.
DONE_STATUSES = ("generated", "completed")
PENDING_STATUSES = ("pending", "classified", "processing")
MAX_FAILURE_RATE = 0.3
STALLED_SECONDS = 600


def _hours_before(as_of: Column, hours: int) -> Column:
    return as_of - F.make_interval(hours=F.lit(max(1, hours)))


def recommendation_metrics(
    log: DataFrame, interactions: DataFrame, saved: DataFrame, as_of: Column, hours: int = 24
) -> DataFrame:
    """Impressions, clicks after impression, positive reactions and their ratios.

    "Some reaction at or after the impression" holds exactly when the latest
    reaction of that (user, article) is not earlier, so both sides are reduced
    to one row per key before the join and no pairs are formed.
    """
    cutoff = _hours_before(as_of, hours)
    keys = ["user_id", "ai_news_id"]
    shown = log.where(F.col("created_at") >= cutoff).select(*keys, F.col("created_at").alias("shown_at"))
    # only reactions at or after an impression count, and those lie in the time span as well
    latest = interactions.where(F.col("created_at") >= cutoff).groupBy(*keys).agg(
        F.max(F.when(F.col("viewed"), F.col("created_at"))).alias("last_view"),
        F.max(F.when(F.col("liked"), F.col("created_at"))).alias("last_like"),
    )
    latest_save = saved.where(F.col("created_at") >= cutoff).groupBy(*keys).agg(F.max("created_at").alias("last_save"))
    facts = shown.join(latest, keys, "left").join(latest_save, keys, "left")
    positive = (F.col("last_like") >= F.col("shown_at")) | (F.col("last_save") >= F.col("shown_at"))
    counted = facts.agg(
        F.count(F.lit(1)).alias("impressions"),
        F.count_if(F.col("last_view") >= F.col("shown_at")).alias("viewed_clicks"),
        F.count_if(positive).alias("positive_engagements"),
    )
    watch = interactions.where((F.col("created_at") >= cutoff) & (F.col("watch_time") > 0)).agg(
        F.avg("watch_time").alias("avg_watch")
    )
    per_impression = F.greatest(F.col("impressions"), F.lit(1))
    # both sides are one-row aggregates
    return counted.withColumn("avg_watch", watch.scalar()).select(
        F.lit(hours).alias("timeframe_hours"),
        "impressions",
        "viewed_clicks",
        F.round(F.col("viewed_clicks") / per_impression, 4).alias("ctr"),
        F.round(F.coalesce("avg_watch", F.lit(0.0)), 2).alias("avg_time_spent_seconds"),
        "positive_engagements",
        F.round(F.col("positive_engagements") / per_impression, 4).alias("recommendation_accuracy"),
    )


def processing_metrics(raw: DataFrame, enriched: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Totals by state, retries, mean attempts and mean seconds to the first enriched row."""
    recent = raw.where(F.col("created_at") >= _hours_before(as_of, hours)).select(
        "raw_news_id", "created_at", "process_status", "attempt_count"
    )
    first = enriched.groupBy("raw_news_id").agg(F.min("created_at").alias("first_at"))
    status = F.col("process_status")
    joined = recent.join(first, "raw_news_id", "left")
    latency = (F.unix_micros("first_at") - F.unix_micros("created_at")) / 1e6
    timed = F.when(status.isin(*DONE_STATUSES) & (latency >= 0), latency)
    attempts = F.col("attempt_count")
    return joined.agg(
        F.lit(hours).alias("timeframe_hours"),
        F.count(F.lit(1)).alias("total_raw_news"),
        F.count_if(status.isin(*DONE_STATUSES)).alias("completed_jobs"),
        F.count_if(status == "failed").alias("failed_jobs"),
        F.count_if(status.isin(*PENDING_STATUSES)).alias("pending_jobs"),
        F.coalesce(F.sum(F.when(attempts > 1, attempts - 1).otherwise(0)), F.lit(0)).alias("retry_count"),
        F.round(F.coalesce(F.avg(F.coalesce(attempts, F.lit(0))), F.lit(0.0)), 2).alias("avg_attempt_count"),
        F.round(F.coalesce(F.avg(timed), F.lit(0.0)), 2).alias("avg_processing_latency_seconds"),
    )


def status_breakdown(raw: DataFrame, enriched: DataFrame, users: DataFrame, feed: DataFrame) -> DataFrame:
    """(scope, name, cnt): rows per status, and the table totals."""

    def total(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.lit("table").alias("scope"), F.lit(name).alias("name"), F.count(F.lit(1)).alias("cnt"))

    by_status = raw.groupBy("process_status").agg(F.count(F.lit(1)).alias("cnt")).select(
        F.lit("status").alias("scope"), F.col("process_status").alias("name"), "cnt"
    )
    done = raw.where(F.col("process_status").isin(*DONE_STATUSES))
    out = by_status
    for df, name in ((raw, "raw_news"), (enriched, "ai_news"), (users, "users"), (feed, "user_feed"), (done, "generated_raw")):
        out = out.unionByName(total(df, name))
    return out


def health_flags(raw: DataFrame, as_of: Column) -> DataFrame:
    """Failure rate and idle time against their thresholds, and the overall status."""
    status = F.col("process_status")
    facts = raw.agg(
        F.count_if(status.isin(*DONE_STATUSES)).alias("processed"),
        F.count_if(status == "failed").alias("failed"),
        F.max(F.coalesce("processing_started_at", "created_at")).alias("last_activity"),
    )
    total = F.col("processed") + F.col("failed")
    rate = F.when(total > 0, F.col("failed") / total).otherwise(0.0)
    idle = F.unix_seconds(as_of) - F.unix_seconds("last_activity")
    checked = facts.withColumns({"failure_rate": rate, "stalled_seconds": idle}).withColumns(
        {"failure_ok": F.col("failure_rate") < MAX_FAILURE_RATE, "activity_ok": F.col("stalled_seconds") < STALLED_SECONDS}
    )
    return checked.select(
        "processed",
        "failed",
        F.round("failure_rate", 2).alias("failure_rate"),
        "stalled_seconds",
        "failure_ok",
        "activity_ok",
        F.when(F.col("failure_ok") & F.col("activity_ok"), "healthy")
        .when(F.col("failure_ok") | F.col("activity_ok"), "degraded")
        .otherwise("unhealthy")
        .alias("status"),
    )


def feed_quality(feed: DataFrame, candidates: int | Column) -> DataFrame:
    """Per user: size, share of regional and of Uzbek items, share of candidates left out."""
    n = F.count(F.lit(1))
    pool = candidates if isinstance(candidates, Column) else F.lit(candidates)
    return feed.groupBy("user_id").agg(
        n.alias("final_count"),
        F.round(F.count_if(F.lower("region") == "uz") / n * 100, 4).alias("uz_region_pct"),
        F.round(F.count_if(F.lower("language") == "uz") / n * 100, 4).alias("uz_language_pct"),
        F.round((pool - n) / pool * 100, 4).alias("dedupe_rate"),
    )


def source_heartbeat(runs: DataFrame, as_of: Column, interval_minutes: int = 15) -> DataFrame:
    """Last run per source: healthy within two intervals, degraded within three, else unhealthy."""
    last = runs.groupBy(hostname(F.col("source_url")).alias("source")).agg(F.max("created_at").alias("last_run"))
    age = F.unix_seconds(as_of) - F.unix_seconds("last_run")
    base = max(1, interval_minutes) * 60
    status = F.when(age <= base * 2, "healthy").when(age <= base * 3, "degraded").otherwise("unhealthy")
    return last.select("source", "last_run", age.alias("age_seconds"), status.alias("status"))


def recent_counts(df: DataFrame, as_of: Column) -> DataFrame:
    """Rows of the last 10 minutes, 15 minutes and hour."""

    def since(minutes: int) -> Column:
        return F.count_if(F.col("created_at") >= as_of - F.expr(f"INTERVAL {minutes} MINUTES"))

    return df.agg(since(10).alias("last_10m"), since(15).alias("last_15m"), since(60).alias("last_1h"))


def run_summary(results: DataFrame) -> DataFrame:
    """Processed, failed, skipped and created counts of one batch run (status, created)."""
    total = F.count(F.lit(1))
    processed, failed = F.count_if(F.col("status") == "processed"), F.count_if(F.col("status") == "failed")
    return results.agg(
        total.alias("fetched"),
        processed.alias("processed"),
        failed.alias("failed"),
        (total - processed - failed).alias("skipped"),
        F.coalesce(F.sum("created"), F.lit(0)).alias("created"),
    )


def enrichment_report(df: DataFrame) -> DataFrame:
    """(name, cnt): items, summaries present, summaries equal to the text, items per category."""
    category = F.coalesce(F.nullif("category", F.lit("")), F.lit("other"))
    per_category = df.groupBy(category.alias("category")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("summary") != "").alias("filled"),
        F.count_if((F.col("summary") != "") & (F.col("summary") == F.col("raw_text"))).alias("equal"),
    )
    totals = per_category.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("items"),
        F.coalesce(F.sum("filled"), F.lit(0)).alias("summaries_non_empty"),
        F.coalesce(F.sum("equal"), F.lit(0)).alias("full_text_equal"),
    ).unpivot([], ["items", "summaries_non_empty", "full_text_equal"], "name", "cnt")
    by_name = per_category.select(F.concat(F.lit("category:"), F.col("category")).alias("name"), F.col("n").alias("cnt"))
    return totals.unionByName(by_name)
