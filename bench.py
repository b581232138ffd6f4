"""Headline queries at one scale; prints one JSON line."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from newsloom import catalog
from newsloom.fixtures import BASE_TABLES
from newsloom.session import build_session

HEADLINE = (
    "user_feed",
    "rank_items",
    "feed_fanout",
    "cosine_topk",
    "hash_embedding",
    "profile_from_likes",
    "profile_counters",
    "merge_interactions",
    "recommendation_metrics",
    "quality_score",
    "language_scores",
    "page_funnel",
    "dedupe_content_hash",
    "seed_new_user_feed",
)


def spread(spark: SparkSession, folder: str, files: int) -> str:
    """The tables as ``files`` files each, in a folder of their own; outside the timing.

    The given tables are one file with one row group each, so a scan of one is a
    single task.  On a cluster a table of any size has many; this is the same
    rows in that form.
    """
    copy = tempfile.mkdtemp(prefix="bench-")
    atexit.register(shutil.rmtree, copy, ignore_errors=True)
    for table in BASE_TABLES:
        spark.read.parquet(f"{folder}/{table}.parquet").repartition(files).write.parquet(f"{copy}/{table}.parquet")
    return copy


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.showConsoleProgress": "false",
            "spark.log.level": "ERROR",
        },
    )
    tables = spread(spark, folder, int(cpus))
    seconds: dict[str, float] = {}
    for key in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[key](spark, tables).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.perf_counter() - start, 3)
        print(key, seconds[key], file=sys.stderr, flush=True)
    users = catalog.base.Tables(spark, tables).v_users.where("is_active").count()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "feeds_per_second": round(users / seconds["user_feed"], 1) if "user_feed" in seconds else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
