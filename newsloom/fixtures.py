"""The platform's tables, derived from the given base tables.

Each view is one SQL text that Spark and DuckDB both run unchanged, so an
oracle query can inline it as a CTE.  ``Tables`` gives the same views as lazy
DataFrames.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import apply_runtime_settings

AS_OF = "2024-01-31 00:00:00"

_TOPIC7 = (
    "CASE d.doc_id % 7 WHEN 0 THEN 'politics' WHEN 1 THEN 'sports' WHEN 2 THEN 'economy' "
    "WHEN 3 THEN 'tech' WHEN 4 THEN 'health' WHEN 5 THEN 'culture' ELSE 'general' END"
)

_IMAGE_URL = (
    "concat('https://', CASE WHEN d.doc_id % 9 = 0 THEN 'logo' ELSE 'cdn' END, CAST(d.doc_id % 5 AS VARCHAR(20)), "
    "'.example.com/img/', CAST((d.doc_id * 3 + {pos}) % 120 AS VARCHAR(20)), '_', '{size}', '.jpg?utm_source=a', "
    "CASE WHEN d.doc_id % 2 = 0 THEN '&id=7' ELSE '' END)"
)
_IMAGE_SIZES = ("1600x900", "1280x720", "320x180", "1024x576")
_IMAGES = [_IMAGE_URL.format(pos=i, size=s) for i, s in enumerate(_IMAGE_SIZES)]

VIEW_SQL: dict[str, str] = {
    "v_ai_news": f"""
SELECT CAST(d.doc_id + 1 AS BIGINT) AS ai_news_id, CAST(d.doc_id % 50 AS BIGINT) AS raw_news_id,
  concat({_TOPIC7}, CASE WHEN d.doc_id % 4 = 0 THEN '|furniture' ELSE '' END) AS target_persona,
  {_TOPIC7} AS category,
  substr(d.text, 1, 60) AS final_title, d.text AS final_text, d.lang AS language,
  CASE WHEN d.doc_id % 3 = 0 THEN 'uz' ELSE 'global' END AS region,
  CAST((d.doc_id * 37) % 100 AS DOUBLE) / 10 + coalesce(l.quality, 0) - coalesce(l.toxic, 0) AS ai_score,
  concat('https://', d.source, '.example.org/', CAST(d.doc_id AS VARCHAR(20))) AS source_url,
  concat('["', {_IMAGES[0]}, '","', {_IMAGES[1]}, '","', {_IMAGES[2]}, '","', {_IMAGES[3]}, '"]') AS image_urls,
  TIMESTAMP '{AS_OF}' - ((d.doc_id * 7) % 168) * INTERVAL '1' HOUR AS created_at
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "v_raw_news": f"""
SELECT page_id AS raw_news_id, url AS source_url, html,
  regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  CASE page_id % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' WHEN 4 THEN 'generated' ELSE NULL END AS process_status,
  CAST(page_id % 4 AS INT) AS attempt_count,
  CASE WHEN page_id % 6 = 1 THEN TIMESTAMP '{AS_OF}' - (page_id % 30) * INTERVAL '1' MINUTE END AS processing_started_at,
  TIMESTAMP '{AS_OF}' - ((page_id * 5) % 120) * INTERVAL '1' HOUR AS created_at
FROM pages""",
    "v_users": """
SELECT c.c_custkey AS user_id, c.c_name AS username, n.n_name AS location, upper(substr(n.n_name, 1, 2)) AS country_code,
  c.c_acctbal > 0 AS is_active,
  concat('{"all_topics":["', CASE c.c_custkey % 6 WHEN 0 THEN 'politics' WHEN 1 THEN 'sports' WHEN 2 THEN 'economy' WHEN 3 THEN 'tech' WHEN 4 THEN 'health' ELSE 'culture' END,
         '","', CASE c.c_custkey % 3 WHEN 0 THEN 'tech' WHEN 1 THEN 'cs' ELSE 'sports' END, '"],"profession":"', lower(c.c_mktsegment), '"}') AS interests
FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey""",
    "v_events": """
SELECT event_id, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) + 1 AS ai_news_id,
  CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'long_view' WHEN 'purchase' THEN 'like' WHEN 'error' THEN 'skip' ELSE 'impression' END AS event_type,
  value / 20 AS dwell_time, CAST(event_id % 50 AS INT) AS position, CAST(ts AS TIMESTAMP) AS created_at
FROM events""",
    "v_interactions": """
SELECT event_id AS seq, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) + 1 AS ai_news_id,
  CASE event_type WHEN 'purchase' THEN TRUE WHEN 'error' THEN FALSE END AS liked,
  event_type IN ('view', 'click') AS viewed,
  CASE WHEN event_type = 'click' THEN CAST(floor(value / 10) AS INT) END AS watch_time,
  CAST(ts AS TIMESTAMP) AS created_at
FROM events WHERE event_type <> 'signup'""",
    "v_saved": """
SELECT event_id AS seq, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) + 1 AS ai_news_id, CAST(ts AS TIMESTAMP) AS created_at
FROM events WHERE event_type = 'signup'""",
    "v_feature_log": """
SELECT event_id AS id, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) + 1 AS ai_news_id, CAST(event_id % 50 AS INT) AS rank_position, CAST(ts AS TIMESTAMP) AS created_at
FROM events""",
    "v_comments": f"""
SELECT conv_id * 1000 + turn AS comment_id, conv_id % 100 + 1 AS ai_news_id, conv_id % 150 AS user_id,
  CASE WHEN turn > 0 THEN conv_id * 1000 + turn - CASE WHEN turn % 7 = 6 THEN 500 ELSE 1 END END AS parent_comment_id, text AS content,
  TIMESTAMP '{AS_OF}' - (conv_id % 100) * INTERVAL '1' HOUR + turn * INTERVAL '1' MINUTE AS created_at
FROM conversations""",
    "v_images": "\nUNION ALL\n".join(
        f"SELECT d.doc_id + 1 AS ai_news_id, CAST({i} AS BIGINT) AS pos, {_IMAGES[i]} AS url FROM documents d" for i in range(4)
    ),
}

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_VIEW_INPUTS = {
    "v_ai_news": ("documents", "labels"),
    "v_raw_news": ("pages",),
    "v_users": ("customer", "nation"),
    "v_events": ("events",),
    "v_interactions": ("events",),
    "v_saved": ("events",),
    "v_feature_log": ("events",),
    "v_comments": ("conversations",),
    "v_images": ("documents",),
}


class Tables:
    """Lazy DataFrames over one data folder: ``t.documents``, ``t.v_users`` …"""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = apply_runtime_settings(spark)
        self.sf_dir = sf_dir.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        # one schema lookup per table, however many views use it
        if name not in self._frames:
            self._frames[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._frames[name]

    def view(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._view(name)
        return self._frames[name]

    def _view(self, name: str) -> DataFrame:
        # pass the inputs as DataFrames: no temp view is left behind
        sql = VIEW_SQL[name].replace("{", "{{").replace("}", "}}")
        for table in _VIEW_INPUTS[name]:
            sql = sql.replace(f"FROM {table}", f"FROM {{{table}}}").replace(f"JOIN {table}", f"JOIN {{{table}}}")
        return self.spark.sql(sql, **{table: self.base(table) for table in _VIEW_INPUTS[name]})

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEW_SQL:
            return self.view(name)
        if name in BASE_TABLES:
            return self.base(name)
        raise AttributeError(name)

    @cached_property
    def as_of(self):
        return F.lit(AS_OF).cast("timestamp")


def oracle(views: str, body: str, ctes: str = "") -> str:
    """Oracle SQL text: the named views (with ``ctes`` after them), then ``body``."""
    parts = [f"{v} AS ({VIEW_SQL[v].strip()})" for v in views.split()]
    if ctes.strip():
        parts.append(ctes.strip().rstrip(","))
    head = f"WITH RECURSIVE {', '.join(parts)}\n" if "RECURSIVE" in ctes else (f"WITH {', '.join(parts)}\n" if parts else "")
    return head + body.strip()
