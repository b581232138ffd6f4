"""Session settings the jobs rely on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that change results or plans; all can be set at runtime.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # the JVM never compiles methods above 8000 bytes of code; long score
    # expressions run faster in split projections than in one such method
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def apply_runtime_settings(spark: SparkSession) -> SparkSession:
    """Pin the settings the operators assume on a session made elsewhere."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "newsloom", master: str | None = None, **extra: str) -> SparkSession:
    """Session for local runs and tests; a cluster passes its own session in."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        **RUNTIME_SETTINGS,
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Folder of each local application that names none; the setting itself is static.
_LOCAL_FOLDERS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables and stream state.

    The cluster names a shared folder in ``spark.checkpoint.dir``.  Only a
    session in local mode, as in tests, gets a folder of its own when that is
    unset, which goes when the process ends; elsewhere a driver-local folder
    would not be seen by executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.conf.get("spark.app.id")
        folder = _LOCAL_FOLDERS.get(app)
        if not folder:
            folder = _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Lost executors then cost no recompute of what lies before.  Unlike an RDD
    checkpoint this computes the input once and keeps size statistics, so the
    planner still sees a small table as small.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/newsloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Rows that fan out after a shuffle get this many times the usual partitions.
FAN_OUT_FACTOR = 4


# Rows that one task may get from a fan-out: its sorts hold them in memory.
FAN_OUT_ROWS = 500_000


def spread_partitions(spark: SparkSession, rows: int = 0) -> int:
    """Partitions for rows that are small now and fan out later, into ``rows`` in all where that is known.

    A count other than the session's own also keeps the planner from dropping
    the repartition as redundant, after which adaptive coalescing would put all
    small rows, and their fan-out, into one task.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")) * FAN_OUT_FACTOR, -(-rows // FAN_OUT_ROWS))
