"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from newsloom.session import checkpoint_dir

#: Characters that separate words: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


#: Drops an execution's shuffle files at its end; a written table needs them no more.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str, compression: str = "snappy") -> str:
    """Write ``df`` as Parquet; the shuffle files that made it go at once."""
    spark = df.sparkSession
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.unset(_SHUFFLE_CLEANUP) if before is None else spark.conf.set(_SHUFFLE_CLEANUP, before)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    What comes after is computed from the files, so a lost executor costs no
    recompute of what lies before, and two readers share one computation.
    """
    path = write_table(df, shared_path(df.sparkSession, name))
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.staged_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.staged_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: What a worker process holds beyond a task, by the operator it is for.
HELD: dict = {}
#: Rows whose texts are Python objects at once.
ROWS_AT_ONCE = 256

Batches = Iterator[pa.RecordBatch]


def in_worker(run: Callable[[Batches], Batches], owner: str | None = None) -> Callable[[Batches], Batches]:
    """``run`` for ``mapInArrow``, over batches of few rows, leaving a small worker behind.

    Spark keeps workers for later steps.  What another operator than ``owner``
    holds in one is dropped first, and at the end freed memory goes back to the
    system.
    """

    def whole(batches: Batches) -> Batches:
        for name in [n for n in HELD if n != owner]:
            del HELD[name]
        yield from run(batch.slice(at, ROWS_AT_ONCE) for batch in batches for at in range(0, batch.num_rows, ROWS_AT_ONCE))
        give_back()

    return whole


def give_back() -> None:
    """Return the memory that this process has freed to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(text: str, size: int = 1 << 16) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters that end at a blank or line feed.

    A piece grows where no such place follows, so no word is ever cut.
    """
    start = 0
    while len(text) - start > 2 * size:
        cuts = [c for c in (text.find(" ", start + size), text.find("\n", start + size)) if c >= 0]
        if not cuts:
            break
        yield text[start : min(cuts)]
        start = min(cuts)
    yield text[start:] if start else text
