"""Running streams to the end of the available input, and reading their output."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from newsloom.session import checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State beyond executor memory, and the store that arbitrary state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def file_stream(spark: SparkSession, folder: str, table: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A table's files as a stream, ``files_per_batch`` at a time if given.

    A table is a folder of part files, or a single file in ``folder``.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}.parquet")
    store = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if store.getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{table}.parquet")
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def in_parts(df: DataFrame, order: str, parts: int, folder: str, table: str) -> int:
    """Write ``df`` as a folder table whose files follow each other in ``order``; the number of files of a part.

    Rows of a part come later in ``order`` than those of the parts before, and
    its files are written after theirs, which is the order a stream reads in.  A
    part has as many files as the input has splits, so parts grow with it.
    """
    files = df.rdd.getNumPartitions()
    cuts = df.select(F.percentile_approx(order, [k / parts for k in range(1, parts)]).alias("cuts")).first()["cuts"] or []
    edges = [None, *sorted(set(cuts)), None]
    for low, high in zip(edges, edges[1:]):
        part = df if low is None else df.where(F.col(order) > low)
        part = part if high is None else part.where(F.col(order) <= high)
        if low is None:
            part = part.union(df.where(F.col(order).isNull())) if high is not None else df
        part.repartition(files).write.mode("append").parquet(f"{folder}/{table}.parquet")
    return files


class _LateRows(StreamingQueryListener):
    """Adds up, batch by batch, the rows that state left out as too late."""

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}
        self.batches: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        late = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        self.dropped[run] = self.dropped.get(run, 0) + late
        self.batches[run] = self.batches.get(run, 0) + 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def start_to_folder(stream: DataFrame, folder: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Write every micro-batch to its own sub-folder; a replayed batch replaces itself."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(save)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def drain(stream: DataFrame, mode: str, keys: Sequence[str] = (), late: list[int] | None = None) -> DataFrame:
    """Run the stream over all input there is and return its result as a table.

    In update mode the newest row per key is the result.  The number of rows that
    came too late is appended to ``late``; without such a list, late rows are an
    error, so that none is lost unnoticed.
    """
    spark = stream.sparkSession
    use_rocksdb(spark)
    root = f"{checkpoint_dir(spark)}/newsloom-stream-{uuid.uuid4().hex}"
    listener = _LateRows()
    spark.streams.addListener(listener)
    try:
        query = start_to_folder(stream, f"{root}/out", mode, f"{root}/checkpoint")
        query.awaitTermination()
        # events of the last batches may still be on their way to the listener
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    dropped = listener.dropped.get(str(query.runId), 0)
    if late is not None:
        late.append(dropped)
    elif dropped:
        raise ValueError(f"{dropped} rows came later than the stream's lateness allows")
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    # an empty first part, so that a stream without any batch can be read
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{root}/out/batch=-1")
    out = spark.read.schema(schema).parquet(f"{root}/out")
    if mode == "update":
        rest = [c for c in stream.columns if c not in keys]
        newest = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
        return newest.select(*keys, "_row.*").select(*stream.columns)
    return out.drop("batch")
