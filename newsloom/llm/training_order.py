"""Training order: token sequences in shuffled, fixed-size binary shards.

Documents are encoded, joined with an end token and cut into sequences of equal
length; a task packs what it reads, so only its last sequence is filled up.  The
sequences are numbered by where the written table holds them.  A keyed Feistel
permutation of that many numbers, with cycle walking, gives each sequence its
slot in the training order: no two meet, none is missing, and neither a sort by
random keys nor any table of the order is needed.  Slots are dealt out by range,
several shards of equal stride to a part; record k of a run of shards lies at a
fixed offset, so reading is sequential and can resume anywhere.  A manifest says
how many sequences there are, and reading fails at a shard that is missing or
too short.

A shard's content follows from key and table alone.  It is written under another
name and moved into place, so a task that runs twice does no harm.

Null and empty texts add nothing but their end token; null ids stay null in the
result, repeated rows are packed again.  An empty table gives no shards.  Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.bpe import WordBpe
from newsloom.llm.common import mix64, shared_path, write_table

LENGTH = 1024
#: Sequences per shard.
STRIDE = 4096
#: Shards that one task writes, one after another.
SHARDS_PER_PART = 8
#: Files of the sequence table up to which their offsets are copied to each task.
COPIED_FILES = 100_000
MANIFEST = "manifest.json"
ROUNDS = 6


def permuted(numbers: np.ndarray, size: int, key: int) -> np.ndarray:
    """The place of each number below ``size`` under a keyed permutation of them.

    A Feistel network permutes the next larger even power of two; results beyond
    ``size`` are permuted again until they fall below it, which keeps the map one
    to one.  At most four times too many numbers: few turns are needed.
    """
    half = np.uint64(max(1, -(-max(size - 1, 1).bit_length() // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % 2**64))
    out = numbers.astype(np.uint64)
    open_ = np.arange(len(out))
    while len(open_):
        left, right = out[open_] >> half, out[open_] & mask
        for k in keys:
            left, right = right, left ^ (mix64(right + k) & mask)
        out[open_] = (left << half) | right
        open_ = open_[out[open_] >= np.uint64(size)]
    return out.astype(np.int64)


def pack(docs: DataFrame, model: WordBpe, end_id: int, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(first_id, n_ids, ids): sequences of ``length`` ids as bytes, filled up with ``end_id``."""
    kind = "<u2" if max(model.tokens) < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty(0, kind)
        owner = None
        end = np.array([end_id], kind)
        schema = pa.schema([("first_id", pa.int64()), ("n_ids", pa.int32()), ("ids", pa.binary())])
        for batch in batches:
            rows = []
            texts = model.encode_texts([t or "" for t in batch.column(1).to_pylist()])
            for doc, ids in zip(batch.column(0).to_pylist(), texts):
                if not len(held):
                    owner = doc
                held = np.concatenate([held, ids.astype(kind), end])
                if len(held) >= length:
                    whole = len(held) // length
                    for k in range(whole):
                        rows.append((owner if not k else doc, length, held[k * length : (k + 1) * length].tobytes()))
                    held, owner = held[whole * length :], doc
                    if len(rows) >= 1024:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
        if len(held):
            full = np.concatenate([held, np.full(length - len(held), end_id, kind)])
            yield pa.RecordBatch.from_arrays([pa.array([owner], pa.int64()), pa.array([len(held)], pa.int32()), pa.array([full.tobytes()], pa.binary())], schema=schema)

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "first_id bigint, n_ids int, ids binary")


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (fs.LocalFileSystem(), folder)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _write_manifest(folder: str, count: int, stride: int, key: int) -> None:
    store, base = _opened(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/{MANIFEST}", compression=None) as f:
        f.write(json.dumps({"count": count, "stride": stride, "key": key}).encode())


def write_shards(sequences: DataFrame, folder: str, key: int, stride: int = STRIDE) -> DataFrame:
    """Write ``sequences`` (first_id, n_ids, ids) in training order; one row per sequence says where it is.

    Returns first_id, n_ids, slot, shard, place and the SHA-256 of its bytes.
    """
    spark = sequences.sparkSession
    path = write_table(sequences, shared_path(spark, "sequences"), compression="zstd")
    table = spark.read.schema("first_id bigint, n_ids int, ids binary").parquet(path)
    table = table.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    # one count per written file, as many as there were tasks
    counts = table.groupBy("file").count().orderBy("file").collect()
    total = sum(r["count"] for r in counts)
    starts = np.cumsum([0, *(r["count"] for r in counts)]).tolist()
    offsets = spark.createDataFrame([(r["file"], s) for r, s in zip(counts, starts)], "file string, start bigint")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = permuted(batch.column(3).to_numpy(), total, key)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(slot), pa.array(slot // stride)], names=["first_id", "n_ids", "ids", "slot", "shard"])

    placed = (
        table.join(F.broadcast(offsets) if len(counts) <= COPIED_FILES else offsets, "file")
        .select("first_id", "n_ids", "ids", (F.col("start") + F.col("row")).alias("number"))
        .mapInArrow(place, "first_id bigint, n_ids int, ids binary, slot bigint, shard bigint")
    )
    parts = max(1, -(-total // (stride * SHARDS_PER_PART)))
    _write_manifest(folder, total, stride, key)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _opened(folder)
        out = name = shard = None

        def close() -> None:
            if out is not None:
                out.close()
                store.move(name, f"{base}/{shard_name(shard)}")

        for batch in batches:
            digests = []
            for ids, at in zip(batch.column(2), batch.column(4).to_pylist()):
                if at != shard:
                    close()
                    store.create_dir(base, recursive=True)
                    shard, name = at, f"{base}/.{shard_name(at)}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(name, compression=None)
                data = ids.as_py()
                out.write(data)
                digests.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*batch.select([0, 1, 3, 4]).columns, pa.array(digests, pa.string())], names=["first_id", "n_ids", "slot", "shard", "ids_sha256"]
            )
        close()

    # a shard is whole within one part: parts are ranges of shards, known beforehand, so nothing is sampled for them
    part = F.floor(F.col("shard") / SHARDS_PER_PART).cast("int")
    ordered = placed.repartitionById(parts, part).sortWithinPartitions("slot")
    written = ordered.mapInArrow(write, "first_id bigint, n_ids int, slot bigint, shard bigint, ids_sha256 string")
    return written.withColumn("place", F.col("slot") % stride)


def read_sequences(folder: str, length: int = LENGTH, start: int = 0, kind: str = "<u2") -> Iterator[np.ndarray]:
    """Sequences from slot ``start`` on, in order; fails if one that the manifest counts is not there."""
    store, base = _opened(folder)
    with store.open_input_stream(f"{base}/{MANIFEST}", compression=None) as f:
        manifest = json.loads(f.read())
    count, stride = manifest["count"], manifest["stride"]
    size = length * np.dtype(kind).itemsize
    while start < count:
        shard, skip = divmod(start, stride)
        end = min(count, (shard + 1) * stride)
        with store.open_input_file(f"{base}/{shard_name(shard)}") as f:
            if f.size() != (end - shard * stride) * size:
                raise ValueError(f"{shard_name(shard)} has {f.size()} bytes instead of {(end - shard * stride) * size}")
            f.seek(skip * size)
            for _ in range(start, end):
                yield np.frombuffer(f.read(size), kind)
        start = end
