"""Web archives: writing, reading back, and one ordered index over all of them.

Each task writes its captures as archives of gzip members in the shared folder,
under names of its own: a task that runs twice leaves a file that nothing
refers to.  Reading an archive gives its captures as a *run* in order of URL key
and time.  The runs are range-partitioned by that order, and each partition
merges its pieces of all runs with a loser tree, which gives capture histories
in global order.

A null payload counts as empty.  Of captures with equal payloads of at least
``min_bytes`` bytes those with the largest id are responses (rows that repeat
that id too) and the others revisit them; a null id counts as smallest, and if
all are null all are responses.  Smaller payloads are always responses.  A null
URL is left out of the record and has the empty key.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import shared_path, staged

#: An archive is closed once it is this large.
ARCHIVE_BYTES = 64 << 20
#: Time of the capture with id 0 where the table has no times.
EPOCH = 1_700_000_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NONE = "none"


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels from the right, then path and query, in lower case."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        return url.lower()
    return f"{host}){parts.path.lower()}" + (f"?{parts.query.lower()}" if parts.query else "")


def _record(page_id: int | None, url: str | None, time: int, digest: str, refers: int | None, revisit: bool, payload: bytes) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = _NONE if page_id is None else page_id
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:capture:{name}>",
        f"WARC-Date: {datetime.fromtimestamp(time, timezone.utc):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(2, f"WARC-Target-URI: {quote(url, safe='%/:?#[]@!$&()*+,;=~-._' + chr(39))}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:capture:{refers}>", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_bytes: int = 1000) -> DataFrame:
    """Write all captures; returns a table of the archives' addresses."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.encode("payload", "UTF-8")))
    large = F.octet_length("payload") >= min_bytes
    # only payloads that occur under several ids need a lookup
    first = rows.where(large).groupBy("digest").agg(F.max("id").alias("refers"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(first, "digest", "left").select("id", "url", "payload", "digest", "refers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        out = name = None
        written = 0
        done = []
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, digest, refers = (c[i].as_py() for c in batch.columns)
                if out is None:
                    store.create_dir(base, recursive=True)
                    name, written = f"{base}/captures-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(name, compression=None)
                data = payload.encode()
                revisit = refers is not None and page_id != refers and len(data) >= min_bytes
                member = _member(_record(page_id, url, EPOCH + (page_id or 0) % (1 << 31), digest, refers, revisit, data))
                out.write(member)
                written += len(member)
                if written >= ARCHIVE_BYTES:
                    out.close()
                    done.append(name)
                    out = None
        if out is not None:
            out.close()
            done.append(name)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["archive"])

    return rows.mapInArrow(run, "archive string")


def _members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """Contents of the gzip members of a stream, one at a time."""
    unpack, parts, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(size)
        if not data:
            return
        parts.append(unpack.decompress(data))
        data = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []


def _parsed(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if revisit:
        size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    else:
        size, found = len(payload), hashlib.sha1(payload).hexdigest()
        if found != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    name = lambda x: None if x.endswith(f":{_NONE}>") else int(x[x.rindex(":") + 1 : -1])
    return {
        "url_key": url_key(fields.get("WARC-Target-URI")),
        "time": fields["WARC-Date"],
        "id": name(fields["WARC-Record-ID"]),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": name(fields["WARC-Refers-To"]) if revisit else None,
    }


_ENTRY = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("place", T.LongType()),
        T.StructField("url_key", T.StringType()),
        T.StructField("time", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
    ]
)
_ENTRY_ARROW = pa.schema([(f.name, pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for f in _ENTRY])


def order_key(entry: dict) -> tuple:
    """URL key, time, id (nulls first), then the place in the archives."""
    return entry["url_key"], entry["time"], entry["id"] is not None, entry["id"] or 0, entry["run"], entry["place"]


def read_archives(archives: DataFrame) -> DataFrame:
    """Captures of each archive, as a run sorted by URL key and time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(name) if "://" in name else (fs.LocalFileSystem(), name)
                with store.open_input_stream(path, compression=None) as stream:
                    entries = [_parsed(m) | {"run": name, "offset": n} for n, m in enumerate(_members(stream))]
                for e in entries:
                    e["place"] = e["offset"]
                entries.sort(key=order_key)
                for place, e in enumerate(entries):
                    e["place"] = place
                for start in range(0, len(entries), 10_000):
                    yield pa.RecordBatch.from_pylist(entries[start : start + 10_000], schema=_ENTRY_ARROW)

    return archives.mapInArrow(run, _ENTRY)


class LoserTree:
    """Merges sorted lists: each inner node keeps the loser of its match, the root's winner comes out."""

    def __init__(self, runs: list[list[dict]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.keys = [order_key(r[0]) if r else None for r in runs]
        self.tree = [-1] * max(1, len(runs))
        for i in range(len(runs)):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, winner: int) -> None:
        node = (winner + len(self.runs)) // 2
        while node:
            held = self.tree[node]
            if held < 0:
                self.tree[node] = winner
                return
            if self._before(held, winner):
                self.tree[node], winner = winner, held
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[dict]:
        while self.runs:
            winner = self.tree[0]
            if self.keys[winner] is None:
                return
            run, at = self.runs[winner], self.at[winner]
            yield run[at]
            self.at[winner] = at + 1
            self.keys[winner] = order_key(run[at + 1]) if at + 1 < len(run) else None
            self._play(winner)


def merge_runs(entries: DataFrame) -> DataFrame:
    """All runs merged into global order; ``part`` and ``slot`` give a row's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        runs: dict[str, list[dict]] = {}
        for batch in batches:
            for e in batch.to_pylist():
                runs.setdefault(e["run"], []).append(e)
        for r in runs.values():
            r.sort(key=lambda e: e["place"])  # blocks of one run may arrive out of turn
        rows, slot = [], 0
        schema = _ENTRY_ARROW.append(pa.field("part", pa.int32())).append(pa.field("slot", pa.int64()))
        for e in LoserTree(list(runs.values())):
            rows.append(e | {"part": part, "slot": slot})
            slot += 1
            if len(rows) == 10_000:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    # ids are part of the order, so one frequent URL does not stay in one part
    ranged = entries.repartitionByRange("url_key", "time", "id", "run", "place")
    return ranged.mapInArrow(run, T.StructType([*_ENTRY.fields, T.StructField("part", T.IntegerType()), T.StructField("slot", T.LongType())]))


def capture_histories(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Write ``pages`` as archives, read them back and merge their indexes.

    Returns url_key, time, id, payload_bytes, payload_digest, record_type,
    refers_to and the row's place in the global order.
    """
    spark = pages.sparkSession
    archives = staged(write_archives(pages, folder or shared_path(spark, "warc"), **columns), "archives")
    # names are tiny: a fixed count keeps adaptive execution from reading all archives in one task
    spread = archives.repartition(max(1, archives.count()), "archive")
    return merge_runs(staged(read_archives(spread), "runs"))
