import glob
import gzip
import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from newsloom.llm import maxscore, warc
from newsloom.llm.common import shared_path

VECTORS = "vec_id bigint, embedding array<float>, label int"


def _brute(rows, k, every):
    best = {}
    usable = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        t = [int(np.floor(1024 * float(np.float32(x)))) for x in v]
        usable[i] = min(usable.get(i, t), t)
    for q, t in usable.items():
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(t, u)), i) for i, u in usable.items() if i != q)
            best[q] = [(i, -s) for s, i in scored[:k]]
    return best


def test_top_k_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.0, 0.5, -0.25, rng.uniform(-1, 1)]) for _ in range(12)]) for i in range(300)]
    rows += [(400, rows[3][1]), (401, rows[3][1]), (402, [0.0] * 12), (403, None), (404, [None] * 12), (405, [float("nan")] * 12), (406, [float("inf")] * 12), (407, [1.0]), (None, rows[1][1]), (5, rows[5][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).withColumn("score", F.lit(1))
    got = {}
    for r in maxscore.top_k(df, F.col("vec_id") % 20 == 0, k=7, shard_rows=37, query_rows=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == _brute(rows, 7, 20)


def test_top_k_of_few_or_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0], 0), (1, [2.0], 0)], VECTORS)
    assert [tuple(r) for r in maxscore.top_k(df, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert maxscore.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_later_shards_probe_only_competitive_rows():
    rng = np.random.default_rng(1)
    best = maxscore.TopK(3)
    rows = rng.integers(-1000, 1000, (500, 16))
    terms = rng.integers(-1000, 1000, 16)
    for part in np.array_split(np.arange(500), 5):
        maxscore.Shard(part, rows[part]).search(-1, terms, best)
    want = sorted(((-int(s), i) for i, s in enumerate(rows @ terms)))[:3]
    assert [(-int(s), int(i)) for s, i in zip(*best.best[-1])] == want


PAGES = "page_id bigint, url string, html string"


def test_archives_round_trip(spark):
    long, other = "x" * 1500, "é" * 700
    rows = [
        (1, "http://b.example/z", long), (2, "http://a.example/\r\nq?x=1", long), (3, None, long), (4, "http://a.example/", "short"), (5, "", "short"),
        (6, "http://a.example/", None), (7, "http://a.example/", ""), (8, "bad://[", other), (None, "http://n/", other), (8, "bad://[", other), (9, "u", "WARC/1.1\r\n\r\n" * 100), (10, "http://a.example/" + "p" * 5000, "y" * 300_000),
    ]
    df = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("mine"))
    folder = shared_path(spark, "test-warc")
    out = warc.capture_histories(df, folder).orderBy("part", "slot").collect()
    assert len(out) == len(rows)
    keys = [warc.order_key(r.asDict()) for r in out]
    assert keys == sorted(keys)
    by_id = {}
    for r in out:
        by_id.setdefault(r["id"], []).append(r)
    for i, _, html in rows:
        data = (html or "").encode()
        r = by_id[i][0]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
    kinds = {i: (r[0]["record_type"], r[0]["refers_to"]) for i, r in by_id.items()}
    assert kinds[1] == kinds[2] == ("revisit", 3) and kinds[3] == ("response", None)
    assert kinds[4] == kinds[5] == kinds[6] == ("response", None)
    assert kinds[None] == ("revisit", 8) and [r["record_type"] for r in by_id[8]] == ["response"] * 2
    # a standard gzip reader sees the same records
    whole = b"".join(gzip.open(f).read() for f in glob.glob(f"{folder.removeprefix('file:')}/*.warc.gz"))
    assert whole.count(b"WARC-Type: ") == len(rows)


def test_loser_tree_merges_runs():
    rng = random.Random(5)
    entry = lambda n, run, place: {"url_key": f"{n:03d}", "time": "t", "id": n, "run": run, "place": place}
    for k in (0, 1, 2, 3, 7):
        runs = [[entry(n, str(r), p) for p, n in enumerate(sorted(rng.choices(range(40), k=rng.randint(0, 20))))] for r in range(k)]
        got = [warc.order_key(e) for e in warc.LoserTree(runs)]
        assert got == sorted(warc.order_key(e) for r in runs for e in r)


def test_no_pages(spark):
    assert warc.capture_histories(spark.createDataFrame([], PAGES)).count() == 0


def test_large_finite_vectors_take_part(spark):
    """Sums that leave doubles, and those that leave 64 bits, against Python's integers."""
    rng = random.Random(9)
    scales = [1.0, 200_000.0, 3e9, 1e25]
    rows = [(i, [rng.uniform(-1, 1) * scales[i % 4] for _ in range(6)]) for i in range(80)]
    rows += [(100, [131071.9] * 1024), (101, [131071.9] * 1024), (102, [float("inf")] + [0.0] * 5), (103, [1.0, None]), (104, None), (105, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = maxscore.top_k(df, F.col("vec_id") % 5 == 0, k=4, shard_rows=16, query_rows=7)
    usable = {i: [math.floor(1024 * x) for x in v] for i, v in rows if i not in (102, 103, 104)}
    want = []
    for q in (i for i in usable if i % 5 == 0):
        scored = [(min(max(sum(a * b for a, b in zip(usable[q], v)), -maxscore.LARGEST), maxscore.LARGEST), i) for i, v in usable.items() if i != q]
        want += [(q, n, i, s) for n, (s, i) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:4], 1)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
