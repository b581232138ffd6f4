"""Operators against plain loops on small random inputs, and plan shapes."""

import random
from datetime import datetime, timedelta
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from sample_data import SF_DIR

from newsloom import catalog
from newsloom.operators import common, dedup, feed, profiles, vectors
from newsloom.session import checkpoint_dir, cut_lineage


def test_clamped_walk_equals_loop(spark, monkeypatch):
    monkeypatch.setattr(profiles, "WALK_SLICE", 7)
    rng = random.Random(3)
    rows, want = [], {}
    for seq in range(400):
        key, delta = f"k{rng.randrange(3)}", rng.choice([-1, -1, 1, 2])
        want[key] = max(want.get(key, 0) + delta, 0)
        rows.append((1, "topic", key, seq, delta, datetime(2024, 1, 1) + timedelta(seconds=seq)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "user_id long, kind string, key string, seq long, delta int, created_at timestamp")
    assert {r.key: r["count"] for r in profiles.profile_counters(df).collect()} == want


def test_ordered_rank_equals_row_number(spark):
    rows = [(i % 3 if i % 5 else None, i, (i * 7) % 50) for i in range(200)]
    df = spark.createDataFrame(rows, "g long, id long, v long")
    ranked = common.ordered_rank(df, ["g"], F.floor(F.col("v") / 10), [F.col("v"), F.col("id")], "r")
    plain = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    assert sorted(map(str, ranked.select("g", "id", "r").collect())) == sorted(map(str, plain.select("g", "id", "r").collect()))


def test_comment_tree_of_a_long_chain(spark):
    n = 70
    rows = [(i, 1, 9, i - 1 if i else None, datetime(2024, 1, 1) + timedelta(minutes=i)) for i in range(n)]
    rows.append((1000, 2, 9, 5, datetime(2024, 1, 1)))  # parent under another article: a root
    df = spark.createDataFrame(rows, "comment_id long, ai_news_id long, user_id long, parent_comment_id long, created_at timestamp")
    got = {r.comment_id: r for r in profiles.comment_tree(df).collect()}
    assert len(got) == n + 1
    assert got[n - 1].depth == n - 1 and got[n - 1].root_id == 0
    assert got[n - 1].path == "/".join(map(str, range(n)))
    assert got[1000].depth == 0 and got[1000].parent_id is None


def _ranked(rng, users=6, n=60):
    topics = ["a", "b", "c", "d", "e"]
    rows = []
    for u in range(users):
        known = set(rng.sample(topics, rng.randrange(0, 5)))
        for pos in range(1, n + 1):
            topic = rng.choice(topics[: 2 + u % 4])
            rows.append(
                dict(user_id=u, ai_news_id=pos * 10 + u, rank_pos=pos, rank_score=float(100 - pos), category=topic,
                     region=rng.choice(["uz", "global"]), topic_known=topic in known,
                     preferred=topic in known or rng.random() < 0.2, seen=rng.random() < 0.2)
            )
    return rows


RANKED_SCHEMA = (
    "user_id long, ai_news_id long, rank_pos int, rank_score double, category string, region string, topic_known boolean, "
    "preferred boolean, seen boolean"
)


def _slots(rows, limit):
    """Greedy selection of one user, step by step."""
    pref, taken, used = int(limit * 0.7), [], {}

    def take(pool, slots):
        picked = 0
        for r in pool:
            if picked >= slots:
                break
            if r["seen"] or r in taken or used.get(r["category"], 0) >= 3:
                continue
            taken.append(r)
            used[r["category"]] = used.get(r["category"], 0) + 1
            picked += 1

    take([r for r in rows if r["preferred"]], pref)
    take([r for r in rows if not r["preferred"] and not r["topic_known"]], max(1, int(limit * 0.12)))
    take([r for r in rows if not r["preferred"]], limit - pref - max(0, len(taken) - pref))
    take(rows, limit - len(taken))
    return taken


def _quota(picked, limit):
    regional = [r for r in picked if r["region"] == "uz"][: int(limit * 0.6)]
    other = [r for r in picked if r["region"] != "uz"][: int(limit * 0.4)]
    out = regional + other
    out += [r for r in picked if r not in out]
    out = out[:limit]
    if len(out) >= 5:
        out[:5] = sorted(out[:5], key=lambda r: -r["rank_score"])
    return out


def _swaps(final, rows, limit):
    final, bound = list(final), int(limit * 0.6)
    count = lambda t: sum(r["category"] == t for r in final)
    for t in sorted({r["category"] for r in final}):
        removed = []
        while count(t) > bound:
            last = max(i for i, r in enumerate(final) if r["category"] == t)
            removed.append(final.pop(last))
            for r in rows:
                if r in final or r in removed or r["seen"] or count(r["category"]) >= bound:
                    continue
                final.append(r)
                break
    need = max(1, int(limit * 0.2)) - sum(not r["topic_known"] for r in final)
    for i in range(len(final) - 1, -1, -1):
        if need <= 0:
            break
        if final[i]["topic_known"]:
            fresh = [r for r in rows if r not in final and not r["seen"] and not r["topic_known"]]
            if fresh:
                final[i] = fresh[0]
                need -= 1
    return final


@pytest.mark.parametrize("limit", [4, 5, 10, 20])
def test_assembly_equals_greedy_walk(spark, limit):
    rows = _ranked(random.Random(limit))
    df = spark.createDataFrame(rows, RANKED_SCHEMA)
    short = feed.shortlist(df, limit)
    slots = feed.preference_slots(short, limit)
    placed = feed.region_quota(slots, limit)
    swapped = feed.diversity_swaps(placed, limit)
    full_slots = feed.preference_slots(df, limit)

    def by_user(d, pos):
        out = {}
        for r in d.where(F.col(pos).isNotNull()).orderBy("user_id", pos).collect():
            out.setdefault(r.user_id, []).append(r.ai_news_id)
        return out

    picked, quota, final, full = by_user(slots, "slot_pos"), by_user(placed, "feed_pos"), by_user(swapped, "feed_pos"), by_user(full_slots, "slot_pos")
    for u in range(6):
        mine = [r for r in rows if r["user_id"] == u]
        want = _slots(mine, limit)
        assert picked.get(u, []) == full.get(u, []) == [r["ai_news_id"] for r in want]
        want = _quota(want, limit)
        assert quota.get(u, []) == [r["ai_news_id"] for r in want]
        assert final.get(u, []) == [r["ai_news_id"] for r in _swaps(want, mine, limit)]


def test_oversized_topic_is_bounded(spark):
    rng = random.Random(1)
    rows = []
    for u in range(3):
        for pos in range(1, 41):
            topic = "a" if pos <= 18 else rng.choice(["a", "b", "c"])
            rows.append(dict(user_id=u, ai_news_id=pos, rank_pos=pos, rank_score=float(-pos), category=topic, region="uz",
                             topic_known=False, preferred=False, seen=rng.random() < 0.3))
    df = spark.createDataFrame(rows, RANKED_SCHEMA).withColumn("feed_pos", F.when(F.col("rank_pos") <= 20, F.col("rank_pos")))
    got = feed.diversity_swaps(df, 20).where("feed_pos IS NOT NULL").orderBy("user_id", "feed_pos").collect()
    for u in range(3):
        mine = [r for r in rows if r["user_id"] == u]
        want = _swaps(mine[:20], mine, 20)
        assert [r.ai_news_id for r in got if r.user_id == u] == [r["ai_news_id"] for r in want]


def test_dedupe_is_idempotent(spark):
    rows = [(i, f"https://x/{i % 7}" if i % 4 else "") for i in range(60)]
    df = spark.createDataFrame(rows, "seq long, source_url string")
    once = dedup.dedupe_first_by_url(df, "seq")
    assert sorted(map(str, once.collect())) == sorted(map(str, dedup.dedupe_first_by_url(once, "seq").collect()))
    assert once.count() == 7


@pytest.mark.parametrize("blocks", [False, True])
def test_cosine_topk_equals_expression(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(vectors, "MAX_COPIED_NUMBERS", 0)
        monkeypatch.setattr(vectors, "BLOCK_VECTORS", 4)
    rng = random.Random(5)
    vec = lambda: [rng.gauss(0, 1) for _ in range(8)]
    big = spark.createDataFrame([(i, vec()) for i in range(50)], "b long, vector array<double>")
    small = spark.createDataFrame([(i, vec()) for i in range(6)] + [(99, [0.0] * 8)], "s long, vector array<double>")
    pairs = big.withColumnRenamed("vector", "v1").crossJoin(small.withColumnRenamed("vector", "v2"))
    pairs = pairs.select("b", "s", vectors.cosine(F.col("v1"), F.col("v2")).alias("sim"))
    for per, other in (("b", "s"), ("s", "b")):
        want = common.top_rows(pairs, [per], [F.col("sim").desc(), F.col(other)], 3, "rank")
        got = vectors.cosine_topk(big, small, "b", "s", 3, per=per)
        assert {(r.b, r.s, r.similarity, r["rank"]) for r in got.collect()} == {(r.b, r.s, r.sim, r["rank"]) for r in want.collect()}


def test_topic_cap_and_noise(spark):
    rows = _ranked(random.Random(2))
    df = spark.createDataFrame(rows, RANKED_SCHEMA)
    capped = feed.topic_cap(df)
    assert capped.groupBy("user_id", "category").count().agg(F.max("count")).first()[0] <= 3
    noisy = feed.exploration_noise(df).collect()
    assert all(0 <= r.explored_score - r.rank_score < 0.15 for r in noisy)
    assert noisy == feed.exploration_noise(df).collect()


def plan_of(spark, key):
    return catalog.QUERIES[key](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


def test_caps_limit_groups_before_the_shuffle(spark):
    plan = plan_of(spark, "topic_cap")
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize(
    "key", ["user_feed", "feed_fanout", "audience_counts", "match_articles_topics", "recommendation_metrics", "profile_counters", "global_feed"]
)
def test_no_all_pairs_join_and_no_python(spark, key):
    plan = plan_of(spark, key)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "EvalPython" not in plan and "InPandas" not in plan


def test_scans_are_pruned(spark):
    plan = plan_of(spark, "published_on_day")
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan


def test_checkpoint_folder_where_none_is_named(spark):
    unset = {"spark.master": "local[2]", "spark.app.id": "app-1"}
    folder = checkpoint_dir(SimpleNamespace(conf=unset))
    assert Path(folder).is_dir()
    assert checkpoint_dir(SimpleNamespace(conf=dict(unset))) == folder
    assert checkpoint_dir(SimpleNamespace(conf=unset | {"spark.checkpoint.dir": "/shared"})) == "/shared"
    with pytest.raises(ValueError):
        checkpoint_dir(SimpleNamespace(conf=unset | {"spark.master": "spark://a:7077"}))
    assert cut_lineage(spark.range(3)).count() == 3


def test_session_facts_equal_windows(spark, tables):
    from newsloom.catalog import feeds

    rows = feeds._rows(tables)
    made = [*feed.SESSION_COLUMNS, "likes_last", "topic_count"]
    by_window = feed.session_columns(rows.drop(*made)).select("user_id", "ai_news_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in made])
    carried = rows.select("user_id", "ai_news_id", *made)
    assert carried.where("topic_session > 0").count() > 0
    assert carried.exceptAll(by_window).count() == 0 and by_window.exceptAll(carried).count() == 0
