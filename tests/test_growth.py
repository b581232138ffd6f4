"""Plans whose shuffles must not grow with what users fan out into."""

import random
from datetime import datetime
from hashlib import sha256

import pandas as pd
from pyspark.sql import functions as F
from sample_data import SF_DIR

from newsloom import catalog, session
from newsloom.functions import texts
from newsloom.operators import feed, pages, personas, profiles, text
from newsloom.plans import user_feed
from newsloom.streaming import jobs


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_profile_of_wanted_keys_moves_likes_only(spark):
    when = datetime(2024, 1, 20)
    log = spark.createDataFrame([(1, 1, True, when), (1, 2, True, when), (2, 2, True, when)], "user_id long, ai_news_id long, liked boolean, created_at timestamp")
    articles = spark.createDataFrame([(1, 1, "Sport", "alpha bravo alpha"), (2, 1, "Sport", "bravo charlie")], "ai_news_id long, raw_news_id long, category string, final_text string")
    raw = spark.createDataFrame([(1, "https://a.uz/1")], "raw_news_id long, source_url string")
    as_of = F.lit("2024-01-31").cast("timestamp")
    wanted = spark.createDataFrame([("keyword", "bravo", 1), ("keyword", "bravo", 2), ("topic", "sport", 1)], "kind string, key string, slot int")
    got = profiles.profile_from_likes(log, articles, raw, as_of, wanted=wanted)
    rows = {(r["user_id"], r["kind"], r["key"]): r["count"] for r in got.collect()}
    assert rows == {(1, "keyword", "bravo"): 2, (1, "topic", "sport"): 2, (2, "keyword", "bravo"): 1, (2, "topic", "sport"): 1}
    maps = feed.profile_maps(got, wanted, as_of)
    weights = {r["user_id"]: (sorted(r["overlaps"]), sorted(r["topic_weights"]), r["source_weights"]) for r in maps.collect()}
    assert weights == {1: ([1, 2], [1], {}), 2: ([1, 2], [1], {})}
    above, found, _ = plan_of(maps).partition("Generate inline(entries")
    assert found and "Exchange hashpartitioning" not in above


def test_keys_of_many_articles_fan_out_where_their_user_is(spark, monkeypatch):
    when = datetime(2024, 1, 20)
    log = spark.createDataFrame([(1, 1, True, when), (1, 2, True, when), (2, 2, True, when), (3, 3, True, when)], "user_id long, ai_news_id long, liked boolean, created_at timestamp")
    articles = spark.createDataFrame([(1, 1, "Sport", "alpha bravo alpha"), (2, 1, "Sport", "bravo charlie"), (3, 1, "", "none of them")], "ai_news_id long, raw_news_id long, category string, final_text string")
    raw = spark.createDataFrame([(1, "https://a.uz/1")], "raw_news_id long, source_url string")
    as_of = F.lit("2024-01-31").cast("timestamp")
    wanted = spark.createDataFrame([("keyword", "bravo", 1), ("keyword", "alpha", 2), ("topic", "sport", 1), ("source", "b.uz", 2)], "kind string, key string, slot int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (0, 1000):
            monkeypatch.setattr(profiles, "COPIED_ENTRIES", most, raising=False)
            got = profiles.profile_from_likes(log, articles, raw, as_of, wanted=wanted)
            rows = {(r["user_id"], r["kind"], r["key"]): r["count"] for r in got.collect()}
            assert rows == {(1, "keyword", "bravo"): 2, (1, "keyword", "alpha"): 1, (1, "topic", "sport"): 2, (2, "keyword", "bravo"): 1, (2, "topic", "sport"): 1}
            above, found, _ = plan_of(feed.profile_maps(got, wanted, as_of)).partition("Generate inline(entries")
            assert found and "Exchange hashpartitioning" not in above
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_profile_keys_meet_their_places_without_a_shuffle(spark):
    profile = spark.createDataFrame([(1, "keyword", "bravo", 2, datetime(2024, 1, 20)), (2, "topic", "sport", 1, datetime(2024, 1, 20))], "user_id long, kind string, key string, count long, last_seen timestamp")
    keys = spark.createDataFrame([("keyword", "bravo", 1), ("keyword", "bravo", 2), ("topic", "sport", 1)], "kind string, key string, slot int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        maps = feed.profile_maps(profile.repartition(3, "user_id"), keys, F.lit("2024-01-31").cast("timestamp"))
        plan = plan_of(maps)
        got = {r["user_id"]: (sorted(r["overlaps"]), sorted(r["topic_weights"])) for r in maps.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {1: ([1, 2], []), 2: ([], [1])}
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_fan_out_partitions_follow_its_rows(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions")) * session.FAN_OUT_FACTOR
    assert session.spread_partitions(spark) == session.spread_partitions(spark, 10) == least
    assert session.spread_partitions(spark, session.FAN_OUT_ROWS * 10 * least + 1) == 10 * least + 1


def test_drop_seen_leaves_rows_with_their_user(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, None)], "user_id long, ai_news_id long").repartition(7, "user_id")
    seen = spark.createDataFrame([(1, 2), (2, 1), (4, 1)], "user_id long, ai_news_id long")
    got = feed.drop_seen(rows, seen)
    assert sorted((r[0], r[1]) for r in got.collect()) == [(1, 1), (3, None)]
    plan = plan_of(got.hint("merge"))
    assert "ai_news_id" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)


def test_first_feeds_are_picked_per_topics_not_per_user(spark):
    got = catalog.QUERIES["seed_new_user_feed"](spark, SF_DIR)
    dealt = [x for x in plan_of(got).splitlines() if "hashpartitioning(user_id" in x]
    assert not [x for x in dealt if "raw_news_id" in x or "ai_news_id" in x.split("hashpartitioning")[1].split(")")[0] and "rank" in x]
    users = spark.createDataFrame([(1, '{"all_topics":["tech","sports"]}'), (2, '{"all_topics":["sports","tech"]}'), (3, '{"all_topics":["none"]}')], "user_id long, interests string")
    when = datetime(2024, 1, 20)
    news = spark.createDataFrame([(1, 1.0, 1, when, "tech"), (2, 1.0, 1, when, "sports|a"), (3, 1.0, 2, when, "general")], "ai_news_id long, ai_score double, raw_news_id long, created_at timestamp, target_persona string")
    had = spark.createDataFrame([(2, 2)], "user_id long, ai_news_id long")
    rows = personas.seed_new_user_feed(users, news, had).collect()
    assert sorted((r["user_id"], r["ai_news_id"], r["tier"]) for r in rows) == [(1, 2, 1), (3, 3, 2)]


def test_swaps_read_the_shortlist(spark):
    plan = plan_of(catalog.QUERIES["diversity_swaps"](spark, SF_DIR))
    assert "_topic_n" not in plan and "final_title" not in plan.split("_tail_rank")[0]


def test_one_call_counts_all_keys_of_a_share():
    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    class Handle:
        def getValueState(self, name, schema):
            return Value()

    counters = jobs._ClampedCounters()
    counters.init(Handle())

    def call(*moves):
        rows = pd.DataFrame(moves, columns=["kind", "key", "seq", "delta", "seen_us"])
        out = pd.concat(counters.handleInputRows((7, 0), iter([rows[:1], rows[1:]]), None))
        return sorted(tuple(r) for r in out.itertuples(index=False))

    # in log order: topic a goes to 0 and up again, never below
    assert call(("topic", "a", 3, 2, 30), ("topic", "a", 1, -1, 50), ("keyword", "b", 2, 1, 20)) == [(7, "keyword", "b", 1, 20), (7, "topic", "a", 2, 50)]
    # a later batch returns what it moved only, and knows the rest
    assert call(("topic", "a", 4, -1, 40)) == [(7, "topic", "a", 1, 50)]
    assert call(("keyword", "b", 5, 1, 60)) == [(7, "keyword", "b", 2, 60)]


def test_one_call_counts_all_users_of_a_group():
    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    class Handle:
        def getValueState(self, name, schema):
            return Value()

    counters = jobs._ClampedCounters()
    counters.init(Handle())

    def call(*moves):
        rows = pd.DataFrame(moves, columns=["user_id", "kind", "key", "seq", "delta", "seen_us"])
        out = pd.concat(counters.handleInputRows((5,), iter([rows]), None))
        return sorted(tuple(r) for r in out.itertuples(index=False))

    assert call((1, "topic", "a", 2, 2, 20), (2, "topic", "a", 1, 1, 10)) == [(1, "topic", "a", 2, 20), (2, "topic", "a", 1, 10)]
    assert call((2, "topic", "a", 4, -1, 40), (2, "topic", "a", 3, -1, 30)) == [(2, "topic", "a", 0, 40)]
    assert call((1, "topic", "a", 5, -1, 5)) == [(1, "topic", "a", 1, 20)]


def test_fan_out_walks_lists_of_articles(spark, monkeypatch):
    monkeypatch.setattr(personas, "LISTED_IDS", 4)
    users = spark.createDataFrame([(1, '{"all_topics":["tech"]}'), (2, '{"all_topics":["tech"]}')], "user_id long, interests string").selectExpr(
        "*", "'' AS location", "'' AS country_code", "true AS is_active"
    )
    articles = spark.createDataFrame([(i, "tech", float(i)) for i in range(10)], "ai_news_id long, target_persona string, ai_score double")
    had = spark.createDataFrame([(1, 3), (2, 9)], "user_id long, ai_news_id long")
    got = personas.feed_fanout(articles, users, had)
    assert "Generate inline(articles" in plan_of(got)
    found = sorted((r["user_id"], r["ai_news_id"], r["ai_score"], r["tier"]) for r in got.collect())
    assert found == [(u, i, float(i), 1) for u in (1, 2) for i in range(10) if (u, i) not in {(1, 3), (2, 9)}]


def test_labels_are_looked_for_where_they_may_be(spark):
    labels = ["lid:", "L\u0131D x", "l\u0130d :", "NEW\u017f: a", "\u212aasbiy nuqtai nazar: b", "SARLAVHA", "Asosiy  yangilik: c", "solid news", "amaliy qadamlar", "none", ""]
    cases = labels + [f"a\r{x}\nb" for x in labels]
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    bare = F.regexp_replace(F.regexp_replace("c", texts._LABELS + r"\s*:?", ""), texts._LINE_LABELS + r"\s*", "$1")
    rows = df.select("c", texts.drop_labels(F.col("c")).alias("got"), bare.alias("want"), texts.may_hold_labels(F.col("c")).alias("may")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    assert not rows[9]["may"] and not rows[10]["may"]


def test_no_more_words_are_split_off_than_needed(spark):
    pieces = [" ", "a", "b ", "\n", "\n\n", "\u3000", "cd", " e", "\r", "lid"]
    draw = random.Random(7)
    cases = ["", " ", " a b c", "a b c d"] + ["".join(draw.choice(pieces) for _ in range(draw.randrange(1, 30))) for _ in range(150)]
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    paras = texts.paragraphs(F.col("c"))
    again = texts.strip_artifacts(F.col("c"))
    rows = df.select(
        paras.alias("paras"), text.fit_words(paras, 4).alias("got"), F.size(texts.words(F.col("c"), 2)).alias("n"),
        texts.clean_paragraphs(again).alias("clean"), texts.paragraphs(again).alias("clean_want"),
    ).collect()
    for r in rows:
        want, room = [], 4
        for words in (p.split() for p in r["paras"]):
            if room and words:
                want.append(" ".join(words[:room]))
                room -= len(words[:room])
        assert r["got"] == "\n\n".join(want) and r["n"] <= 4 and r["clean"] == r["clean_want"]


def test_users_without_history_share_one_row(spark):
    schema = "user_id long, flags map<long,int>, overlaps map<int,double>, topic_weights map<int,double>, source_weights map<int,double>, seen_ids array<long>, cold_start boolean"
    rows = [(i, None, None, None, None, None, i % 2 == 0 or None) for i in range(10)]
    rows += [(10, {1: 1}, None, None, None, None, True), (11, None, None, None, None, [1], None)]
    asked = []

    def build(users):
        asked.extend(r[0] for r in users.select("user_id").collect())
        return users.select("user_id", F.coalesce("cold_start", F.lit(False)).alias("cold"), F.col("seen_ids").isNotNull().alias("seen"))

    got = user_feed.for_like_users(spark.createDataFrame(rows, schema), 250, build).collect()
    assert sorted(asked) == [0, 1, 10, 11]
    assert sorted(map(tuple, got)) == [(i, i % 2 == 0, i == 11) for i in range(12)]


def test_network_address_is_no_date(spark):
    texts = [("at 40.120.12.54 by", None), ("as 85.225.12.24 of", None), ("am 24.12.2023.", datetime(2023, 12, 23, 19)), ("(5/1/24) x", datetime(2024, 1, 4, 19)), ("v 1.2.24/7", None)]
    df = spark.createDataFrame([(i, f"<p>{t}</p>") for i, (t, _) in enumerate(texts)], "i int, html string")
    got = df.select("i", pages.publish_date(F.col("html"), F.lit("2024-01-31").cast("timestamp")).alias("at")).orderBy("i").collect()
    assert [r["at"] for r in got] == [at for _, at in texts]


def test_feature_index_reads_the_digits_that_decide(spark):
    words = ["tok:a", "bi:b:c", "tri:d:e:ü", ""]
    df = spark.createDataFrame([(w,) for w in words], "f string")
    for dim in (16, 64, 256, 4096, 100, 768):
        got = [r[0] for r in df.select(text.feature_index(F.col("f"), dim)).collect()]
        assert got == [int(sha256(w.encode()).hexdigest()[:16], 16) % dim for w in words]
    assert str(text.feature_index(F.col("f"), 256)).count("conv") == 1


def test_counts_of_clean_texts_equal_their_lists(spark):
    pieces = [" ", "  ", "\n", "\r", "\t", "\x85", "\u3000", "\x1c", "a", "Bc.", "d!", "; ", "lid", "Yangilik:", "NEWS :", "&amp;", "&lid;", "[+3 chars]", "Ã", "\xa0", "e?"]
    dealt = random.Random(3)
    odd = ["", " ", "\n \n", "a", " a. b; c\n\n d. ", "Lid: x\n\ny\nz", "li&amp;d", "la[+1 chars]lid\nnewsÃ:"]
    rows = odd + ["".join(dealt.choices(pieces, k=dealt.randrange(1, 25))) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in rows], "x string")

    def by_line(c):
        lines = F.transform(F.split(c, "\n"), lambda x: texts.strip(texts.collapse_space(x)))
        return F.array_join(F.filter(lines, lambda x: x != ""), "\n")

    flat = F.translate("x", "\r", "\n")
    df = df.select("x", by_line(flat).alias("lines"), texts.tidy_lines(flat).alias("tidy"), texts.strip_artifacts(F.col("x")).alias("clean"))
    got = df.select(
        "*", F.size(texts.paragraphs(F.col("clean"))).alias("p"), texts.paragraph_count(F.col("clean")).alias("pn"),
        *[F.size(texts.sentences(F.col(c), ".!?;")).alias(f"s_{c}") for c in ("x", "clean")],
        *[texts.sentence_count(F.col(c), ".!?;").alias(f"n_{c}") for c in ("x", "clean")],
    ).collect()
    for r in got:
        assert (r["lines"], r["p"], r["s_x"], r["s_clean"]) == (r["tidy"], r["pn"], r["n_x"], r["n_clean"]), r
    # texts without artifacts are not cleaned again
    assert [r[0] for r in spark.createDataFrame([("a b",), ("a lid",), ("news: a",), ("a&",)], "x string").select(texts.has_artifacts(F.col("x"))).collect()] == [False, True, True, True]


def test_fan_out_shuffles_no_row_per_user_and_label(spark, monkeypatch):
    users = spark.createDataFrame(
        [(1, '{"all_topics":["tech","sports"],"profession":"cook"}'), (2, '{"all_topics":["sports"]}'), (3, '{"all_topics":["none"]}')], "user_id long, interests string"
    ).selectExpr("*", "'Iran' AS location", "'IR' AS country_code", "user_id > 0 AS is_active")
    rows = [(1, "tech", 1.0), (2, "tech", 2.0), (3, "sports", 3.0), (4, "general|cook", 4.0), (5, "port", 5.0), (6, "chess||ran", 6.0), (3, "sports", 3.5), (None, "tech", 0.0)]
    articles = spark.createDataFrame(rows, "ai_news_id long, target_persona string, ai_score double")
    had = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 9), (1, None), (9, 1)], "user_id long, ai_news_id long")
    wanted = [(1, 1, 1), (1, 4, 1), (1, 5, 2), (1, 6, 3), (1, None, 1), (2, 5, 2), (2, 6, 3), (3, 6, 3)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (0, 1000):
            monkeypatch.setattr(personas, "COPIED_ROWS", most, raising=False)
            got = personas.feed_fanout(articles, users, had)
            found = [(r["user_id"], r["ai_news_id"], r["tier"]) for r in got.collect()]
            assert sorted(found, key=str) == sorted(wanted, key=str)
        dealt = [x for x in plan_of(got).splitlines() if "Exchange hashpartitioning(" in x]
        assert dealt and not [x for x in dealt if "tier" in x or "hashpartitioning(label_id" in x]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
