"""Literal cases of the published behaviour."""

import html as stdlib_html
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsloom.functions import images as I
from newsloom.functions import texts as X
from newsloom.functions import urls as U
from newsloom.operators import images, matching, pages, personas, text


def one(spark, rows, schema, **cols):
    df = spark.createDataFrame(rows, schema)
    return [r.asDict() for r in df.select(*[c.alias(n) for n, c in cols.items()]).collect()]


def vectors(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    out = {}
    for r in text.hash_embedding(df, "id", "text").collect():
        out.setdefault(r.id, {})[r.idx] = r.weight
    return out


def test_vector_is_repeatable_and_not_zero(spark):
    v = vectors(spark, ["Uzbek tech market grows quickly"] * 2)
    assert v[0] == v[1] and v[0]
    assert sum(w * w for w in v[0].values()) == pytest.approx(1, abs=1e-6)


def test_related_texts_are_closer(spark):
    v = vectors(spark, ["football match result sports league", "sports league football season", "central bank policy rate"])

    def dot(a, b):
        return sum(w * v[b].get(i, 0) for i, w in v[a].items())

    assert dot(0, 1) > dot(0, 2)


@pytest.mark.parametrize(
    "interests, topics",
    [
        ('{"topics": ["Technology"], "custom_topics": ["Uzbek Esports"], "all_topics": ["technology", "uzbek esports"]}', ["technology", "uzbek esports"]),
        ('{"custom_topics": ["Team Spirit", "Formula 1"]}', ["team spirit", "formula 1"]),
        ('{"all_topics": ["technology", "cs", "dota"]}', ["technology", "cs", "dota"]),
        ('{"music": true, "art": false}', ["music"]),
        (None, []),
    ],
)
def test_user_topics(spark, interests, topics):
    [row] = one(spark, [(interests,)], "i string", t=personas.user_topics(F.col("i")))
    assert (row["t"] or []) == topics


def test_topic_aliases(spark):
    docs = spark.createDataFrame([(1, "counter-strike finals tonight"), (2, "bank policy"), (3, "the cs scene")], "id long, hay string")
    topics = spark.createDataFrame([("cs",), ("dota",)], "topic string")
    variants = matching.topic_variants(topics, matching.alias_table(spark))
    got = {tuple(r) for r in matching.match_articles_topics(docs, variants, "id", "hay").collect()}
    # "cs" stands for its aliases only
    assert got == {(1, "cs")}


def test_short_variants_stand_alone(spark):
    docs = spark.createDataFrame([(1, "the ai wave"), (2, "rain again"), (3, "c++ and ai.")], "id long, hay string")
    variants = spark.createDataFrame([("ai", "ai"), ("c++", "c++")], "topic string, variant string")
    got = {tuple(r) for r in matching.match_articles_topics(docs, variants, "id", "hay").collect()}
    assert got == {(1, "ai"), (3, "ai"), (3, "c++")}


def test_expand_topics(spark):
    users = spark.createDataFrame([(1, ["CS", "tech "]), (2, ["general"]), (3, ["ai"])], "user_id long, topics array<string>")
    got = {r.user_id: list(r.queries) for r in matching.expand_topics(users, matching.alias_table(spark)).collect()}
    assert got[1] == ["counter-strike", "counter strike", "counter-strike 2", "cs2", "esports", "tech"]
    assert got[2] == ["general news"]
    assert got[3] == ["ai"]


def test_unique_images_ignore_tracking_and_reserved(spark):
    rows = [(1, 0, "https://x.com/a.jpg?utm_source=f"), (1, 1, "https://x.com/b.jpg?utm_medium=1"), (1, 2, "https://x.com/c.webp")]
    imgs = spark.createDataFrame(rows, "ai_news_id long, pos long, url string")
    reserved = spark.createDataFrame([("x.com/a.jpg",)], "canonical_key string")
    got = images.unique_images_across_posts(imgs, reserved, 2).collect()
    assert len(got) == 2 and all("a.jpg" not in r.url for r in got)
    assert len({r.canonical_key for r in got}) == 2


def as_of():
    return F.lit("2026-04-19 09:00:00").cast("timestamp")



@pytest.mark.parametrize(
    "html, expected",
    [
        ('<script type="application/ld+json">{"datePublished":"2026-04-19T12:34:00+05:00"}</script>', "2026-04-19 07:34:00"),
        ('<meta property="article:published_time" content="2026-04-19T10:00:00+05:00">', "2026-04-19 05:00:00"),
        ('<time datetime="2026-04-19T08:00:00+05:00">x</time>', "2026-04-19 03:00:00"),
        ("<p>сегодня 12:30</p>", "2026-04-19 07:30:00"),
        ("<p>2 soat oldin</p>", "2026-04-19 07:00:00"),
        ("<p>kecha</p>", "2026-04-17 19:00:00"),
        ('<div class="date">18.04.2026</div>', "2026-04-17 19:00:00"),
        ("<p>nothing</p>", None),
    ],
)
def test_publish_date(spark, html, expected):
    [row] = one(spark, [(html,)], "h string", d=pages.publish_date(F.col("h"), as_of()).cast("string"))
    assert row["d"] == expected


def test_page_links_keep_same_site_articles(spark):
    html = '<a href="/a1">1</a><a href="https://other.com/x">2</a><a href="/tag/test">3</a><a href="/a1#top">4</a>'
    df = spark.createDataFrame([(1, "https://site.com/news/", html)], "page_id long, url string, html string")
    assert [r.link for r in pages.page_links(df).collect()] == ["https://site.com/a1"]


def test_published_on_day(spark):
    rows = [(datetime(2026, 4, 19, 9),), (datetime(2026, 4, 18, 9),), (datetime(2026, 4, 18, 19, 0, 0),)]
    df = spark.createDataFrame(rows, "created_at timestamp")
    assert pages.published_on_day(df, as_of()).count() == 2


def test_article_url_rules(spark):
    cases = {
        "https://kun.uz/news/2026/04/19/x": True, "https://kun.uz/news/list": False, "https://kun.uz/ru/about": False,
        "https://a.com/category/x/": False, "https://a.com/a/b/some-slug": True, "https://a.com/x.html": True, "https://a.com/": False,
    }
    got = one(spark, [(u,) for u in cases], "u string", u=F.col("u"), f=pages.article_url_flag(F.col("u")))
    assert {r["u"]: r["f"] for r in got} == cases


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("HTTPS://Site.com/a/?utm_source=x&b=2#f", "https://site.com/a?b=2"),
        ("https://site.com/?q=a b&gclid=1", "https://site.com/?q=a+b"),
        ("https://site.com", "https://site.com"),
        ("site.com/x", "http:site.com/x"),
        ("", None),
    ],
)
def test_normalize_source_url(spark, raw, expected):
    [row] = one(spark, [(raw,)], "u string", n=U.normalize_source_url(F.col("u")))
    assert row["n"] == expected


def test_character_references(spark):
    cases = ["a &amp; b", "&lt;b&gt;", "&#39;x&#x27;", "&eacute;t&eacute;", "AT&T", "&nbsp;.", "&copy 2024", "&unknown; &", "&#0; &#55296;", "no refs"]
    got = one(spark, [(c,) for c in cases], "c string", u=X.unescape_html(F.col("c")))
    assert [r["u"] for r in got] == [stdlib_html.unescape(c) for c in cases]


def test_headlines(spark):
    rows = [("News: Rate cut", "", ""), ("[AI] Long road - ", "", ""), ("", "", ""), ("Top story", "Team Spirit won the World Cup final", ""), ("x" * 200, "", "")]
    got = one(spark, rows, "t string, f string, s string", h=text.ensured_title(F.col("t"), F.col("f"), F.col("s")))
    assert [r["h"] for r in got] == ["Rate cut", "Long road", "Top story", "Team Spirit wins the World Cup", "x" * 157 + "..."]


def test_image_rules(spark):
    rows = [("https://a.com/img/p_1600x900.jpg",), ("https://a.com/logo.jpg",), ("https://a.com/p.svg",), ("https://a.com/p.jpg?w=100",)]
    got = one(spark, rows, "u string", n=I.news_photo(F.col("u")), c=I.candidate_ok(F.col("u")))
    assert [(r["n"], r["c"]) for r in got] == [(True, True), (False, True), (False, False), (False, False)]


def test_boilerplate_legal_block(spark):
    body = "Real sentence number one is long enough to stay here. " * 8
    rows = [("Matn. Guvohnoma raqami yozilgan. " + body,), (body + "O'zmaa tomonidan.",)]
    got = one(spark, rows, "t string", c=pages.clean_boilerplate(F.col("t")))
    assert got[0]["c"] == body.strip() and got[1]["c"] == body.strip()


def test_comment_tree_ends_on_self_parents_and_cycles(spark):
    from newsloom.operators import profiles

    at = datetime(2024, 1, 1)
    # 1 replies to itself; 2, 3, 4 reply in a circle, 5 below it; 6 and 7 are a thread
    rows = [(1, 1), (2, 3), (3, 4), (4, 2), (5, 2), (6, None), (7, 6), (8, 99)]
    df = spark.createDataFrame(
        [(i, 10, 1, p, at, f"text {i}") for i, p in rows],
        "comment_id long, ai_news_id long, user_id long, parent_comment_id long, created_at timestamp, content string",
    )
    got = {r["comment_id"]: r for r in profiles.comment_tree(df).collect()}
    assert len(got) == 8 and all(got[i]["depth"] == 0 and got[i]["root_id"] == i and got[i]["parent_id"] is None for i in (1, 2, 3, 4, 5, 6, 8))
    assert (got[7]["depth"], got[7]["path"], got[7]["content"]) == (1, "6/7", "text 7")


def test_streams_over_folder_tables_in_several_batches(spark, tmp_path):
    from newsloom.streaming import jobs
    from newsloom.streaming.sinks import drain, file_stream

    events = spark.createDataFrame(
        [(i, i % 5, i % 3, "view", datetime(2024, 1, 1, (i * 7) % 24), i) for i in range(120)],
        "event_id long, user_id long, ai_news_id long, event_type string, created_at timestamp, position int",
    )
    # part files out of time order
    events.repartition(4, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    late = []
    stream = file_stream(spark, str(tmp_path), "events", events.schema, files_per_batch=1)
    out = drain(jobs.stream_activity(stream, "1 hour"), "update", ["window_start", "window_end", "event_type"], late)
    assert late == [0] and out.agg(F.sum("n")).first()[0] == 120 and out.count() == 24
    short = file_stream(spark, str(tmp_path), "events", events.schema, files_per_batch=1)
    drain(jobs.stream_activity(short, "1 hour", lateness="1 second"), "update", ["window_start", "window_end", "event_type"], late)
    assert late[1] > 0
    with pytest.raises(ValueError):
        again = file_stream(spark, str(tmp_path), "events", events.schema, files_per_batch=1)
        drain(jobs.stream_activity(again, "1 hour", lateness="1 second"), "update", ["window_start", "window_end", "event_type"])


def test_date_element_among_other_classes(spark):
    html = '<html><body><p class="news date big">2024-01-05 10:00</p></body></html>'
    as_of = F.lit("2024-01-31 12:00:00").cast("timestamp")
    assert one(spark, [(html,)], "h string", d=pages.publish_date(F.col("h"), as_of))[0]["d"] is not None


def test_page_body_without_long_paragraphs(spark):
    from newsloom.functions import html as page

    long = "Only div elements hold this article's text, " * 3
    cases = [
        (f"<body><div>menu</div><DIV class='a'>{long}<div>inner</div> end</DIV><div>foot</div></body>", f"{long}inner end"),
        ("<section>short</section><article>a longer text<br>here", "a longer text here"),
        ("<p>one</p><p></p><p>two</p>", "one\n\ntwo"),
        (f"<div>{'x' * 400}<p>{'y' * 51}</p></div>", "y" * 51),
        (f"</div><script><div>{'x' * 99}</div></script><div>seen</div>", "seen"),
        (None, ""),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, html string")
    got = {r["i"]: r["body"] for r in df.select("i", page.page_body(page.F.col("html")).alias("body")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_page_body_takes_time_in_proportion(spark):
    import time

    from newsloom.functions import html as page

    def seconds(blocks):
        text = "".join(f"<div>block {i} <b>x</b></div>" for i in range(blocks)) + "<div>" + "the largest one " * 9 + "</div>"
        df = spark.createDataFrame([(text,)], "html string")
        begun = time.perf_counter()
        (row,) = df.select(page.page_body(page.F.col("html")).alias("body")).collect()
        assert row["body"] == ("the largest one " * 9).strip()
        return time.perf_counter() - begun

    seconds(100)
    assert seconds(32_000) < 12 * seconds(8_000) + 1


def test_site_selectors(spark):
    from newsloom.functions import html as page

    cases = [
        ("h1.article__title", "<h1>a</h1><h1 class='big article__title'>b<br>c</h1>", "b c"),
        (".content", "<div class='content-x'>a</div><section id=x class=\"content\"><section>b</section> c</section>d", "b c"),
        (".content", "<div class='content'><DIV>b</DIV><divider>c</divider>", "b c"),
        ("div[itemprop=articleBody]", "<p itemprop='articleBody'>a</p><div itemprop=articleBody>b</div>", "b"),
        ("article", "<articles>a</articles><article>b</article>", "b"),
        ("article", "<div>a</div>", None),
        (".content", None, None),
    ]
    for selector, html, want in cases:
        df = spark.createDataFrame([(html,)], "html string")
        (row,) = df.select(page.inner_text(page.element(page.F.col("html"), page.F.lit(page.open_tag(selector)))).alias("text")).collect()
        assert row["text"] == want, selector


def test_first_large_image(spark):
    from newsloom.functions import html as page

    cases = [
        ("<img src='/a/logo.png'><img src='small.jpg'><img width='100' src='/b.jpg'><img data-src='c.webp?x=1'>", "https://h.org/n/c.webp"),
        ("<img src='/x.jpg'><img srcset='/img/1.jpg 300w, /img/2.jpg 900w'>", "https://h.org/img/2.jpg"),
        ("<img width=90 src='/only.jpg'>", "https://h.org/only.jpg"),
        ("<img src='data:image/png;base64,xx'><img src='/page'>", None),
        ("<p>none</p>", None),
        (None, None),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, html string")
    got = {r["i"]: r["u"] for r in df.select("i", page.large_image(page.F.col("html"), page.F.lit("https://h.org/n/p.html")).alias("u")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


@pytest.mark.parametrize("compiled", [True, False])
def test_substring_matches_equal_plain_search(spark, monkeypatch, compiled):
    rng = random.Random(4)
    letters = "abc+.é日 "
    terms = sorted({"".join(rng.choices(letters, k=rng.randrange(1, 5))) for _ in range(60)} | {"a", "ab", "abc", "a|b", "^", "[c]", "\\d"})
    texts = [(i, "".join(rng.choices(letters, k=rng.randrange(0, 30)))) for i in range(80)] + [(99, None), (100, "x^[c]\\d a|b")]
    if not compiled:
        monkeypatch.setattr(matching, "MAX_COMPILED_TERMS", 3)
    df = spark.createDataFrame(texts, "id int, hay string")
    listed = spark.createDataFrame([(t,) for t in [*terms, "", None, "a"]], "term string")
    got = [tuple(r) for r in matching.substring_matches(df, "id", "hay", listed, "term", (1, 2, 3)).collect()]
    assert sorted(got) == sorted((i, t) for i, x in texts if x is not None for t in terms if t in x)
    assert matching.substring_matches(df, "id", "hay", listed.limit(0), "term").count() == 0


def test_fanout_falls_back_by_label(spark):
    users = spark.createDataFrame(
        [
            (1, True, '{"all_topics":["tech"],"profession":"Builder"}', "Paris, France", "fr"),
            (2, True, '{"topics":["chess club"]}', "Berlin", "de"),
            (3, True, '{"all_topics":["tech"],"profession":"builder"}', "Paris, France", "FR"),
            (4, False, '{"all_topics":["tech"]}', "Paris", "fr"),
            (5, True, None, None, None),
        ],
        "user_id long, is_active boolean, interests string, location string, country_code string",
    )
    labels = ["tech", "general", "chess", "opera|builder", "opera", "tech||paris|fr", "tech|builder|rome", "|builder|", None, "opera|nobody|berlin"]
    articles = spark.createDataFrame([(i, 1.0, p) for i, p in enumerate(labels)], "ai_news_id long, ai_score double, target_persona string")
    seen = spark.createDataFrame([(1, 0), (9, 9)], "user_id long, ai_news_id long")
    got = {}
    for r in personas.feed_fanout(articles, users, seen).collect():
        got.setdefault(r["ai_news_id"], []).append((r["user_id"], r["tier"]))
    assert {k: sorted(v) for k, v in got.items()} == {
        0: [(3, 1)], 1: [(u, 1) for u in (1, 2, 3, 5)], 2: [(2, 2)], 3: [(1, 3), (3, 3)], 5: [(1, 1), (3, 1)], 6: [(1, 3), (3, 3)],
        7: [(1, 2), (3, 2)], 8: [(u, 1) for u in (1, 2, 3, 5)], 9: [(2, 3)],
    }


def test_late_rows_are_counted_beyond_the_kept_progress(spark, tmp_path):
    from newsloom.streaming import jobs
    from newsloom.streaming.sinks import drain, file_stream

    schema = "event_id long, event_type string, created_at timestamp"
    # the first file sets the watermark, which holds for late rows from the third batch on
    for k in range(6):
        rows = [(k, "view", datetime(2024, 1, 20 + k)), (100 + k, "view", datetime(2024, 1, 1))]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "1")
    try:
        late = []
        stream = file_stream(spark, str(tmp_path), "events", spark.createDataFrame([], schema).schema, files_per_batch=1)
        out = drain(jobs.stream_activity(stream, "1 hour"), "update", ["window_start", "window_end", "event_type"], late)
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert late == [4] and out.agg(F.sum("n")).first()[0] == 8


def test_in_parts_keeps_rows_in_order(spark, tmp_path):
    from newsloom.streaming.sinks import in_parts

    df = spark.createDataFrame([(i % 50 if i % 10 else None, i) for i in range(200)], "at int, n int").repartition(2)
    assert in_parts(df, "at", 4, str(tmp_path), "t") == 2
    back = spark.read.parquet(f"{tmp_path}/t.parquet")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    by_file = back.groupBy(F.col("_metadata.file_modification_time").alias("t")).agg(F.min("at").alias("a"), F.max("at").alias("b")).orderBy("t", "a").collect()
    assert all(x["b"] <= y["b"] for x, y in zip(by_file, by_file[1:]))


def test_ingest_sink_looks_up_the_days_around(spark, tmp_path):
    from newsloom.streaming import jobs

    schema = "raw_news_id long, source_url string, title string, raw_text string, published_at timestamp"
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp")

    def batch(*rows):
        return spark.createDataFrame([(i, u, t, "text", d and datetime(2024, 1, d)) for i, u, t, d in rows], schema)

    save = jobs.ingest_sink(str(tmp_path), "raw_news_id", as_of)
    second = batch((4, "https://a/1", "again", 30), (5, "https://a/3", "c", 31), (6, "https://a/3", "c", 31), (7, "https://a/old", "o", 31), (8, "https://a/4", "d", None))
    save(batch((2, "https://a/2", "b", 30), (1, "https://a/1", "a", 30), (3, None, "no", 30), (9, "https://a/old", "o", 10)), 0)
    save(second, 1)

    def stored():
        return sorted((r["raw_news_id"], r["batch"]) for r in spark.read.parquet(f"{tmp_path}/rows").collect())

    # within the days around, once; stored three weeks before, again
    assert stored() == [(1, 0), (2, 0), (5, 1), (7, 1), (8, 1), (9, 0)]
    save(second, 1)
    save(batch(), 2)
    save(batch((10, "https://a/4", "d", 31)), 3)
    assert stored() == [(1, 0), (2, 0), (5, 1), (7, 1), (8, 1), (9, 0)]


@pytest.mark.parametrize(
    "text, day",
    [
        ("12 April 2026", (2026, 4, 12)),
        ("Apr 5, 2026", (2026, 4, 5)),
        ("posted on March 3rd, 2025 by us", (2025, 3, 3)),
        ("the 1st of May 2024", (2024, 5, 1)),
        ("7 сентября 2023 г.", (2023, 9, 7)),
        ("3-noyabr 2024", (2024, 11, 3)),
        ("Sept. 9 2021", (2021, 9, 9)),
        ("31 February 2024", None),
        ("marched 5 2024 times", None),
        ("may be 12 of 2000", None),
        ("chapter 12 April", None),
        ("no date at all", None),
    ],
)
def test_dates_with_month_names(spark, text, day):
    as_of = F.lit("2024-01-31 12:00:00").cast("timestamp")
    [row] = one(spark, [(f"<p>{text}</p>",)], "h string", d=pages.publish_date(F.col("h"), as_of, zone="UTC"))
    assert row["d"] == (day and datetime(*day))
