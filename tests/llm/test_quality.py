import re

import numpy as np
from pyspark.sql import functions as F

from newsloom.llm import quality_classifier as qc
from newsloom.llm import quality_rules as qr


def _counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, twice = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for starts in seen.values():
        if len(starts) > 1:
            twice |= {i + k for i in starts for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(twice))


CASES = [None, "", " \t\n ", "one", "a b c a b c", "a a a a a", "x\n\nx\n x\nx", "é# ü* |", "a\x0bb\x0cc\rd", "a b c", "w " * 30_000, "same line\n" * 70]


def test_rule_counts_match_plain_loops(docs, small):
    rows = list(enumerate(CASES)) + [(1000 + r["doc_id"], r["text"]) for r in small.collect()]
    got = {r["doc_id"]: r for r in qr.quality_rules(docs(rows)).collect()}
    for i, text in rows:
        r, want = got[i], _counts(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, (i, text and text[:60])
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_rules_run_in_the_jvm_without_shuffle(docs):
    plan = qr.quality_rules(docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_rules_on_repeated_rows_null_ids_and_extra_columns(docs):
    df = docs([(1, "a b"), (1, "a b"), (None, "x")]).withColumn("kept", F.lit("mine"))
    assert qr.quality_rules(df).count() == 3
    assert qr.quality_rules(df.limit(0)).count() == 0


def test_pairs_separate_and_threshold_is_a_quantile():
    rng = np.random.default_rng(0)
    y = np.r_[np.ones(300, int), np.zeros(100, int)]
    x = rng.normal(size=(400, len(qc.FEATURES))) + y[:, None] * np.linspace(0, 3, len(qc.FEATURES))
    model = qc.fit_pairs(x, y)
    assert ((model.scores(x) >= 0.5) == y).mean() > 0.97
    assert abs((model.scores(x) < 0.5).mean() - 0.25) < 0.01


def test_held_out_accuracy(spark, small):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = qc.fit(big, labels)
    out = qc.score(big, model).join(labels, "doc_id").where(qc.held_out(F.col("doc_id")))
    right = out.select(((F.col("score") >= 0.5).cast("int") == F.col("quality")).cast("int").alias("x")).agg(F.avg("x")).first()[0]
    assert right >= 0.95


def test_classifier_edge_cases(spark, docs):
    rows = docs([(1, None), (2, ""), (3, "word " * 100_000), (3, "word " * 100_000), (None, "x")])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = qc.fit(rows, none)
    out = qc.score(rows, model).collect()
    assert len(out) == 5 and all(r["score"] == 0.5 for r in out)
    one = spark.createDataFrame([(2, 1, 0), (None, 0, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    assert qc.fit(rows, one).weights == (0.0,) * len(qc.FEATURES)
    assert qc.score(rows.limit(0), model).count() == 0
