import pyarrow as pa

import corpus_pipeline
from newsloom.llm import bpe, catalog, common, pii, quality_classifier
from newsloom.llm.catalog import QUERIES

SF = "/root/testdata/sf0.01"


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, SF).cache()
        ids = {r[0] for r in out.select("doc_id").collect()}
        before = {r[0] for r in kept.select("doc_id").collect()}
        assert ids <= before and len(ids) == out.count()
        if k < 4:
            assert tuple(out.columns) == corpus_pipeline.COLUMNS and out.dtypes == docs.dtypes
        if k == 1:
            classes = QUERIES["op1_minhash_classes"]
            assert len(ids) < len(before) and classes
        if k == 2:
            assert ids == before
        last, kept = kept, out
    texts = {r["doc_id"]: r["text"] for r in last.collect()}
    model = bpe.load_model(catalog.tokenizer_path())
    for r in kept.limit(50).collect():
        assert model.encode(texts[r["doc_id"]]).tolist() == list(r["token_ids"])
        machine = bpe.TextDecoder(model, plain=True)
        assert machine.feed(r["token_ids"]) + machine.finish() == r["decoded"]
    assert kept.count() == corpus_pipeline.run(spark, SF).count()


def test_stages_on_null_rows_and_empty_tables(spark, docs):
    odd = docs([(None, None), (None, ""), (1, None), (2, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")]).withColumn("_score", quality_classifier.F.lit(1))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0
        stage(spark, odd, SF).collect()
    assert corpus_pipeline.near_duplicates(spark, odd, SF).count() == 4


def test_a_worker_holds_one_operators_tables_and_few_rows(spark):
    batch = pa.RecordBatch.from_pydict({"x": list(range(1000))})
    seen = []

    def run(batches):
        for b in batches:
            seen.append(b.num_rows)
            yield b

    common.HELD.update(bpe="tables", other="more")
    try:
        rows = [x for b in common.in_worker(run, "bpe")(iter([batch, batch])) for x in b.column(0).to_pylist()]
        assert rows == 2 * list(range(1000)) and max(seen) <= common.ROWS_AT_ONCE
        assert common.HELD == {"bpe": "tables"}
        list(common.in_worker(run)(iter([batch])))
        assert not common.HELD
    finally:
        common.HELD.clear()


def test_the_stages_workers_are_left_small(spark):
    df = spark.createDataFrame([(i, "mail a@b.org or +44 20 7946 0958 about it") for i in range(600)], "doc_id long, text string")
    model = pii.SpanModel({}, (0.0,) * pii.FEATURES, -30.0)
    got = pii.find(df.coalesce(1), model, mask=True).collect()
    assert len(got) == 600 and {r["text"] for r in got} == {"mail [EMAIL] or [PHONE] about it"}
    held = spark.sparkContext.parallelize([0], 1).map(lambda _: len(common.HELD)).collect()
    assert held == [0]
