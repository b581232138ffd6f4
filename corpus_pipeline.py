"""Corpus pipeline: documents in, encoded documents out, each stage over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import bpe, catalog, minhash, mixing, pii, quality_classifier
from newsloom.llm.common import staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects; it learns from the labelled documents of the input."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs.select(*COLUMNS), model, score_col="_score").where("_score >= 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each class of near duplicates; rows without id stay."""
    copies = minhash.near_duplicates(docs).where("doc_id <> class_id").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; no document is dropped."""
    masked = pii.find(docs.select(*COLUMNS), pii.fit(docs), spans_col="_spans", mask=True)
    length = F.when(F.size("_spans") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", length).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents so that sources, languages and topics have their target weights."""
    return mixing.mix(docs.select(*COLUMNS), catalog.MIX, fraction=0.8, p_col="_p").select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text they decode to."""
    model = bpe.load_model(catalog.tokenizer_path())
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), model, decoded_col="decoded", plain=True)
    return coded.select("doc_id", "lang", "source", F.size("token_ids").cast("bigint").alias("n_tokens"), "token_ids", "decoded")


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding and decoding", encoding),
]

#: The stages' models and sketches have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each one's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"stage{k}")
    return docs
