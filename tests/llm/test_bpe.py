import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsloom.llm import bpe
from newsloom.llm.catalog import tokenizer_path


@pytest.fixture(scope="module")
def model():
    return bpe.load_model(tokenizer_path())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def test_random_texts_encode_as_the_library(model, library):
    rng = random.Random(1)
    parts = ["a", "b", "th", "he", " ", "  ", "\n", "é", "é", "Σ", "ß", "İ", "1", "'s", "'", "!", "\x1c", "\x85", "<|endoftext|>", "<|", "🙂", "中", "​", "ing", "The", "ﬁ", " ", "ǅ"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert model.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_longer_than_the_window(model, library):
    rng = random.Random(2)
    long = "".join(rng.choice(["a", "b", "th", "he", "in", "pi", "ban", "inter"]) for _ in range(4000))
    for text in (long, "a" * 9000, "🙂" * 3000, "hahaha" * 1500, f"{long} x"):
        assert model.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_stream_in_parts_equals_whole(model):
    word = ("interban" * 900).encode()
    whole = list(model.stream((word,)))
    assert list(model.stream(word[i : i + 7] for i in range(0, len(word), 7))) == whole
    assert model.lookahead < model.window


def test_decoder_keeps_unfinished_characters(model):
    text = "naïve 🙂 中文 it's"
    machine = bpe.TextDecoder(model, plain=True)
    out = "".join(machine.feed([i]) for i in model.encode(text).tolist()) + machine.finish()
    assert out.replace(" ", "") == text.replace(" ", "")


def test_table_cases(spark, docs, model, library):
    texts = [None, "", " \n", "Plain text.", "Plain text.", "word " * 60_000]
    df = docs(list(enumerate(texts))).withColumn("n_tokens_", F.lit(1))
    out = bpe.decode(bpe.encode(df, model), model)
    rows = {r["doc_id"]: r for r in out.collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert list(rows[i]["token_ids"]) == want
        assert rows[i]["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(df.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(df.withColumn("token_ids", F.lit(1)), model)


def test_merge_list_must_be_proper(model):
    bad = '{"model": {"type": "BPE", "end_of_word_suffix": "</w>", "vocab": %s, "merges": [["xq", "zz"]]}, "added_tokens": [], "pre_tokenizer": {"pretokenizers": [{"type": "Split", "pattern": {"Regex": "a"}}]}}'
    import json

    vocab = {c: i for i, c in enumerate(bpe.byte_letters())} | {c + "</w>": 256 + i for i, c in enumerate(bpe.byte_letters())}
    vocab |= {"xq": 600, "zz": 601, "xqzz": 602}
    with pytest.raises(ValueError):
        bpe.WordBpe(bad % json.dumps(vocab))


def test_encode_decodes_in_the_same_pass(spark, docs, model):
    texts = [None, "", "naïve 🙂 It's 9 % <|endoftext|>", "x" * 3000, "Wörter, wörter."]
    df = docs(list(enumerate(texts)))
    for plain in (False, True):
        want = bpe.decode(bpe.encode(df, model), model, plain=plain).orderBy("doc_id").collect()
        got = bpe.encode(df, model, decoded_col="decoded", plain=plain).orderBy("doc_id").collect()
        assert got == want
    assert got[2]["decoded"].split() == "naïve 🙂 it 's 9 % <|endoftext|>".split()
    with pytest.raises(ValueError):
        bpe.encode(df, model, decoded_col="text")


def test_plain_decoder_marks_bytes_without_a_character(model):
    machine = bpe.TextDecoder(model, plain=True)
    smile = "🙂".encode()
    ids = [*(model.inner[b] for b in smile[:2]), model.special["<|endoftext|>"], *(model.inner[b] for b in smile[:3]), model.final[smile[3]], model.inner[smile[0]]]
    assert "".join(machine.feed([i]) for i in ids) + machine.finish() == "�<|endoftext|>🙂 �"
    assert machine.feed(ids) + machine.finish() == "�<|endoftext|>🙂 �"


def test_word_table_stays_bounded(model, library):
    small = bpe.WordBpe(model.spec, cache_words=50)
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abcdé.", k=rng.randint(1, 6))) for _ in range(40)) + " " + "z" * 60 for _ in range(30)]
    for text in texts:
        assert small.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
        assert all(len(w) <= bpe.SHORT for w in small.known)
    assert len(small.known) <= 50 + 3 * 41
