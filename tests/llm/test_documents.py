import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import bpe, catalog, minhash, mixing, pii, recompression, training_order
from newsloom.llm.common import shared_path

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _words(rng, n, pool=500):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


# near duplicates


def _bag(text):
    w = WORDS.findall(text or "")
    size = min(5, len(w))
    bag = {}
    for i in range(len(w) - size + 1 if size else 0):
        key = tuple(w[i : i + size])
        bag[key] = bag.get(key, 0) + 1
    return bag


def _classes(rows):
    bags = [(i, _bag(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(bags):
        for j, b in bags[:k]:
            shared = sum(min(n, b.get(s, 0)) for s, n in a.items())
            whole = sum(a.values()) + sum(b.values()) - shared
            if whole and shared / whole >= 0.8:
                low, high = sorted((top(i), top(j)))
                up[high] = low
    return {i: top(i) for i, _ in rows}


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    hits = truth = 0.0
    for _ in range(80):
        base = rng.integers(0, 2**63, 120).astype(np.uint64)
        a = np.repeat(base, rng.integers(1, 6, 120))
        b = np.r_[np.repeat(base[:90], rng.integers(1, 6, 90)), rng.integers(0, 2**63, 30).astype(np.uint64)]
        s = minhash.signatures([a, b])
        hits += (s[0] == s[1]).mean()
        truth += minhash.overlap(a, b)
    assert abs(hits - truth) / 80 < 0.02


def test_classes_equal_brute_force(docs):
    rng = random.Random(7)
    rows = []
    # groups around a common text; members drift from it and from each other, so that links form chains
    for g in range(6):
        base = _words(rng, rng.choice([30, 80, 200]))
        for m in range(14):
            text = list(base)
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            if m % 5 == 4:
                base = text
            rows.append((len(rows), " ".join(text)))
    line = " ".join(_words(rng, 25))
    rows += [(len(rows) + k, line + "\n" + " ".join(_words(rng, 15, 10**6))) for k in range(40)]
    rows += [(200 + k, t) for k, t in enumerate([None, "", " ", "a", "a", "a b c d", "a b c d e", "a  b\nc d e", "z " * 400, "z " * 420, "z " * 900])]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs(rows)).collect()}
    assert got == _classes(rows)


def test_classes_of_odd_tables(docs):
    df = docs([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")]).withColumn("class", F.lit("mine"))
    assert {tuple(r) for r in minhash.near_duplicates(df).collect()} == {(5, 2), (2, 2)}
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7)], "a bigint, b bigint")
    got = {r["id"]: r["class"] for r in minhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# repeated passages


def _without(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = WORDS.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            key = tuple(w[p : p + 20])
            if key in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(key)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def test_repeats_equal_brute_force(docs):
    rng = random.Random(9)
    passages = [_words(rng, n) for n in (19, 20, 21, 40, 100)] + [["r"] * 50, ["p", "q"] * 30, list("abcabcabc") * 8]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(0, 5)):
            text += _words(rng, rng.randrange(0, 30))
            p = rng.choice(passages)
            a = rng.randrange(0, 3)
            text += p[a:]
        rows.append((i * 3, " ".join(text)))
    rows += [(900, rows[5][1]), (901, rows[5][1].replace(" ", "\n")), (902, None), (903, ""), (904, "q " * 30_000), (905, "q " * 25)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in recompression.without_repeats(docs(rows)).collect()}
    want = {i: x for i, x in _without(rows).items() if x[1]}
    assert got == want


def test_word_lines_and_digests_of_long_and_odd_texts():
    rng = random.Random(4)
    gaps = [" ", "\n", "\t", "\x0b", "\r\n", "  "]
    words = [rng.choice(["a", "é\xa0b", "\x1cx", "\u2028", "w" * 300]) + str(rng.randrange(50)) for _ in range(20_000)]
    text = "\n " + "".join(w + rng.choice(gaps) for w in words)
    line = recompression.word_line(text)
    assert line.decode().split(" ") == words == WORDS.findall(text)
    codes = recompression.word_codes(text)
    assert len(codes) == len(words) and len(set(zip(codes.tolist(), words))) == len(set(words)) == len(set(codes.tolist()))
    at = np.array([0, 7, 19_980])
    digests = recompression.window_digests(line, at, 20)
    other = recompression.window_digests(" ".join(words[7:27]).encode(), np.array([0]), 20)
    assert (digests[1] == other[0]).all() and (digests[0] != other[0]).any()
    gone = np.array([rng.random() < 0.5 for _ in words])
    assert recompression.without_words(line, gone) == " ".join(w for w, g in zip(words, gone) if not g)
    assert recompression.without_words(b"a b", np.array([True, True])) == ""
    assert recompression.word_line(" \n") == b"" and len(recompression.word_codes("")) == 0


def test_repeats_of_odd_tables(docs):
    text = " ".join(map(str, range(30)))
    df = docs([(1, text), (1, text), (None, text), (4, text)]).withColumn("id", F.lit(9)).withColumn("words", F.lit("mine"))
    assert {(r["doc_id"], r["n_removed"]) for r in recompression.without_repeats(df).collect()} == {(4, 30)}
    assert recompression.without_repeats(df.limit(0)).count() == 0


def test_symbols_in_a_window_do_not_depend_on_its_surroundings():
    rng = np.random.default_rng(3)
    for _ in range(40):
        w = rng.integers(0, 4, 60).astype(np.uint64)
        found = []
        for _ in range(2):
            codes = np.r_[np.zeros(1, np.uint64), rng.integers(0, 4, 30).astype(np.uint64), w, rng.integers(0, 4, 30).astype(np.uint64), np.zeros(1, np.uint64)]
            gaps = np.zeros(len(codes), bool)
            gaps[[0, -1]] = True
            name, first, end = recompression.symbols(codes, gaps, 3)
            sure = (first >= 31) & (end <= 91)
            found.append(list(zip(name[sure].tolist(), first[sure].tolist(), end[sure].tolist())))
        assert found[0] == found[1] and found[0]


# personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _base(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_base_spans_equal_the_patterns(small):
    rng = random.Random(3)
    parts = ["1", "23", "4", "0", "255", "256", ".", ".", "@", "a", "b.c", "+", " ", "-", "(", ")", "%", "4111111111111111", "é", "a@b.co"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(8000)]
    for t in texts + [r["text"] for r in small.collect()]:
        assert pii.base_spans(t) == _base(t), t[:200]


def test_scans_stay_linear():
    model = pii.SpanModel({}, (1.0,) * pii.FEATURES, 0.0)
    for t in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1 " + " " * 200_000, "a1-" * 80_000):
        pii.all_spans(t, model)


def test_secrets_are_found_without_labels(spark, docs):
    rng = random.Random(2)
    texts = []
    for k in range(300):
        words = _words(rng, 40, 50)
        words = [w[1:] if len(w) < 4 else "word" for w in words]
        if k % 3 == 0:
            words.insert(20, f'token = "{hashlib.sha1(str(k).encode()).hexdigest()}"')
        if k % 3 == 1:
            words.insert(20, "version 202406")
        texts.append((k, " ".join(words)))
    df = docs(texts + [(900, None), (901, ""), (901, ""), (None, "mail a@b.example and 10.0.0.1")]).withColumn("kind", F.lit("mine"))
    model = pii.fit(df)
    rows = pii.find(df, model, mask=True).collect()
    found = {r["doc_id"]: [s["kind"] for s in r["pii_spans"]] for r in rows}
    # one of the hashes holds a run of digits that is a base card as well
    added = {r["doc_id"]: [s["kind"] for s in r["pii_spans"] if not s["base"]] for r in rows}
    assert all(added[k] == (["secret"] if k % 3 == 0 else []) for k in range(300))
    assert found[None] == ["email", "ip"] and found[900] == found[901] == [] and len(rows) == len(texts) + 4
    masked = next(r["text"] for r in rows if r["doc_id"] is None)
    assert masked == "mail [EMAIL] and [IP]"
    assert pii.find(df.limit(0), pii.fit(df.limit(0))).count() == 0


# mixing


def test_raking_equals_plain_loops(spark):
    rng = random.Random(1)
    cells = {(f"s{i}", l, t): rng.randrange(1, 1000) for i in range(6) for l in ("en", "de") for t in "xyz" if rng.random() < 0.9}
    margins = (mixing.Margin("source", power=0.5), mixing.Margin("lang", {"en": 0.7}), mixing.Margin("topic", {"x": 2.0, "y": 1.0, "z": 1.0}))
    df = spark.createDataFrame([(*k, n) for k, n in cells.items()], "m0 string, m1 string, m2 string, tokens bigint")
    got = {(r["m0"], r["m1"], r["m2"]): r["raked"] for r in mixing.rake(df, margins, rounds=6, tolerance=1e-4).collect()}
    total = sum(cells.values())
    sources = {}
    for k, n in cells.items():
        sources[k[0]] = sources.get(k[0], 0) + n
    root = {s: n**0.5 for s, n in sources.items()}
    targets = [{s: x / sum(root.values()) * total for s, x in root.items()}, {"en": 0.7 * total, "de": 0.3 * total}, {"x": 0.5 * total, "y": 0.25 * total, "z": 0.25 * total}]
    want = {k: float(n) for k, n in cells.items()}
    for _ in range(200):
        for i, target in enumerate(targets):
            now = {}
            for k, x in want.items():
                now[k[i]] = now.get(k[i], 0) + x
            want = {k: x * target[k[i]] / now[k[i]] for k, x in want.items()}
    assert all(abs(got[k] - want[k]) < 2e-3 * want[k] for k in cells)


def test_sample_meets_budget_and_margins(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.mix(df, catalog.MIX, fraction=0.5).cache()
    tokens = F.sum(mixing.token_count(F.col("text")))
    share = out.agg(tokens).first()[0] / df.agg(tokens).first()[0]
    assert 0.42 < share < 0.58 and out.select(F.max("sampling_p")).first()[0] <= 1
    assert set(out.columns) == {*df.columns, "sampling_p"}
    again = mixing.mix(df.repartition(7), catalog.MIX, fraction=0.5)
    assert {r[0] for r in again.select("doc_id").collect()} == {r[0] for r in out.select("doc_id").collect()}


def test_unlisted_and_null_languages_have_a_share(spark):
    langs = ["en"] * 50 + ["de"] * 20 + ["fr"] * 15 + ["es"] * 15 + ["it"] * 10 + [None] * 10
    rows = [(i, " ".join(["word"] * 10), lang, "s") for i, lang in enumerate(langs * 20)]
    whole = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    for df in (whole, whole.where("lang is null or lang <> 'es'")):
        out = mixing.mix(df, catalog.MIX, fraction=0.5)
        n = df.count()
        share = {r["lang"]: r["n"] / n for r in out.groupBy("lang").agg(F.sum(F.lit(1)).alias("n")).collect()}
        own = 200 / n
        assert abs(share["it"] - own / 2) < 0.03 and abs(share[None] - own / 2) < 0.03
        assert all(share[x] > 0 for x in ("en", "de", "fr"))
        assert out.select(F.min("sampling_p")).first()[0] > 0.4


def _margin_shares(df, margins, fraction):
    topic = mixing.lexical_topic(F.col("text"))
    names = [F.coalesce(topic if m.column == "topic" else F.col(m.column), F.lit("")).alias(f"m{i}") for i, m in enumerate(margins)]
    cells = df.select(mixing.token_count(F.col("text")).alias("tokens"), *names).groupBy("m0", "m1", "m2").agg(F.sum("tokens").alias("tokens"))
    return {(r["m0"], r["m1"], r["m2"]): (r["tokens"], r["raked"]) for r in mixing.rake(cells, margins, fraction=fraction).collect()}


@pytest.mark.parametrize("fraction", [0.5, 0.8])
def test_margins_hold_under_the_bound(spark, fraction):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    with pytest.warns(UserWarning, match="exceed the tokens at hand.*topic ''"):
        cells = _margin_shares(df, catalog.MIX, fraction)
    assert all(0 < x <= t * (1 + 1e-9) for t, x in cells.values())
    budget = fraction * sum(t for t, _ in cells.values())
    assert abs(sum(x for _, x in cells.values()) - budget) < 1e-3 * budget
    for i, m in enumerate(catalog.MIX):
        own, got = {}, {}
        for k, (t, x) in cells.items():
            own[k[i]], got[k[i]] = own.get(k[i], 0) + t, got.get(k[i], 0) + x
        share = m.weights or {v: t**0.5 for v, t in own.items()}
        full = set()
        while True:
            level = (budget - sum(own[v] for v in full)) / sum(s for v, s in share.items() if v not in full)
            more = {v for v in own if v not in full and level * share[v] >= own[v]}
            if not more:
                break
            full |= more
        if m.column == "lang":
            assert full == (set() if fraction == 0.5 else {"de", "es"})
        for v in own:
            want = own[v] if v in full else level * share[v]
            assert abs(got[v] - want) <= 2e-3 * want, (m.column, v)


def test_contradicting_margins_are_reported(spark):
    margins = (mixing.Margin("a", {"x": 0.9, "y": 0.1}), mixing.Margin("b", {"u": 0.1, "v": 0.9}))
    cells = spark.createDataFrame([("x", "u", 100), ("y", "v", 100)], "m0 string, m1 string, tokens bigint")
    with pytest.warns(UserWarning, match="margins do not meet"):
        assert all(r["raked"] > 0 for r in mixing.rake(cells, margins, fraction=0.5).collect())


def test_mixing_odd_tables(docs):
    df = docs([(1, None), (2, ""), (None, "a b"), (4, "long words everywhere"), (4, "long words everywhere")]).withColumn("p", F.lit(1)).withColumn("m0", F.lit("x"))
    df = df.withColumn("source", F.when(F.col("doc_id") == 4, F.lit("s")))
    assert mixing.mix(df, catalog.MIX, fraction=1.0).count() == 5
    assert mixing.mix(df.limit(0), catalog.MIX).count() == 0


# training order


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation_is_one_to_one(size):
    out = training_order.permuted(np.arange(size), size, 42)
    assert sorted(out.tolist()) == list(range(size))
    if size >= 1000:
        assert (out != training_order.permuted(np.arange(size), size, 43)).any()
        assert abs(np.corrcoef(np.arange(size), out)[0, 1]) < 0.1


def _slot(number, size, key):
    """The keyed permutation with plain integers."""
    full = 2**64

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % full
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % full
        return x ^ (x >> 31)

    half = max(1, -(-max(size - 1, 1).bit_length() // 2))
    while True:
        left, right = divmod(number, 2**half)
        for k in range(1, training_order.ROUNDS + 1):
            left, right = right, left ^ (mixed((right + mixed((k * 0x9E3779B97F4A7C15 + key) % full)) % full) % 2**half)
        number = left * 2**half + right
        if number < size:
            return number


def test_slots_equal_plain_integers():
    for size, key in ((1, 3), (777, 5), (4097, 2**63 + 11)):
        assert training_order.permuted(np.arange(size), size, key).tolist() == [_slot(n, size, key) for n in range(size)]


def test_shards_hold_every_sequence_once(spark, docs):
    model = bpe.load_model(catalog.tokenizer_path())
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(0, 120)))) for i in range(80)] + [(200, None), (200, None), (None, "x"), (300, "long " * 90_000)]
    end = model.special["<|endoftext|>"]
    packed = training_order.pack(docs(rows).withColumn("ids", F.lit(1)).repartition(3), model, end, length=32)
    folder = shared_path(spark, "test-shards")
    out = training_order.write_shards(packed, folder, key=7, stride=16).collect()
    read = list(training_order.read_sequences(folder, length=32))
    assert sorted(r["slot"] for r in out) == list(range(len(read)))
    for r in out:
        assert hashlib.sha256(read[r["slot"]].tobytes()).hexdigest() == r["ids_sha256"]
        assert divmod(r["slot"], 16) == (r["shard"], r["place"])
    # every document's ids come back, whatever the order of sequences
    want = sorted(model.encode(t or "").tolist() for _, t in rows)
    flat = sum(len(x) + 1 for x in want)
    assert sum(r["n_ids"] for r in out) == flat
    resumed = list(training_order.read_sequences(folder, length=32, start=21))
    assert all((a == b).all() for a, b in zip(resumed, read[21:])) and len(resumed) == len(read) - 21
    assert training_order.write_shards(training_order.pack(docs([]), model, end), shared_path(spark, "none"), 7).count() == 0
    # a shard that ends early and one that is not there are both told
    short = len(read) + 1 if len(read) % 16 else len(read) + 16
    for count in (short, (len(read) // 16 + 2) * 16):
        training_order._write_manifest(folder, count, 16, 7)
        with pytest.raises((ValueError, FileNotFoundError)):
            list(training_order.read_sequences(folder, length=32))


def test_secrets_without_digits_are_candidates():
    text = "password = correcthorsebattery, ghp_abcdefghijkl, Token: 'opensesamenow' api_key=ab12cd34ef, a secret garden, plainwords"
    found = [text[s:e] for s, e in pii.candidates(text, [])]
    assert found == ["correcthorsebattery", "ghp_abcdefghijkl", "opensesamenow", "ab12cd34ef"]
    start = text.index("correct")
    code, bits = pii.describe(text, start, start + len("correcthorsebattery"))
    votes = dict(zip(pii.LABELERS, pii._vote_matrix(np.array([code]))[0].tolist()))
    assert votes["secret_word"] == votes["assigned"] == 2 and bits >> 8 & 1
    # what a base span covers is none, and a long word counts whole
    at = text.index("opensesamenow")
    assert "opensesamenow" not in [text[s:e] for s, e in pii.candidates(text, [(at - 2, at + 5, 0)])]
    word = "a1" * 200 + "".join(map(chr, range(65, 91))) * 20
    assert pii._entropy(word) > 4 and pii.describe(word, 0, len(word))[1] >> 5 & 1


def test_shards_are_dealt_out_without_a_sample(spark, docs):
    model = bpe.load_model(catalog.tokenizer_path())
    end = model.special["<|endoftext|>"]
    packed = training_order.pack(docs([(i, "a b c " * 40) for i in range(30)]).repartition(3), model, end, length=32)
    folder = shared_path(spark, "shards")
    out = training_order.write_shards(packed, folder, key=7, stride=2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    rows = out.collect()
    assert len(rows) > 2 * training_order.SHARDS_PER_PART * 2  # several parts
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    by_slot = {r["slot"]: r["ids_sha256"] for r in rows}
    assert [hashlib.sha256(x.tobytes()).hexdigest() for x in training_order.read_sequences(folder, length=32)] == [by_slot[i] for i in range(len(rows))]


def test_known_and_new_words_among_odd_ones():
    model = bpe.load_model(catalog.tokenizer_path())
    fresh = bpe.WordBpe(model.spec, 50)
    texts = ["Tab\x1ca TAB tab. ab! É é İ x", "Σ ΑΣ tab. <|endoftext|>tab É", "tab. é ab! a", "z" * 60 + " tab. b c", ""] * 3
    together = [x.tolist() for x in fresh.encode_texts(texts)]
    alone = [model.encode(t).tolist() for t in texts]
    assert together == alone == [x.tolist() for x in fresh.encode_texts(texts)]
