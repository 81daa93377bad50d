"""Quality rules, BPE and language model against plain readings of their rules."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pinglake.llm import bpe, common, lm, quality_pu, quality_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    None, "", " \n\t ", "one", "a b c　d", "\x1cfoo\x85bar", "x " * 400, "Same line here now\n" * 30, "# * $ % & | < >\n\n#a b c", "long" * 30_000,
    "É é ß 中文 😀 'll we're I'm", "<|endoftext|> a <|startoftext|>b", "the cat sat on the mat the cat sat on the mat " * 12, "\r\nq\x0bw\x0ce\rr", "a" * 5000 + " b",
]


def docs(spark, texts=None, extra=True):
    texts = ODD if texts is None else texts
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [(2, texts[2], "en", None, 0), (None, "no id at all", None, None, 0)] if len(texts) > 2 else []
    df = spark.createDataFrame(rows, DOCS)
    # Columns whose names clash with those worked with.
    return df.selectExpr("*", "1 AS print", "2 AS h", "3 AS score", "'x' AS spans") if extra else df


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_word_spans_at_text_borders():
    raw = [b"ab c", b"", b"d", b" e", b"f ", b"g"]
    off = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    start, end, n = common.word_spans(np.frombuffer(b"".join(raw), np.uint8), off)
    assert [b"".join(raw)[a:b] for a, b in zip(start, end)] == [b"ab", b"c", b"d", b"e", b"f", b"g"]
    assert n.tolist() == [2, 0, 1, 1, 1, 1]


def test_quality_figures(spark):
    got = {(r.doc_id, r.n_words): r for r in quality_rules.measure(docs(spark)).collect()}
    for i, t in enumerate(ODD):
        w = words(t)
        r = got[(i, len(w))]
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want = (sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_quality_keep_has_the_columns_of_its_input(spark):
    df = docs(spark)
    kept = quality_rules.keep(df)
    assert kept.columns == df.columns
    assert quality_rules.keep(df.where("false")).count() == 0
    good = " ".join(f"w{i}" for i in range(80))
    assert [r.text for r in quality_rules.keep(docs(spark, [good, None])).collect()] == [good]


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    v = bpe.vocabulary(path)
    rng = np.random.default_rng(1)
    letters = list("abcdefghinorst' .!?<|>0189éÉüßΣσ́ İſ中あ😀")
    made = ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(3000)]
    for t in [*(x or "" for x in ODD), *made, "aaaaab" * 3000]:
        want = lib.encode(t, add_special_tokens=False).ids
        got = v.encode(t)
        assert got.tolist() == want, t[:80]
        assert v.decode(got).decode() == lib.decode(want, skip_special_tokens=False)
    rows = {r.doc_id: r for r in bpe.digest(docs(spark)).collect()}
    for i, t in enumerate(ODD):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert rows[i].n_tokens == len(ids) and rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digest(docs(spark).where("false")).count() == 0
    back = bpe.decode(bpe.encode(docs(spark, ["the cat", None], False))).collect()
    assert sorted(r.text for r in back) == ["", "the</w> cat</w>"]


@pytest.mark.parametrize("parts", [False, True])
def test_language_model(spark, monkeypatch, parts):
    if parts:
        # Many slices, each counted in parts.
        monkeypatch.setattr(lm, "SLICE_WORDS", 10)
        monkeypatch.setattr(lm, "PART_BATCHES", 1)
    rng = np.random.default_rng(2)
    # The second word of a pair follows from the first, which counts alone cannot tell.
    pairs = [f"w{i}ab w{i}{'xy' if i % 2 else 'zq'}" for i in range(20)]
    texts = [" ".join(rng.choice(pairs, 60)) for _ in range(300)] + ODD
    df = docs(spark, texts, False)
    got = {}
    for r in lm.score(df).collect():
        got.setdefault(r.doc_id, r)
    tokens = {i: [w.encode().lower().decode() for w in words(t)] + ["\n"] for i, t in enumerate(texts)}
    counted = Counter()
    for r in df.collect():
        if zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 7 != 2:
            counted.update([w.encode().lower().decode() for w in words(r.text)] + ["\n"])
    n, v = sum(counted.values()), len(counted)
    for i, t in tokens.items():
        r = got[i]
        assert (r.train_tokens, r.n_tokens, r.n_known) == (n, len(t), sum(counted[w] > 0 for w in t))
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert abs(r.base_score - sum(math.log10((counted[w] + 1) / (n + v + 1)) for w in t)) < 1e-6 * abs(r.base_score) + 1e-9
    held = [r for i, r in got.items() if i is not None and i < 300 and r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.score(df.where("false")).count() == 0


def test_sums_of_runs():
    rng = np.random.default_rng(5)
    size = np.r_[1, 9, 40, rng.integers(1, 12, 50)]
    first = np.cumsum(size) - size
    x = rng.integers(-50, 50, (int(size.sum()), 3)).astype(np.float32)
    want = [x[a : a + n].sum(axis=0) for a, n in zip(first, size)]
    assert np.array_equal(lm.run_sums(x, first, size), want)


def test_language_model_is_normalised():
    cells = np.arange(lm.CLASSES * lm.GROUPS).reshape(lm.CLASSES, lm.GROUPS)
    m = lm.Model(cells * 3.0, cells * 1.0)
    rng = np.random.default_rng(0)
    classes = np.array([0, 3, 3, 7, 1])
    for bias, w in zip((m.bias[0], m.bias[1][classes]), m.weights):
        weights = rng.normal(size=w.shape).astype(np.float32)
        z = np.exp(lm.log_softmax(bias, weights, rng.integers(0, lm.ROWS, (lm.FEATURES, 5))))
        assert np.allclose(z.sum(axis=1), 1, atol=1e-5)
    # Words of a group and its place for unseen ones share all of it.
    counts = np.array([5, 1, 9])
    assert np.isclose((np.r_[counts, 0] + 1).sum() / (counts.sum() + len(counts) + 1), 1)
    assert lm.class_of(lm.END) == 0 and all(1 <= lm.class_of(w) < lm.CLASSES for w in ("a", "tion", "é"))


def test_classifier(spark):
    rng = np.random.default_rng(3)
    vocab = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(400)]
    good = lambda: ". ".join(" ".join(rng.choice(vocab, 12)).capitalize() for _ in range(8))
    bad = lambda: " ".join(w.upper() + "!!" for w in rng.choice(vocab[:9], 60))
    truth = [int(rng.random() < 0.7) for _ in range(900)]
    texts = [good() if q else bad() for q in truth]
    df = docs(spark, texts, False)
    labels = spark.createDataFrame([(i, q, 0) for i, q in enumerate(truth)], "doc_id long, quality int, toxic int")
    got = [r for r in quality_pu.classify(df, labels).collect() if r.doc_id is not None]
    held = [r for r in got if r.held_out]
    assert len(got) == 901 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    none = quality_pu.classify(docs(spark), labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_pu.classify(df.where("false"), labels).count() == 0


def test_prior_from_positives_and_unlabelled_alone():
    rng = np.random.default_rng(8)
    good, bad = (lambda n: rng.normal(1.0, 1.0, (n, 3))), (lambda n: rng.normal(-1.5, 1.0, (n, 3)))
    for share in (0.2, 0.5, 0.85):
        n = int(4000 * share)
        mixed = rng.permutation(np.concatenate([good(n), bad(4000 - n)]))
        assert abs(quality_pu.class_prior(good(3000), mixed) - share) < 0.06
    assert 0.01 <= quality_pu.class_prior(good(1), bad(1)) <= 0.99


def test_sample_is_the_smallest_hashes(spark):
    df = spark.range(900).selectExpr("id AS doc_id", "array(cast(id AS double)) AS x")
    want = [r.doc_id for r in df.orderBy(F.xxhash64("doc_id", F.lit(quality_pu.SEED)), "doc_id").collect()]
    for size in (1, 40, 899, 900, 2000):
        assert quality_pu._sample(df, size)[:, 0].tolist() == want[:size]
    assert len(quality_pu._sample(df.where("false"), 5)) == 0
    # All rows under one id share a hash.
    assert len(quality_pu._sample(df.withColumn("doc_id", F.lit(7)), 40)) == 40


def test_likely_and_softmax_agree_with_the_whole_log_softmax():
    rng = np.random.default_rng(5)
    n = lm.PIECE + 37
    weights = rng.normal(size=(lm.ROWS, lm.GROUPS)).astype(np.float32)
    rows = rng.integers(0, lm.ROWS, (lm.FEATURES, n))
    target = rng.integers(0, lm.GROUPS, n)
    for bias in (rng.normal(size=(1, lm.GROUPS)).astype(np.float32), rng.normal(size=(n, lm.GROUPS)).astype(np.float32)):
        z = (bias + sum(weights[r] for r in rows)).astype(np.float64)
        want = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        assert np.allclose(lm.log_softmax(bias, weights, rows), want, atol=1e-4) and np.allclose(lm.softmax(bias, weights, rows), np.exp(want), atol=1e-5)
        assert np.allclose(lm.log_likely(bias, weights, rows, target), want[np.arange(n), target], atol=1e-4)
    first, size = np.array([0, 3, 4, 30]), np.array([3, 1, 26, 5])
    at = rng.permutation(35)
    assert np.allclose(lm.run_sums(z, first, size, at=at), [z[at[a : a + k]].sum(axis=0) for a, k in zip(first, size)])


def test_classes_of_a_list_are_those_of_its_words():
    names = [lm.END, "a", "é", "aé", "éa", "tion", "station", "日本", "x日", "日x", "ab", "cab", "ß", "1", "\x00a"]
    assert lm.classes_of([x.encode() for x in names]).tolist() == [lm.class_of(x) for x in names]
