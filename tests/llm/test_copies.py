"""Duplicates, fingerprints and suffix arrays against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_words import ODD, docs, words

from pinglake.llm import components, exact_substrings, fingerprints, near_copies, simhash_dedup
from pinglake.llm.suffix_array import suffix_array


def near_texts(n=120, seed=1):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(500)]
    out = list(ODD)
    for _ in range(n):
        base = list(rng.choice(vocab, 60))
        out.append(" ".join(base))
        for _ in range(rng.integers(0, 4)):
            copy = list(base)
            for _ in range(rng.integers(0, 3)):
                copy[rng.integers(60)] = "CHANGED"
            out.append(" ".join(copy))
    return out


def fingerprint(t):
    w = [x.encode().lower().decode() for x in words(t)]
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def groups(prints, radius):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in prints}


@pytest.mark.parametrize("chunk", [2, 2048])
def test_near_duplicates(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash_dedup, "CHUNK", chunk)
    texts = near_texts()
    rows = simhash_dedup.near_duplicates(docs(spark, texts)).collect()
    assert len(rows) == len(texts) + 2
    want = {i: fingerprint(t) for i, t in enumerate(texts)}
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert {i: r.print % (1 << 64) for i, r in got.items()} == want
    assert {i: r.component_id for i, r in got.items()} == groups(want, simhash_dedup.RADIUS)
    kept = [r.doc_id for r in simhash_dedup.keep_one(docs(spark, texts)).select("doc_id").collect()]
    assert sorted(x for x in kept if x is not None) == sorted(set(groups(want, simhash_dedup.RADIUS).values()))
    assert kept.count(None) == 1  # the row without an id is like no other


def test_near_duplicates_of_nothing(spark):
    df = docs(spark)
    assert simhash_dedup.near_duplicates(df.where("false")).count() == 0
    assert simhash_dedup.keep_one(df).columns == df.columns


@pytest.mark.parametrize("blocks", [5, 6, 7, 9])
def test_any_number_of_blocks_finds_the_same(spark, blocks):
    rng = random.Random(blocks)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = {}
    for b in base:
        for _ in range(5):
            x = b
            for bit in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << bit
            prints[x if x < 1 << 63 else x - (1 << 64)] = x
    df = spark.createDataFrame([(x,) for x in prints], "print long")
    got = {r["node"]: r["root"] for r in components.components(simhash_dedup.links(df, 4, blocks)).collect()}
    of = {x: got.get(x, x) for x in prints}
    want = groups({i: x for i, x in enumerate(prints.values())}, 4)
    keys = list(prints)
    assert all((of[keys[i]] == of[keys[j]]) == (want[i] == want[j]) for i in want for j in want)


def test_components_of_paths_and_stars(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 299)]
    rng.shuffle(edges)
    df = spark.createDataFrame([e if rng.random() < 0.5 else e[::-1] for e in edges], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[i] == 100 for i in range(101, 160)) and got[300] == 299 and 200 not in got


def test_next_document_and_search(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [*ODD, *near_texts(60, 5)[len(ODD) :]]
    df = docs(spark, texts, False).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text")
    got = {r.doc_id: r for r in fingerprints.with_next(df, rows=7).collect()}
    n = len(texts)
    assert len(got) == n and all(got[i].next_text == texts[(i + 1) % n] for i in range(n))
    prints = [r.p for r in fingerprints.fingerprints(df, {"text": "p"}, ["doc_id"]).orderBy("doc_id").collect()]
    assert prints[0] == prints[1] == bytes(16)
    many = [bytes(rng.integers(0, 256, 16, np.uint8)) for _ in range(40)]
    # From 0 to 40 bits away, some just within the radius and some just beyond.
    def moved(p, k):
        x = int.from_bytes(p, "big")
        for i in rng.choice(128, k, replace=False):
            x ^= 1 << int(i)
        return x.to_bytes(16, "big")

    many += [moved(p, k) for p in many for k in (1, 5, 12, 16, 17, 18, 19, 40)]
    weight = {p: 1 + i % 3 for i, p in enumerate(dict.fromkeys(many))}
    there = spark.createDataFrame(list(weight.items()), "print binary, weight long")
    asked = spark.createDataFrame([(p,) for p in many[:60]], "print binary")
    bits = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b))
    want = lambda d: {p: sum(w for q, w in weight.items() if bits(p, q) <= d) for p in many[:60]}
    found = lambda *a: {bytes(r.print): r.n for r in fingerprints.within(asked, there, *a).collect()}
    assert found() == want(fingerprints.RADIUS) and found(3, 4) == want(3)
    monkeypatch.setattr(fingerprints, "CHUNK", 2)  # every key with three fingerprints is split
    assert found() == want(fingerprints.RADIUS)
    likes = spark.createDataFrame([(many[0], many[45])], "a binary, b binary").select(fingerprints.likeness(F.col("a"), F.col("b")).alias("x")).first()["x"]
    assert abs(likes - (1 - bits(many[0], many[45]) / 128)) < 1e-12


def test_suffix_array():
    rng = random.Random(6)
    for _ in range(3000):
        s = "".join(rng.choice(rng.choice(["a", "ab", "abc"])) for _ in range(rng.randint(0, 40))).encode() * rng.randint(1, 3)
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def removed(texts):
    """(bytes, removed, spans, hash of the rest) per text, from a set of all windows met so far."""
    seen, out = set(), []
    for b in (x.encode() for x in texts):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(b[i : i + 100])
        rest = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("together", [3, 1 << 15])
def test_repeated_passages(spark, monkeypatch, together):
    monkeypatch.setattr(exact_substrings, "TOGETHER", together)
    rng = random.Random(7)
    made = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages = [made(rng.randint(80, 260)) for _ in range(8)]
    texts = [x or "" for x in ODD]
    for _ in range(150):
        t = ""
        for _ in range(rng.randint(0, 5)):
            p, k = rng.choice(passages), rng.random()
            t += p[rng.randint(0, 25) : len(p) - rng.randint(0, 25)] if k < 0.5 else "ab" * rng.randint(1, 150) if k < 0.6 else made(5) * 40 if k < 0.7 else made(rng.randint(0, 90))
        texts.append(t)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, h int, d int")
    got = exact_substrings.remove(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == removed(texts)


def test_repeated_rows_and_missing_ids_of_passages(spark):
    t = "".join(random.Random(8).choices("abcdefgh ", k=300))
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t), (5, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in exact_substrings.remove(df).collect()), key=str)
    # The row without an id is first; rows equal in id and text are one document.
    assert got == sorted([(None, 300, 0, 0), (1, 300, 300, 1), (1, 300, 300, 1), (2, 300, 300, 1), (5, 0, 0, 0)], key=str)
    assert exact_substrings.remove(df.where("false")).count() == 0


def test_passages_of_many_texts_without_id(spark):
    # 4,000 different texts under one id; two texts share each passage, with other signs around it.
    rng = random.Random(9)
    made = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passages = [made(150) for _ in range(2000)]
    parts = [(made(rng.randint(0, 120)) + around[0], p, around[1] + made(rng.randint(0, 120))) for p in passages for around in ("<>", "[]")]
    df = spark.createDataFrame([(None, "".join(x)) for x in parts], "doc_id long, text string")
    kept = {bytes(r.kept): r for r in exact_substrings.remove(df).collect()}
    for x, y in zip(parts[::2], parts[1::2]):
        # One of the two loses the passage and nothing else, the other one is whole.
        found = [[kept.get(k.encode()) for k in ("".join(z), z[0] + z[2])] for z in (x, y)]
        assert sorted([a is not None, b is not None] for a, b in found) == [[False, True], [True, False]]
        assert sorted((r.n_removed, r.n_spans) for f in found for r in f if r) == [(0, 0), (150, 1)]


def test_near_copies_by_similarity(spark):
    rng = np.random.default_rng(11)
    vocab = [f"w{i}" for i in range(2000)]
    texts, want = list(ODD), []
    for _ in range(60):
        base = list(rng.choice(vocab, 200))
        # Three changed words touch 15 of 196 shingles (similarity 0.86), twelve spread ones about 60.
        near, far = list(base), list(base)
        for at in (20, 90, 150):
            near[at] = "changed"
        for at in range(5, 197, 16):
            far[at] = "changed"
        texts += [" ".join(x) for x in (base, near, far)]
        want += [len(texts) - 3, len(texts) - 1]
    kept = {r.doc_id for r in near_copies.keep_one(docs(spark, texts)).collect()}
    assert {i for i in kept if i is not None and i >= len(ODD)} == set(want)
    assert near_copies.keep_one(docs(spark).where("false")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_stars_connect_what_similar_pairs_connect(seed):
    rng = np.random.default_rng(seed)
    sets = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(12)]
    for _ in range(40):
        x = sets[rng.integers(len(sets))]
        sets.append(np.unique(np.r_[np.delete(x, rng.integers(len(x))), rng.integers(0, 40, 1).astype(np.uint64)]))
    like = lambda x, y: len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if like(sets[i], sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    x, y = near_copies.stars(np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets)]))
    of = list(range(len(sets)))
    for a, b in zip(x.tolist(), y.tolist()):
        of[b] = a
    assert all((of[i] == of[j]) == (root[i] == root[j]) for i in range(len(sets)) for j in range(len(sets)))


def test_groups_of_another_method_are_candidates(spark):
    words = [f"w{i}" for i in range(200)]
    texts = {1: " ".join(words), 2: " ".join([*words[:-1], "x"]), 3: " ".join(reversed(words))}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    # Minimum hashes find nothing here: each set has fingerprints of its own.
    prints = near_copies.signatures(d).withColumn("bands", F.array(F.xxhash64("s")))
    linked = d.select(F.xxhash64("text").alias("t"), F.lit(5).cast("long").alias("root"))
    s = {r.doc_id: r.s for r in prints.collect()}
    assert near_copies.links(d, prints).count() == 0
    found = {frozenset((r.a, r.b)) for r in near_copies.links(d, prints, linked=linked).collect()}
    assert found == {frozenset((s[1], s[2]))}


def test_dedup_of_the_pipeline_goes_through_the_operator(spark, monkeypatch):
    import corpus_pipeline

    asked = []
    real = simhash_dedup.near_duplicates
    monkeypatch.setattr(simhash_dedup, "near_duplicates", lambda d, *a, **k: asked.append(1) or real(d, *a, **k))
    row = lambda i, t: (i, t, "en", "a", len(t))
    words = " ".join(f"w{i}" for i in range(200))
    d = spark.createDataFrame([row(1, words), row(2, words + " x"), row(3, "other text of no likeness at all")], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.dedup(spark, d, "").collect()) == [1, 3] and asked
