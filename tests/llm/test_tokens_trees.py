"""Token alignment, conversation tries and toxicity against plain readings of their rules."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from test_words import ODD, docs
from tokenizers import Tokenizer

from pinglake.llm import alignment, prefix_trie, toxicity
from pinglake.llm.bpe import _byte_letters
from pinglake.llm.common import Rolling, by_bytes, text_bytes
from pinglake.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
TRICKY = [
    *ODD[:12], "a▁b", "▁", " ", "  two  spaces ", "<s> hello </s> <unk> <0x41>", "<|endoftext|>", "naïve café 😀😀", "the the the the", "the", "a\x00b", "ﬁne ﬁne",
    "ﷺ ½ ①", "é é", " nbsp", "日本語のテキスト",
]


# --- Alignment ---


def spelled():
    a_path, b_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    byte = {c: i for i, c in enumerate(_byte_letters())}
    left = lambda i: bytes(byte[c] for c in a.id_to_token(i))
    right = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return lambda t: [(left(i), i) for i in a.encode(" " + t, add_special_tokens=False).ids], lambda t: [(right(i), i) for i in b.encode(t)]


def plain_alignment(texts):
    """Figures per text by walking over the ends of tokens."""
    left, right = spelled()
    out, count = [], Counter()
    for t in texts:
        a, b = (left(t), right(t)) if t else ([], [])
        full = (" " + (t or "")).encode()
        if not t or b"".join(x for x, _ in a) != full or b"".join(x for x, _ in b) != full:
            out.append((0, 0, [], ""))
            continue
        ends = []
        for side in (a, b):
            at, e = 0, {}
            for x, i in side:
                at += len(x)
                e[at] = i
            ends.append(e)
        both = sorted(ends[0].keys() & ends[1].keys())
        links = [(ends[0][e], ends[1][e]) for e in both]
        count.update(links)
        groups = []
        rest = [iter(side.items()) for side in ends]
        for e in both:
            group = []
            for side in rest:
                ids = []
                for p, i in side:
                    ids.append(str(i))
                    if p == e:
                        break
                group.append(",".join(ids))
            groups.append("|".join(group))
        out.append((len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (a, b), n in count.items():
        best[b] = max(best[b], n)
    return [(na, nb, len(links), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), h) for na, nb, links, h in out]


FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("rows", [3, 4000])
def test_alignment(spark, monkeypatch, rows):
    monkeypatch.setattr(alignment, "ROWS", rows)
    df = docs(spark, TRICKY)
    told = df.select("doc_id", "text").collect()
    want = sorted(zip([(r.doc_id is None, r.doc_id or 0) for r in told], plain_alignment([r.text for r in told])))
    got = sorted(((r.doc_id is None, r.doc_id or 0), tuple(r[c] for c in FIGURES)) for r in alignment.align(df).collect())
    assert got == want
    assert any(w[0] == 0 for _, w in want) and any(w[0] > 0 for _, w in want)
    assert alignment.align(df.where("false")).count() == 0


def test_alignment_query(spark):
    told = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in told], plain_alignment([r.text for r in told])))
    assert {r.doc_id: tuple(r[c] for c in FIGURES) for r in QUERIES["op11_alignment"](spark, SMALL).collect()} == want


def test_coalescing_and_overlaps():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n = int(rng.integers(2, 60))
        a = np.append(np.flatnonzero(rng.random(n - 1) < 0.4) + 1, n)
        b = np.append(np.flatnonzero(rng.random(n - 1) < 0.3) + 1, n)
        start = lambda e: np.concatenate([[0], e[:-1]])
        group = alignment.coalesce(np.concatenate([start(a), start(b)]), np.concatenate([a, b]))
        both = np.intersect1d(a, b)
        assert group.tolist() == [*np.searchsorted(both, a), *np.searchsorted(both, b)]
        pairs = {(i, j) for i in range(len(a)) for j in range(len(b)) if max(start(a)[i], start(b)[j]) < min(a[i], b[j])}
        assert sorted(zip(*alignment.overlaps(a, b))) == sorted(pairs)


def test_batches_by_bytes():
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["a" * 10, None, "b" * 10, "c" * 100, "", "d", "e"])], names=["i", "t"])
    cuts = [x.column(0).to_pylist() for x in by_bytes([b], 1, 3, 20)]
    assert cuts == [[0, 1, 2], [3], [4, 5, 6]]


# --- Conversation trie ---


def plain_trie(rows):
    """All nodes by a walk over every prefix."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = own.get(int(math.fmod(c, 100)) * -1 + c, [])[:h] + x[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
            if d:
                children[tuple(whole[: d - 1])].add(tuple(whole[:d]))
        ends[tuple(whole)].append(c)
    leaves, saved = Counter(), Counter()
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(m) - 1) * (len(node[-1][1]) if node else 0)
    sha = lambda m: hashlib.sha256(",".join(map(str, sorted(m))).encode()).hexdigest()
    return sorted(
        (len(n), min(m), str(min(members[n[:-1]]) if n else None), len(m), len(children.get(n, ())), leaves[n], saved[n], sha(ends.get(n, [])))
        for n, m in members.items()
    )


COLUMNS = ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def told(df):
    return sorted(tuple(str(r[c]) if c == "parent_conv_id" else r[c] for c in COLUMNS) for r in df.collect())


def conversations(seed):
    rng = random.Random(seed)
    texts = ["hi", "yes é", "no", "", None, "a longer turn 😀"]
    rows = []
    for c in [*range(0, 12), *range(100, 112), *range(305, 309), *range(-104, -96), 7_000_000_000]:
        for t in range(rng.choice([1, 2, 3, 5])):
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(texts)))
    rows += [(5, 1, "user", "same"), (5, 1, "user", "same"), (None, 0, "user", "lost"), (200, None, None, None)]
    rows += [(400 + i, t, "user", f"common {t}") for i in range(60) for t in range(4)]  # many copies
    rows += [(600, t, "user", f"t{t % 3}") for t in range(20)]  # one long conversation
    return rows


@pytest.mark.parametrize("height,block", [(2, 4), (64, 65536)])
def test_trie(spark, height, block):
    rows = conversations(height)
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS d", "2 AS node", "3 AS pos", "'x' AS _range").repartition(5)
    convs, turns = prefix_trie.rebuilt(prefix_trie.ordered_turns(df))
    got = told(prefix_trie.trie(prefix_trie.paths(convs, turns, block), height))
    assert got == plain_trie(rows)
    con = duckdb.connect()
    con.register("conversations", df.select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    sql = con.sql(prefix_trie.SQL)
    at = [sql.columns.index(c) for c in COLUMNS]
    assert sorted(tuple(str(r[i]) if c == "parent_conv_id" else r[i] for c, i in zip(COLUMNS, at)) for r in sql.fetchall()) == got


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(prefix_trie.paths(*prefix_trie.rebuilt(prefix_trie.ordered_turns(df)))).count() == 0


def test_trie_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(QUERIES["op12_prefix_trie"](spark, SMALL)) == plain_trie(rows)


# --- Toxicity ---


def counted(texts):
    """Trigrams of kinds by a plain walk."""
    kinds = []
    for t in texts:
        for b in (t or "").lower().encode():
            kinds.append(b - 96 if 97 <= b <= 122 else 27 + (b & 31) if b >= 128 else 0)
        kinds.append(0)
    kinds = [0, *kinds]
    flat = [k for i, k in enumerate(kinds) if k or not i or kinds[i - 1]]
    return Counter(zip(flat, flat[1:], flat[2:]))


def test_trigrams():
    texts = ["Abc d", "", None, "the  THE!", "é1x", "end"]
    import pyarrow as pa

    got = toxicity.trigrams(*text_bytes(pa.array(texts)))
    k = toxicity.KINDS
    assert {(int(i) // k // k, int(i) // k % k, int(i) % k): int(got[i]) for i in np.flatnonzero(got)} == counted(texts)


def english():
    rng = np.random.default_rng(5)
    vocab = "the of and stupid idiot loser moron scum pathetic trash reading weather morning garden window river yellow student letter summer".split()
    return [" ".join(rng.choice(vocab, 40)) for _ in range(60)]


def model():
    import pyarrow as pa

    return toxicity.Characters(toxicity.trigrams(*text_bytes(pa.array(english()))), 1.0)


def test_viterbi_finds_the_best_of_all_paths():
    log = model().log

    def cost(parts):
        s, a, b = 0.0, 0, 0
        for text, c in [*parts, (b" ", 0.0)]:
            s -= c
            for x in text:
                k = int(toxicity._KIND[x])
                if k or b:
                    s += float(log[a, b, k])
                    a, b = b, k
        return s

    for unit in (b"1d10t", b"st*pid", b"i d i o t", b"l00ser", b"tra$$h", b"m.o.r.o.n", b"sttuppid", b"4 5"):
        places = toxicity.lattice(unit)
        ways = {b"".join(t for t, _ in w): cost(w) for w in itertools.product(*places)}
        found = toxicity.best_path(places, log)
        assert ways[found] >= max(ways.values()) - 1e-3, (unit, found)


@pytest.mark.parametrize("old,new", [("1d10t", "idiot"), ("STUP1D", "stupid"), ("m0r0n", "moron"), ("i d i o t", "idiot"), ("s-c-u-m", "scum"), ("stuuuupid", "stupid"), ("p@thetic", "pathetic"), ("tra$h", "trash"), ("st*pid", "stupid")])
def test_restored(old, new):
    import pyarrow as pa

    data, off, changed = toxicity.restored(*text_bytes(pa.array(["clean text, 3 eggs!", f"you {old} there", "", old])), model())
    parts = [data[a:b].tobytes().decode() for a, b in zip(off, off[1:])]
    assert parts[0] == "clean text, 3 eggs!" and parts[1].split() == ["you", new, "there"] and parts[3].strip() == new
    assert changed.tolist() == [0, 1, 0, 1]


def toxic_table(spark, n=700):
    rng = np.random.default_rng(8)
    vocab = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9))) for _ in range(300)]
    bad = ["idiot", "1d1ot", "i d i o t", "idiooooot"]
    truth = [int(rng.random() < 0.3) for _ in range(n)]
    texts = []
    for i, y in enumerate(truth):
        w = list(rng.choice([*vocab, "ridiculous", "radio", "riot"], 60))
        # The labelled part says it plainly, the held-out part in disguise.
        if y:
            w[int(rng.integers(60))] = bad[i % 4] if zlib.crc32(str(i).encode()) % 4 == 2 else "idiot"
        texts.append(" ".join(w))
    return texts, truth


def test_toxicity(spark):
    texts, truth = toxic_table(spark)
    df = docs(spark, texts).withColumnRenamed("score", "toxic")
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(truth)] + [(0, 1, truth[0]), (None, 1, 1), (10**9, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.detect(df, labels).collect()
    assert len(got) == len(texts) + 2
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    known = [r for r in got if r.doc_id is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in known)
    assert {r.doc_id: r.predicted for r in known} == dict(enumerate(truth))
    # Labels of the held-out part change nothing.
    other = spark.createDataFrame([(i, 1, y if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - y) for i, y in enumerate(truth)], "doc_id long, quality int, toxic int")
    assert sorted((r.doc_id or -1, r.score) for r in toxicity.detect(df, other).collect()) == sorted((r.doc_id or -1, r.score) for r in got)


def test_scores_are_the_model_s(spark):
    """Each score is the logistic of the weights of the words and beginnings that a text holds."""
    texts, truth = toxic_table(spark, 200)
    df = docs(spark, [*texts, *ODD[:10]], False)
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(truth)], "doc_id long, quality int, toxic int")
    m, rolling = toxicity.learn(df, labels), Rolling(13)
    got = {r.doc_id: r.score for r in toxicity.detect(df, labels).collect()}

    def hashed(word, k):
        data = np.frombuffer(word, np.uint8)
        h = rolling.ranges(rolling.sums(data), np.array([0]), np.array([len(word)]))[0]
        return int(h) if not k else (int(h) + k) % 2**64

    import re

    number = {int(h): i for i, h in enumerate(m.known.sorted)}
    for r in df.where("doc_id is not null").dropDuplicates(["doc_id"]).collect():
        data, off, _ = toxicity.restored(*text_bytes(__import__("pyarrow").array([r.text])), m.characters)
        held = set()
        for w in re.findall(rb"[a-z\x80-\xff]+", data.tobytes()):
            held |= {hashed(w, 0), *(hashed(w[:k], k) for k in toxicity.BEGINNINGS if len(w) > k)}
        z = m.offset + sum(m.weights[number[h]] for h in held if h in number)
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-z))) < 1e-9


def test_toxicity_without_labels(spark):
    df = docs(spark)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert {round(r.score, 6) for r in toxicity.detect(df, labels.where("false")).collect()} == {0}
    assert {round(r.score, 6) for r in toxicity.detect(df, labels).collect()} == {0}
    assert toxicity.detect(df.where("false"), labels).count() == 0


def test_toxicity_query(spark):
    got = QUERIES["op13_toxicity"](spark, SMALL).collect()
    ids = [r.doc_id for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect()]
    assert sorted(r.doc_id for r in got) == sorted(ids) and all(0 <= r.score <= 1 for r in got)
