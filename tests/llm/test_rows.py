"""Personal data, chat formatting, mixing and the pipeline."""

import hashlib
import random
import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_words import ODD, docs, words

from pinglake.llm import chat, mixing, pii
from pinglake.session import scratch


def base_spans(t):
    """The base rules, read plainly."""
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda h, d: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda h, d: all(int(x) <= 255 for x in h.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda h, d: 16 <= len(d) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda h, d: 8 <= len(d) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in rules.items() for m in re.finditer(p, t or "") if ok(m[0], re.sub("[^0-9]", "", m[0]))]


def test_personal_data(spark):
    rng = random.Random(5)
    bits = ["a", "b.", "@", "x-y", "1", ".", "22", "256", "0001", "+", "+1", "(", ")", " ", "-", "é", "😀", "4111111111111111", "4111 1111 1111 1111", "12345678", "%_", "c@d.e", "\n"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + ["1" * 50_000 + "@" + "a" * 50_000, "+1" + " " * 20_000 + "2"]
    got = pii.find_spans(docs(spark, texts), to="found").collect()
    assert len(got) == len(texts) + 2 and "spans" in got[0].asDict()
    for r in got:
        assert [(s.kind, s.start, s.end) for s in r.found if s.kind in pii.BASE] == base_spans(r.text), r.text[:99]


def test_checked_numbers_and_context(spark):
    texts = ["IBAN DE89370400440532013000 or DE89370400440532013001", "call 555-123-4567", "order 555-123-4567 of it", "SSN 123-45-6789", "part 123-45-6789", "x@y.zz 1.2.3.4 +1 (555) 555-0123"]
    df = docs(spark, texts, False).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = {r.doc_id: r.text for r in pii.redact(pii.find_spans(df)).collect()}
    assert got == {0: "IBAN [IBAN] or DE89370400440532013001", 1: "call [LOCAL_PHONE]", 2: texts[2], 3: "SSN [SSN]", 4: texts[4], 5: "[EMAIL] [IP] [PHONE]"}
    overlap = docs(spark, ["1.2.3.4@b.cd", None], False).where("doc_id < 2")
    assert [r.text for r in pii.redact(pii.find_spans(overlap)).orderBy("doc_id").collect()] == ["[EMAIL]", None]


def test_account_numbers_before_capitals_and_digits(spark):
    de, fr = "DE89370400440532013000", "FR1420041010050500013M02606"
    texts = [f"{de} Please pay", f"{de} 2 times", f"{de} {fr} A", "to GB82 WEST 1234 5698 7654 32 X1", f"{de}X no", f"DE12 {de}"]
    df = docs(spark, texts, False).where("doc_id IS NOT NULL")
    got = {r.doc_id: r.text for r in pii.redact(pii.find_spans(df)).collect()}
    assert got == {0: "[IBAN] Please pay", 1: "[IBAN] 2 times", 2: "[IBAN] [IBAN] A", 3: "to [IBAN] X1", 4: texts[4], 5: "DE12 [IBAN]"}


def test_chat_round_trip(spark):
    rng = random.Random(9)
    bits = ["\\", "###", "</turn>", "\n", "#", "a", "é", "### assistant\n", "\n</turn>\n", "<", "/turn>", " "]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd: role\n", None]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))])) for c in range(200) for t in range(rng.randint(1, 6))]
    rows += [(1, 0, "user", "again"), (1, 0, "user", "again"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat.format_turns(chat.rows_to_turns(df)).withColumns({"back": chat.parse(F.col("formatted")), "learned": chat.masked(F.col("formatted"), F.col("loss"))}).collect()
    want = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert len(out) == len(want)
    for r in out:
        assert [tuple(t) for t in r.back] == [tuple(t) for t in r.turns] == want[r.conv_id]
        assert r.learned == [t for role, t in want[r.conv_id] if role == "assistant"]
    assert chat.format_turns(chat.rows_to_turns(df.where("false"))).count() == 0
    with pytest.raises(ValueError):
        chat.rows_to_turns(spark.createDataFrame([(1, "x")], "id long, body string"))
    with pytest.raises(ValueError):
        chat.rows_to_turns(df.withColumn("prompt", F.lit("of two layouts")))
    # Other columns, nested ones too, do not matter.
    more = df.selectExpr("*", "1 AS source", "named_struct('role', 'x', 'text', array(1)) AS meta")
    assert sorted(map(str, chat.rows_to_turns(more).collect())) == sorted(map(str, chat.rows_to_turns(df).collect()))


def test_chat_query_reads_rows_and_records(spark):
    from pinglake.llm.queries import QUERIES

    got = {r.conv_id: r for r in QUERIES["op4_chat_formatting"](spark, "/root/testdata/sf0.001").collect()}
    text = "\\### Assistant: </turn> ok"
    assert (got[-7].n_turns, got[-7].loss_chars) == (2, len(text))
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert len(got) == 1 + spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id").distinct().count()


def test_layouts_of_records(spark):
    records = {
        '{"messages":[{"role":"user","content":"a"},{"role":"model","content":"b"}]}': [("user", "a"), ("assistant", "b")],
        '{"conversations":[{"from":"human","value":"x"},{"value":null,"from":"gpt"}]}': [("user", "x"), ("assistant", "")],
        '{"response":"r","prompt":"p"}': [("user", "p"), ("assistant", "r")],
        '{"instruction":"i","input":"n","output":"o"}': [("user", "i\n\nn"), ("assistant", "o")],
        '{"system":"s","question":"q","answer":"a"}': [("system", "s"), ("user", "q"), ("assistant", "a")],
        '{"id":7,"meta":{"source":"web","messages":[1]},"messages":[{"role":"user","content":"a","weight":0.5},{"role":"bot","content":"7"}]}': [("user", "a"), ("assistant", "7")],
        '{"request":{"id":1,"messages":[{"author":{"role":"human","name":"x"},"content":{"text":"deep","kind":"t"}},{"author":{"role":"gpt"},"content":{"text":"down"}}]},"source":"s"}': [("user", "deep"), ("assistant", "down")],
        '{"prompt":"p","source":"s","completion":"c","tags":["messages"]}': [("user", "p"), ("assistant", "c")],
        '{"prompt":"p","response":"r","answer":"of two layouts"}': None,
        '{"messages":[]}': None,
        '{"other":1}': None,
        "no json": None,
        None: None,
    }
    df = spark.createDataFrame(list(enumerate(records)), "k long, j string")
    got = {r.conv_id: r.turns for r in chat.records_to_turns(df, "j", "k").collect()}
    assert [got[i] and [tuple(t) for t in got[i]] for i in range(len(records))] == list(records.values())


def test_targets_stop_at_three_times_the_size():
    assert np.allclose(mixing.targets([100, 100, 100]), [187.5, 75, 37.5])
    t = mixing.targets([10, 1000, 1000])
    assert t[0] == 30 and np.allclose(t[1:], [1980 * 2 / 3, 1980 / 3])
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0] and np.allclose(mixing.targets([0, 50]), [0, 50])


def test_tree_keeps_quotas():
    counts = [5, 0, 1000, 37]
    parts = mixing.split_tree(counts, 7, 3)
    assert parts.sum(axis=1).tolist() == counts and (parts >= 0).all()
    assert max(parts.sum(axis=0)) - min(parts.sum(axis=0)) <= 3
    assert (parts == mixing.split_tree(counts, 7, 3)).all() and (parts != mixing.split_tree(counts, 7, 4)).any()


def test_mix(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)) if i % 50 else None, rng.choice(["a", "b", "é", None] + ["hot"] * 4)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x"))
    mixed = mixing.mix(df, shards=8).cache()
    got = mixed.collect()
    assert len(got) == len(rows)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(words(t))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    target = dict(zip(order, mixing.targets([size[s] for s in order])))
    taken = dict.fromkeys(size, 0)
    for r in got:
        assert r._mix_size == len(words(r.text)) and r._mix_taken == r._mix_size * len(r._mix_shards) <= 3 * r._mix_size
        assert r._mix_source_size == size[r.source] and abs(r._mix_target - target[r.source]) < 1e-6
        assert all(0 <= x < 8 for x in r._mix_shards)
        taken[r.source] += r._mix_taken
    assert all(abs(taken[s] - target[s]) <= 2 for s in size)
    again = {(r.doc_id, tuple(r._mix_shards)) for r in mixing.mix(df.repartition(5), shards=8).collect()}
    assert again == {(r.doc_id, tuple(r._mix_shards)) for r in got}
    whole = mixing.shuffled(mixed, 8)
    assert whole.columns == df.columns and whole.count() == sum(len(r._mix_shards) for r in got)
    assert mixing.mix(df.where("false")).count() == 0


def test_pipeline(spark, tmp_path):
    rng = np.random.default_rng(12)
    vocab = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9))) for _ in range(900)]
    good = [" ".join(rng.choice(vocab, 120)) for _ in range(40)]
    texts = good + [good[0], good[1] + " more", "too short", None, "spam spam " * 60, good[2] + " mail me at who.ever@mail.example"]
    df = docs(spark, texts)
    path = scratch(spark, "pipeline")
    df.write.parquet(f"{path}/documents.parquet")
    seen = []
    now = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, path).cache()
        seen.append(now)
    quality, one, clean, mixed, ids = seen
    assert all(x.columns == list(corpus_pipeline.DOCUMENTS) for x in seen[:-1])
    left = {r.doc_id for r in quality.collect()}
    assert left == {*range(42), 45}
    assert {r.doc_id for r in one.collect()} >= set(range(40)) and 40 not in {r.doc_id for r in one.collect()}
    assert all("@" not in r.text and r.n_chars == len(r.text) for r in clean.collect())
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in clean.collect()}
    assert ids.count() == mixed.count()
    empty = scratch(spark, "pipeline")
    df.where("false").write.parquet(f"{empty}/documents.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES][1] == "near duplicates" and corpus_pipeline.ORACLE_SQL is None


def test_near_copies_go_in_the_pipeline(spark):
    rng = np.random.default_rng(13)
    vocab = [f"v{i}" for i in range(900)]
    base = [list(rng.choice(vocab, 200)) for _ in range(40)]
    copies = [[*b[:40], "other", *b[41:120], "word", *b[121:]] for b in base]  # similarity 0.90
    df = docs(spark, [" ".join(x) for x in base + copies], False).where("doc_id IS NOT NULL")
    left = corpus_pipeline.dedup(spark, df, "").collect()
    assert sorted(r.doc_id for r in left) == list(range(40))
