"""Document fingerprints and their query against a plain count of votes."""

import hashlib

import numpy as np

from pinglake.llm import fingerprints as fp
from pinglake.llm.common import Rolling, mix64
from pinglake.llm.queries import QUERIES

TEXTS = ["the cat sat on the mat", "", None, "one", "a much longer sentence of words, with the cat in it twice: the cat", "É é 中文 😀 words of many kinds", "the cat sat on the mat", "x y " * 40]


def plain(text):
    words = (text or "").encode().split()
    rolling = Rolling(6)

    def hashed(w):
        data = np.frombuffer(w, np.uint8)
        return rolling.ranges(rolling.sums(data), np.array([0]), np.array([len(w)]))

    size = [min(len(w), fp.LONGEST) for w in words]
    terms = [(hashed(w), s) for w, s in zip(words, size)]
    for i in range(len(words) - 1):
        both = mix64(hashed(words[i]) * np.uint64(0x9E3779B97F4A7C15) + hashed(words[i + 1]))
        terms.append((both, fp.PAIR_WEIGHT * (size[i] + size[i + 1])))
    votes = [0] * fp.BITS
    for h, weight in terms:
        raw = h.tobytes() + mix64(h ^ np.uint64(0xD6E8FEB86659FD93)).tobytes()
        for k in range(fp.BITS):
            votes[k] += weight if raw[k // 8] >> (7 - k % 8) & 1 else -weight
    return "".join(str(int(v > 0)) for v in votes)


def test_query_is_the_plain_count(spark, tmp_path):
    rows = [(i * 10, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op6_fingerprints"](spark, str(tmp_path)).collect()}
    assert len(got) == len(TEXTS)
    bits = lambda x: f"{int(x, 16):0{fp.BITS}b}"
    alike = lambda a, b: sum(x == y for x, y in zip(a, b)) / fp.BITS
    for i, t in enumerate(TEXTS):
        t, after = t or "", TEXTS[(i + 1) % len(TEXTS)] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i * 10]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert bits(r.fingerprint) == plain(t) and bits(r.edited_fingerprint) == plain(edited)
        assert abs(r.near_edited - alike(plain(t), plain(edited))) < 1e-9
        assert abs(r.near_next - alike(plain(t), plain(after))) < 1e-9
