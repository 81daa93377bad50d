"""Toxicity by noisy-channel deobfuscation.

Words that may be disguised (signs for letters, letters set apart, letters repeated) become
lattices: each place offers the characters it may stand for, at the channel's cost. A Viterbi
search finds the path that is likeliest under a trigram model of characters, whose counts are taken
from all texts. The restored text is then scored by a logistic model of the words and word
beginnings that mark toxic texts.

The character model is a fixed table (59 kinds of bytes, trigrams). The classifier is fit on at most
``SAMPLE`` labelled texts of each class, drawn by hash from the rows outside the held-out fold; it
knows ``FEATURES`` words and beginnings. Every text is restored and scored whole.

Defined cases: null and empty texts are scored by the model without any feature; repeated rows get
equal scores; a label table with repeated ids counts equal rows once; without labels of both kinds
every score is the share of toxic labels (0 without any label); rows without id are scored but not
learned from; long runs and very long texts are decoded whole; an empty table gives an empty table;
other columns, clashing names included, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .common import Rolling, by_bytes, documents, fold, per_text, text_bytes, word_spans

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
# Most labelled texts of each class that a fit reads, and words and beginnings it may use.
SAMPLE = 10_000
FEATURES = 512
# Texts of the sample that must hold a feature.
SUPPORT = 3
# Lengths in bytes of the word beginnings that are features beside whole words.
BEGINNINGS = (3, 4, 5, 6)
RIDGE = 1.0

# Letters that a sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou",
}
# Signs that set letters apart.
GAPS = " ._-*"
# Costs of the channel, as natural logarithms of how rarely it does so.
SIGN_COST, JOIN_COST, REPEAT_COST, DROP_COST = 2.0, 1.0, 4.0, 3.0

KINDS = 59  # one for all that ends a word, 26 letters, 32 for bytes beyond ASCII
_KIND = np.zeros(256, np.int64)
_KIND[97:123] = np.arange(1, 27)
_KIND[65:91] = np.arange(1, 27)
_KIND[128:] = 27 + (np.arange(128, 256) & 31)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = _KIND > 0
_ASCII = np.zeros(256, bool)
_ASCII[97:123] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in SIGNS]] = True
_TAIL = np.zeros(256, bool)  # signs that may end a disguised word; the others rather end a sentence
_TAIL[[ord(c) for c in "$@"]] = True
_GAP = np.zeros(256, bool)
_GAP[[ord(c) for c in GAPS if c != " "]] = True


def trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of three kinds of bytes in a row; whatever ends a word counts once."""
    kind = np.insert(_KIND[data], offsets[:-1], 0)
    kind = np.append(kind, 0)
    kind = kind[np.concatenate([[True], (kind[1:] > 0) | (kind[:-1] > 0)])] if len(kind) else kind
    return np.bincount((kind[:-2] * KINDS + kind[1:-1]) * KINDS + kind[2:], minlength=KINDS**3)


class Characters:
    """Log probabilities of a kind after two others, mixed with those after one and none."""

    def __init__(self, counts: np.ndarray, weight: float = 20.0):
        c3 = counts.reshape(KINDS, KINDS, KINDS).astype(float)
        c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
        p1 = (c1 + 0.1) / (c1 + 0.1).sum()
        p2 = (c2 + weight * p1) / (c2.sum(axis=1, keepdims=True) + weight)
        p3 = (c3 + weight * p2[None]) / (c3.sum(axis=2, keepdims=True) + weight)
        self.log = np.log(p3).astype(np.float32)
        self.cache: dict[bytes, bytes] = {}

    def __getstate__(self):
        return {"log": self.log, "cache": {}}

    def restore(self, unit: bytes) -> bytes:
        """The likeliest text of a disguised word or of letters set apart; spaces for whatever is no letter."""
        found = self.cache.get(unit)
        if found is None:
            if len(self.cache) >= 200_000:
                self.cache.clear()
            found = best_path(lattice(unit), self.log)
            if len(unit) < 64:
                self.cache[unit] = found
        return found


def lattice(unit: bytes) -> list[list[tuple[bytes, float]]]:
    """Choices (bytes, cost) at each place of a lower-cased unit; equal bytes in a row are one place."""
    at, out = 0, []
    # Letters set apart: gaps between single characters may be nothing.
    apart = _apart(unit)
    while at < len(unit):
        c = unit[at : at + 1]
        n = 1
        while unit[at + n : at + n + 1] == c:
            n += 1
        s = c.decode("latin-1")
        if _ASCII[c[0]]:
            out.append([(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, REPEAT_COST if n == 2 else 0.0)])
        elif c[0] >= 128:
            out.append([(c * n, 0.0)])
        else:
            choice = [(b" ", 0.0)]
            if s in SIGNS and n < 3:
                choice += [(x.encode() * k, SIGN_COST) for x in SIGNS[s] for k in {1, n}]
            if s == "*" and n < 3:
                choice.append((b"", DROP_COST))
            if apart and s in GAPS:
                choice.append((b"", JOIN_COST))
            out.append(choice)
        at += n
    return out


def _apart(unit: bytes) -> bool:
    """Single characters with gaps between them, four at least."""
    return len(unit) > 6 and all((i % 2 == 1) == (chr(c) in GAPS) for i, c in enumerate(unit[:7]))


def best_path(places: list[list[tuple[bytes, float]]], log: np.ndarray) -> bytes:
    """Viterbi search: for each two last kinds only the best way there goes on."""
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for choice in [*places, [(b" ", 0.0)]]:
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, way) in states.items():
            for text, cost in choice:
                s, p, q = score - cost, a, b
                for byte in text:
                    k = int(_KIND[byte])
                    if k or q:  # another space after a space says nothing
                        s += float(log[p, q, k])
                        p, q = q, k
                if (p, q) not in new or s > new[(p, q)][0]:
                    new[(p, q)] = (s, (text, way))
        states = new
    way = max(states.values(), key=lambda x: x[0])[1]
    parts = []
    while way:
        parts.append(way[0])
        way = way[1]
    return b"".join(reversed(parts))[:-1]  # without the space that ended it


def disguised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the units of lower-cased texts that may be disguised."""
    none = np.zeros(0, np.int64)
    start, end, counts = word_spans(data, offsets)
    if not len(start):
        return none, none
    pad = np.concatenate([data, np.zeros(3, np.uint8)])
    letter, sign, gap, tail = _ASCII[pad], _SIGN[pad], _GAP[pad], _TAIL[pad]
    here = letter[:-3]
    two, three = pad[:-3] == pad[1:-2], pad[1:-2] == pad[2:-1]
    found = [
        (2, sign[:-3] & letter[1:-2]),
        (3, here & sign[1:-2] & (letter | tail)[2:-1]),
        (3, here & two & three),
        (4, here & gap[1:-2] & letter[2:-1] & gap[3:]),
    ]
    size = end - start
    flagged = np.zeros(len(start), bool)
    for n, mark in found:
        at = np.flatnonzero(mark)
        owner = np.searchsorted(start, at, side="right") - 1
        at, owner = at[owner >= 0], owner[owner >= 0]
        # What lies beyond a word's end belongs to another word or text.
        flagged[owner[at + n <= end[owner]]] = True
    # Words of one character, four or more in a row, are one unit.
    one = (size == 1) & (_ASCII | _SIGN)[data[start]]
    text = per_text(counts)
    near = np.zeros(len(start), bool)
    near[1:] = one[1:] & one[:-1] & (start[1:] == end[:-1] + 1) & (text[1:] == text[:-1])
    run = np.cumsum(~near) - 1
    first = np.flatnonzero(~near)
    length = np.bincount(run)
    last = first + length - 1
    unit = flagged[first] | (one[first] & (length >= 4))
    return start[first[unit]], end[last[unit]]


def restored(data: np.ndarray, offsets: np.ndarray, model: Characters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased texts with their disguised units restored, their offsets, and the number of units changed."""
    data = _LOWER[data]
    start, end = disguised(data, offsets)
    n = len(offsets) - 1
    if not len(start):
        return data, offsets, np.zeros(n, np.int64)
    raw = data.tobytes()
    parts, at, grown, changed = [], 0, [], []
    for s, e in zip(start.tolist(), end.tolist()):
        old = raw[s:e]
        new = model.restore(old)
        parts += (raw[at:s], new)
        at = e
        grown.append(len(new) - len(old))
        # Other words than the letters alone make; signs that merely end words do not count.
        changed.append(new.split() != bytes(c if _LETTER[c] else 32 for c in old).split())
    parts.append(raw[at:])
    owner = np.searchsorted(offsets, start, side="right") - 1
    more = np.bincount(owner, weights=grown, minlength=n).astype(np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), offsets + np.concatenate([[0], np.cumsum(more)]), np.bincount(owner, weights=changed, minlength=n).astype(np.int64)


def marks(data: np.ndarray, offsets: np.ndarray, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """Text and 64-bit hash of every whole word and word beginning, repeats included."""
    # Whatever is no letter ends a word.
    letters = np.where(_LETTER[data], data, 32).astype(np.uint8)
    start, end, counts = word_spans(letters, offsets)
    owner = per_text(counts)
    sums = rolling.sums(letters)
    whole = rolling.ranges(sums, start, end)
    texts, hashes = [owner], [whole]
    for k in BEGINNINGS:
        long = end - start > k
        texts.append(owner[long])
        # A beginning differs from the whole word of the same bytes.
        hashes.append(rolling.ranges(sums, start[long], start[long] + k) + np.uint64(k))
    return np.concatenate(texts), np.concatenate(hashes)


class Known:
    """Membership of hashes in a small set: a bitmap first, the sorted set for what passes it."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.sort(hashes.astype(np.uint64))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``hashes`` that are known, and their numbers in the sorted set."""
        if not len(self.sorted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        bit = np.zeros(1 << 20, bool)
        bit[(self.sorted & np.uint64(0xFFFFF)).astype(np.int64)] = True
        maybe = np.flatnonzero(bit[(hashes & np.uint64(0xFFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.sorted, hashes[maybe]), len(self.sorted) - 1)
        same = self.sorted[at] == hashes[maybe]
        return maybe[same], at[same]


def present(data: np.ndarray, offsets: np.ndarray, rolling: Rolling, known: Known) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, number of known feature)."""
    text, h = marks(data, offsets, rolling)
    place, number = known.find(h)
    code = np.unique(text[place] * max(len(known.sorted), 1) + number)
    return code // max(len(known.sorted), 1), code % max(len(known.sorted), 1)


def fit(rows: list[np.ndarray], toxic: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic model on presence, with a ridge, by Newton's steps on the features that occur."""
    x = np.zeros((len(rows), n + 1), np.float32)
    x[:, n] = 1
    for i, r in enumerate(rows):
        x[i, r] = 1
    y = toxic.astype(float)
    w = np.zeros(n + 1)
    ridge = np.full(n + 1, RIDGE)
    ridge[n] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None].astype(np.float32)).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:n], float(w[n])


def character_model(df: DataFrame, text: str = "text") -> Characters:
    """From the trigram counts of all texts; one partial table per task, one row per trigram to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(KINDS**3, np.int64)
        for b in by_bytes(batches, 0):
            counts += trigrams(*text_bytes(b.column(0)))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["gram", "n"])

    rows = df.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(KINDS**3, np.int64)
    for r in rows:
        counts[r["gram"]] = r["n"]
    return Characters(counts)


def labelled_sample(df: DataFrame, labels: DataFrame, text: str, key: str) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic) of at most SAMPLE labelled texts of each class, and how many labels each class has."""
    known = labels.select(F.col(key).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT)).distinct()
    known = cut(known, "open-labels")
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30))
    part = None
    for c in n:
        # A little more than wanted by threshold, then exactly: the driver sees no more than that.
        some = known.where(F.col("toxic") == c).withColumn("_draw", draw).where(F.col("_draw") < min(1.0, 1.2 * SAMPLE / n[c]) * (1 << 30))
        some = some.orderBy("_draw", "doc_id").limit(SAMPLE).select("doc_id", "toxic")
        part = some if part is None else part.unionByName(some)
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if part is None:
        part = known
    # At most 2 * SAMPLE ids: a proven bound.
    return cut(docs.join(F.broadcast(part), "doc_id").select("text", "toxic"), "labelled"), n


class Model:
    """Character model, known features and their weights; about a megabyte, sent with the task."""

    def __init__(self, characters: Characters, known: Known, weights: np.ndarray, offset: float):
        self.characters, self.known, self.weights, self.offset = characters, known, weights, offset

    def score(self, column: pa.Array, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
        data, offsets, changed = restored(*text_bytes(column), self.characters)
        owner, number = present(data, offsets, rolling, self.known)
        z = self.offset + np.bincount(owner, weights=self.weights[number], minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500))), changed


def learn(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Model:
    characters = character_model(df, text)
    sample, n = labelled_sample(df, labels, text, key)
    rolling = Rolling(13)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 0):
            data, offsets, _ = restored(*text_bytes(b.column(0)), characters)
            owner, h = marks(data, offsets, rolling)
            order = np.lexsort((owner, h))
            owner, h = owner[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            hs, at = np.unique(h[new], return_inverse=True)
            y = b.column(1).to_numpy(zero_copy_only=False)[owner[new]]
            sums = [np.bincount(at, weights=y == c, minlength=len(hs)).astype(np.int64) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(hs.view(np.int64)), *map(pa.array, sums)], names=["h", "n0", "n1"])

    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        share = n.get(1, 0) / max(1, sum(n.values()))
        return Model(characters, Known(np.zeros(0, np.uint64)), np.zeros(0), float(np.log(max(share, 1e-12) / max(1 - share, 1e-12))))
    got = sample.select("text", "toxic").mapInArrow(count, "h long, n0 long, n1 long").groupBy("h").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))

    def cell(o, row, col):
        return F.when(o > 0, o * F.log(o * (n0 + n1) / (row * col))).otherwise(0.0)

    a, b = F.col("n1"), F.col("n0")
    # Likelihood ratio of the two by two table, of features that toxic texts have more often.
    g = cell(a, a + b, n1) + cell(b, a + b, n0) + cell(n1 - a, n0 + n1 - a - b, n1) + cell(n0 - b, n0 + n1 - a - b, n0)
    got = got.where((a >= SUPPORT) & (a / n1 > b / n0)).withColumn("g", g).orderBy(F.desc("g"), "h").limit(FEATURES).select("h").collect()
    known = Known(np.array([r["h"] for r in got], np.int64).view(np.uint64))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 0):
            data, offsets, _ = restored(*text_bytes(b.column(0)), characters)
            owner, number = present(data, offsets, rolling, known)
            at = np.searchsorted(owner, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.ListArray.from_arrays(pa.array(at), pa.array(number, pa.int32()))], names=["toxic", "x"])

    told = sample.select("text", "toxic").mapInArrow(rows, "toxic int, x array<int>").collect()
    # In an order of its own, so that sums do not depend on how rows arrive.
    told = sorted((r["toxic"], tuple(r["x"])) for r in told)
    weights, offset = fit([np.array(x, np.int64) for _, x in told], np.array([y for y, _ in told]), len(known.sorted))
    # The sample may hold another share of toxic texts than the labels do.
    return Model(characters, known, weights, offset - np.log((n1 / n[1]) / (n0 / n[0])))


def detect(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (doc_id, held_out, score, predicted, n_restored), one for each row of ``df``; ``labels`` has the key and ``toxic``."""
    model = learn(df, labels, text, key)
    rolling = Rolling(13)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches):
            score, changed = model.score(b.column(1), rolling)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array(changed)], names=["doc_id", "score", "n_restored"])

    scored = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, n_restored long")
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_restored")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
