"""Quality classifier by positive-unlabelled learning.

Labels of trusted good texts are the positives; the unlabelled texts are drawn from all texts, their
labels unread, and are a mix whose share of positives is the class prior. A small network
minimises the non-negative unbiased risk

    prior * E_pos[loss(f, +)] + max(0, E_unl[loss(f, -)] - prior * E_pos[loss(f, -)])

where, when the second term would turn negative, a step is taken against it instead, so it cannot
be driven below zero by fitting the positives too closely. Inputs are figures of the text alone:
kinds of characters, words, repetition.

The prior is estimated from positives and unlabelled texts alone: a first network ranks them, and as
the unlabelled texts above any score hold at least the prior's share of the positives above it, the
lowest ratio of both tails bounds the prior (on texts that the first network did not see). Negative labels are never read. Fitting uses at most ``SAMPLE`` positives and ``SAMPLE`` unlabelled texts, drawn by hash; all
texts are measured and scored.

Defined cases: null and empty texts are scored like any other by their (zero) figures; repeated
rows get equal scores; a label table with repeated ids counts each row; without any positive outside the
held-out fold every score is zero (one half without any label); an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .common import Rolling, documents, fold, map_batches, mix64, per_text, text_bytes, totals, word_spans
from .quality_rules import COVERAGE, _later, statistics

FOLDS, HELD_OUT = 3, 1
# Most positives, and most unlabelled texts, that a fit reads.
SAMPLE = 20_000
# Share of the positives that a tail has at least when the prior is estimated.
TAIL = 0.05
HIDDEN = 24
STEPS = 1500
BATCH = 2048
RATE = 3e-3
DECAY = 1e-4
SEED = 0

# Kinds of bytes whose shares are inputs.
KINDS = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": bytes(range(48, 58)),
    "newline": b"\n",
    "exclaim": b"!",
    "bar": b"|",
    "symbol": b"#*$%&<>^~_=+/\\{}[]@",
    "stop": b".,;:?",
    "other": bytes(range(128, 256)),
}


def figures(data: np.ndarray, offsets: np.ndarray, rolling: Rolling) -> np.ndarray:
    """Inputs of the network, one row per text."""
    n = len(offsets) - 1
    s = statistics(data, offsets, rolling)
    start, end, n_words = word_spans(data, offsets)
    owner = per_text(n_words)
    size = np.maximum(offsets[1:] - offsets[:-1], 1)
    words = np.maximum(n_words, 1)
    out = []
    for kind in KINDS.values():
        flag = np.zeros(256, np.int64)
        flag[list(kind)] = 1
        run = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flag[data], out=run[1:])
        out.append((run[offsets[1:]] - run[offsets[:-1]]) / size)
    hashes = rolling.ranges(rolling.sums(data), start, end)
    same = np.zeros(len(hashes), bool)
    if len(hashes):
        same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    again = _later(mix64(hashes) ^ mix64(owner.astype(np.uint64) + np.uint64(1)))
    big = np.zeros(256, bool)
    big[65:91] = True
    caps = big[data[start]] & big[data[end - 1 - (end - start > 1)]] if len(start) else np.zeros(0, bool)
    out += [totals(same, owner, n) / words, totals(again, owner, n) / words, totals(caps, owner, n) / words]
    out += [np.log1p(n_words), s["word_chars"] / words, s["n_symbols"] / words, s["cover_lines"]]
    out += [s[f"cover_{k}"] for k in COVERAGE]
    return np.stack(out, axis=1)


def measure(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (doc_id, x): the figures of every text."""
    rolling = Rolling(2)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        x = figures(*text_bytes(b.column(1)), rolling)
        flat = pa.array(x.astype(np.float32).ravel())
        off = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
        return pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(off, flat)], names=["doc_id", "x"])

    return map_batches(df, [F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")], one, "doc_id long, x array<float>")


class Network:
    """One hidden layer; a few thousand numbers, sent with the task."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, rng: np.random.Generator):
        d = len(mean)
        self.mean, self.scale = mean, scale
        self.p = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(z @ self.p[0] + self.p[1])
        return h @ self.p[2] + self.p[3][0], h

    def backward(self, z: np.ndarray, h: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        """Gradients for the derivative ``g`` of the risk by the outputs."""
        dh = g[:, None] * self.p[2][None, :] * (1 - h * h)
        return [z.T @ dh, dh.sum(axis=0), h.T @ g, np.array([g.sum()])]

    def score(self, x: np.ndarray) -> np.ndarray:
        f = self.forward(self.inputs(x))[0]
        return 1 / (1 + np.exp(-np.clip(f, -500, 500)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Network:
    """Minimises the non-negative risk with the logistic loss, by Adam."""
    rng = np.random.default_rng(SEED)
    every = np.concatenate([positive, unlabelled])
    net = Network(every.mean(axis=0), every.std(axis=0) + 1e-6, rng)
    pos, unl = net.inputs(positive), net.inputs(unlabelled)
    m, v = [np.zeros_like(w) for w in net.p], [np.zeros_like(w) for w in net.p]
    sig = lambda f: 1 / (1 + np.exp(-np.clip(f, -500, 500)))
    for t in range(1, STEPS + 1):
        zp, zu = (a[rng.integers(len(a), size=min(BATCH, len(a)))] for a in (pos, unl))
        (fp, hp), (fu, hu) = net.forward(zp), net.forward(zu)
        # Derivatives of the logistic loss: -sigma(-f) for a positive target, sigma(f) for a negative one.
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        gp, gu = sig(fp) / len(fp), sig(fu) / len(fu)
        if negative >= 0:
            by_p, by_u = -prior * sig(-fp) / len(fp) - prior * gp, gu
        else:
            by_p, by_u = prior * gp, -gu
        grads = [a + b for a, b in zip(net.backward(zp, hp, by_p), net.backward(zu, hu, by_u))]
        for i, g in enumerate(grads):
            g = g + DECAY * net.p[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            net.p[i] = net.p[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return net


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among ``unlabelled``: the lowest ratio of score tails, unlabelled to positive.

    Of each sample every other row fits the ranking and the rest is compared. The tail is chosen by
    the upper limit of its ratio (both shares a standard error apart), and only where TAIL of the
    positives lie above, so that thin tails do not give low ratios by chance; its plain ratio is
    the estimate.
    """
    ranked = fit(positive[::2], unlabelled[::2], 0.5)
    p, u = (np.sort(ranked.score(x[1::2] if len(x) > 1 else x)) for x in (positive, unlabelled))
    at = np.unique(p[: max(1, int(len(p) * (1 - TAIL)))])
    tail = lambda x: 1 - np.searchsorted(x, at) / len(x)
    error = lambda share, x: np.sqrt(share * (1 - share) / len(x))
    tp, tu = tail(p), tail(u)
    least = np.maximum(tp - error(tp, p), 1e-9)
    best = ((tu + error(tu, u)) / least).argmin()
    return float(np.clip(tu[best] / tp[best], 0.01, 0.99))


def _sample(df: DataFrame, size: int | None = None) -> np.ndarray:
    """At most ``size`` (SAMPLE) rows' figures, those with the smallest hashes.

    A bound on the hash leaves few more than those, so no task sorts or sends more than its
    part of them; it grows until enough rows lie below it.
    """
    size = SAMPLE if size is None else size
    rows = df.withColumn("h", F.xxhash64("doc_id", F.lit(SEED)))
    share = min(1.0, (size + 6 * size**0.5 + 6) / max(rows.count(), 1))
    while True:
        low = rows if share >= 1 else rows.where(F.col("h") < int(-(2**63) + share * 2**64))
        if share >= 1 or low.count() >= size:
            break
        share = min(1.0, share * 2)
    got = low.orderBy("h", "doc_id").limit(size).select("x").collect()
    return np.array([r["x"] for r in got], float)


def classify(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of ``df``; ``labels`` has (doc_id, quality)."""
    x = cut(measure(df, text, key), "figures")
    open_ = fold("doc_id", FOLDS) != HELD_OUT
    known = labels.select(F.col(key).cast("long").alias("doc_id"), "quality").where(open_ & F.col("quality").isNotNull())
    learn = x.where(open_)
    positive = _sample(learn.join(known.where("quality = 1").select("doc_id"), "doc_id", "left_semi"))
    unlabelled = _sample(learn)
    net = fit(positive, unlabelled, class_prior(positive, unlabelled)) if len(positive) else None
    default = 0.5 if known.isEmpty() else 0.0

    def run(batches):
        for b in batches:
            lists = b.column(1)
            n = b.num_rows
            v = lists.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(float) if n else np.zeros((0, 1))
            s = net.score(v) if net is not None else np.full(n, default)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    scored = x.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
