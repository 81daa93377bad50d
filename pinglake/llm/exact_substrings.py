"""Removal of repeated passages: every byte in a 100-byte string that also starts earlier goes.

Candidates come from anchors. In each 100-byte window the 32-byte string with the smallest hash
(the leftmost on ties) is its anchor; equal windows have equal anchors at equal places, so windows
need comparing only with windows of an equal anchor. The windows of one anchor are a run, and the
bytes they cover its context, of 200 bytes at most. Anchors that occur once are settled. Equal
contexts are folded into their first occurrence, the others being copies of it. The distinct
contexts of an anchor are cut to windows whose hash another one has and sorted together in a suffix
array (see suffix_array): windows that stand next to each other there and have 100 bytes in common
are one string, and all but its first occurrence are repeats. An anchor with more distinct contexts
than a task should hold, as at the edges of a passage that stands in a great many texts, is dealt
out again window by window, since equal windows are then equal contexts.

Work is shuffled by anchor, never by passage or text group, with counts taken before. Bitmaps of
fixed size spare rows and texts that cannot matter the shuffle; the joins after them are exact, so
the bitmaps never change a result.

Defined cases: null and empty texts have no bytes and keep the empty string; texts under 100 bytes
are kept whole; order is by doc_id (null first), then by a hash of the text, then by place; rows
equal in id and text count as one document and get equal results; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .common import Rolling, documents, text_bytes, texts
from .suffix_array import suffix_array

LENGTH = 100
ANCHOR = 32
SPAN = LENGTH - ANCHOR + 1  # places an anchor can have in a window
# Distinct contexts of one anchor that are sorted together, 6 MB at most; those of greater anchors
# go by window.
TOGETHER = 1 << 15
# Bytes of contexts that are narrowed and sorted together, about: several anchors share a block.
BLOCK = 1 << 18
# Size of the bitmaps: 2 MB whatever the corpus.
BITS = 1 << 24


def _keyed(df: DataFrame, text: str, key: str) -> DataFrame:
    """Columns d (the id, null lowest), t (the text's hash), k (of both), text."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(t).alias("t"), t.alias("text"))
    return keyed.withColumn("k", F.xxhash64("d", "t"))


def _least(hashes: np.ndarray) -> np.ndarray:
    """Place of the smallest of each SPAN neighbouring hashes, the leftmost on ties of their upper bits."""
    low = np.uint64((1 << 21) - 1)
    keys = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    n = len(keys) - SPAN + 1
    padded = np.full(-(-len(keys) // SPAN) * SPAN, ~np.uint64(0))
    padded[: len(keys)] = keys
    rows = padded.reshape(-1, SPAN)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[SPAN - 1 : SPAN - 1 + n]) & low).astype(np.int64)


class Anchors:
    def __init__(self) -> None:
        self.one, self.two = Rolling(21), Rolling(22)

    def of(self, data: np.ndarray) -> tuple[np.ndarray, ...]:
        """(anchor hash, context hash, start, windows) of every anchor of a text."""
        parts = []
        step = 1 << 20
        for at in range(0, max(len(data) - LENGTH + 1, 0), step):
            parts.append(self._part(data[at : at + step + LENGTH - 1], at))
        if not parts:
            z = np.zeros(0, np.int64)
            return z, z, z, z
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _part(self, data: np.ndarray, shift: int) -> tuple[np.ndarray, ...]:
        sums = self.one.sums(data)
        at = np.arange(len(data) - ANCHOR + 1)
        hashes = self.one.ranges(sums, at, at + ANCHOR)
        place = _least(hashes)
        start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        windows = np.diff(np.r_[start, len(place)])
        context = self.two.ranges(self.two.sums(data), start, start + windows - 1 + LENGTH)
        return hashes[place[start]].view(np.int64), context.view(np.int64), start + shift, windows


def _is_in(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    i = keys.view(np.uint64) & np.uint64(BITS - 1)
    return (words[(i >> np.uint64(6)).astype(np.int64)] >> (i & np.uint64(63))) & np.uint64(1) == 1


def _bitmap(df: DataFrame, key: str):
    """A broadcast bitmap of the low bits of a hash column, built by the executors."""
    low = F.col(key).bitwiseAND(F.lit(BITS - 1))
    bits = df.select(low.alias("b")).select(F.shiftright("b", 6).alias("word"), F.expr("shiftleft(1L, cast(b & 63 AS int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = bits.toArrow()  # BITS / 64 rows at most
    words = np.zeros(BITS // 64, np.uint64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return df.sparkSession.sparkContext.broadcast(words)


def _only(df: DataFrame, sent, wanted: bool) -> DataFrame:
    """The rows whose column k is, or is not, in a bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("k")
        for b in batches:
            yield b.filter(pa.array(_is_in(sent.value, b.column(at).to_numpy()) == wanted))

    names = df.columns
    return df.mapInArrow(run, df.schema)


def _hashes(docs: DataFrame) -> DataFrame:
    anchors = Anchors()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                data, off = text_bytes(b.column(0).slice(lo, 500))
                found = [anchors.of(data[x:y])[0] for x, y in zip(off, off[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["h"])

    return docs.select("text").mapInArrow(run, "h long")


def _places(docs: DataFrame, sent) -> DataFrame:
    """(h, c, d, t, p) of the anchors that a bitmap lets pass; p packs the start and, in 7 bits, the number of windows."""
    anchors = Anchors()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                data, off = text_bytes(b.column(2).slice(lo, 500))
                ds, ts = b.column(0).slice(lo, 500).to_numpy(), b.column(1).slice(lo, 500).to_numpy()
                out: list[list[np.ndarray]] = [[], [], [], [], []]
                for i in range(len(ds)):
                    h, c, start, windows = anchors.of(data[off[i] : off[i + 1]])
                    use = _is_in(sent.value, h)
                    p = (start[use] << 7) | windows[use]
                    for to, x in zip(out, (h[use], c[use], np.full(use.sum(), ds[i]), np.full(use.sum(), ts[i]), p)):
                        to.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], names=["h", "c", "d", "t", "p"])

    return docs.select("d", "t", "text").mapInArrow(run, "h long, c long, d long, t long, p long")


def _start(p: Column) -> Column:
    return F.shiftright(p, 7)


def _windows(p: Column) -> Column:
    return p.bitwiseAND(F.lit(127))


def repeats(contexts: list[tuple[tuple[int, int, int], bytes]]) -> list[tuple[int, int, int]]:
    """Windows that some window at a smaller place equals, as (d, t, start).

    ``contexts`` are (place of the first byte, bytes); one suffix array over all of them decides.
    """
    text = b"\0".join(c for _, c in contexts)
    owner: list[int] = []
    begin: list[int] = []
    at = 0
    for i, (_, c) in enumerate(contexts):
        begin.append(at)
        # Starts from which a whole window fits into the context.
        owner += [i] * (len(c) - LENGTH + 1) + [-1] * (min(LENGTH, len(c) + 1))
        at += len(c) + 1
    out = []
    same: list[tuple[int, int, int]] = []
    last = b""

    def close() -> None:
        if len(same) > 1:
            first = min(same)
            out.extend(x for x in same if x != first)

    for s in suffix_array(text):
        i = owner[s]
        if i < 0:
            continue
        window = text[s : s + LENGTH]
        if window != last:
            close()
            same, last = [], window
        d, t, start = contexts[i][0]
        same.append((d, t, start + s - begin[i]))
    close()
    return out


def _spans(starts: list[tuple[int, int, int]]) -> pa.RecordBatch:
    """Window starts merged to runs (d, t, lo, hi)."""
    ds, ts, lo, hi = [], [], [], []
    for d, t, s in sorted(set(starts)):
        if ds and ds[-1] == d and ts[-1] == t and s <= hi[-1]:
            hi[-1] = s + LENGTH
        else:
            ds.append(d)
            ts.append(t)
            lo.append(s)
            hi.append(s + LENGTH)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ds, ts, lo, hi)], names=["d", "t", "lo", "hi"])


_SPAN_SCHEMA = "d long, t long, lo long, hi long"


def _narrowed(contexts: list[tuple[tuple[int, int, int], bytes]], rolling: Rolling) -> tuple[list[tuple[tuple[int, int, int], bytes]], list[tuple[int, int, int]]]:
    """Contexts cut to runs of windows whose hash another window has, and window starts that are copies already.

    Runs with the same bytes are folded into the one at the smallest place; the windows of the
    others are repeats. Windows left out have a hash of their own, so nothing equals them.
    """
    data = np.frombuffer(b"".join(c for _, c in contexts), np.uint8)
    size = np.array([len(c) for _, c in contexts])
    begin = np.cumsum(size) - size
    n = size - LENGTH + 1
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[owner]
    keys = rolling.ranges(rolling.sums(data), at, at + LENGTH)
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    hit = np.zeros(len(keys), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    i = np.flatnonzero(hit)
    if not len(i):
        return [], []
    cut_ = np.flatnonzero(np.r_[True, (i[1:] != i[:-1] + 1) | (owner[i[1:]] != owner[i[:-1]])])
    folded: dict[bytes, tuple[int, int, int]] = {}
    copies: list[tuple[int, int, int]] = []
    for lo, hi in zip(i[cut_].tolist(), i[np.r_[cut_[1:], len(i)] - 1].tolist()):
        (d, t, s), c = contexts[owner[lo]]
        o, z = int(at[lo] - begin[owner[lo]]), int(at[hi] - begin[owner[lo]]) + LENGTH
        place, run = (d, t, s + o), c[o:z]
        first = folded.get(run)
        if first is None:
            folded[run] = place
            continue
        if place < first:
            folded[run], place = place, first
        copies += [(place[0], place[1], place[2] + k) for k in range(len(run) - LENGTH + 1)]
    return [(place, run) for run, place in folded.items()], copies


def _by_suffix_array(contexts: DataFrame) -> DataFrame:
    """Repeated windows among the contexts (h, d, t, start, bytes) of each anchor."""
    rolling = Rolling(25)

    def solved(held: list) -> pa.RecordBatch:
        runs, copies = _narrowed(held, rolling)
        return _spans(copies + (repeats(runs) if runs else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size, anchor = 0, None
        for b in batches:
            for h, d, t, s, c in zip(*(b.column(i).to_pylist() for i in range(5))):
                if h != anchor:
                    anchor = h
                    if size >= BLOCK:
                        yield solved(held)
                        held, size = [], 0
                held.append(((d, t, s), c))
                size += len(c)
        if held:
            yield solved(held)

    # Contexts of one anchor are next to each other, TOGETHER at most.
    dealt = contexts.repartition("h").sortWithinPartitions("h", "d", "t", "start")
    return dealt.select("h", "d", "t", "start", "bytes").mapInArrow(run, _SPAN_SCHEMA)


def _by_window(contexts: DataFrame) -> DataFrame:
    """The same for anchors with very many contexts: one row per window, keyed by 128 bits of hash."""
    one, two = Rolling(23), Rolling(24)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                data, off = text_bytes(part.column(3))
                n = np.maximum(np.diff(off) - LENGTH + 1, 0)
                owner = np.repeat(np.arange(len(n)), n)
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = off[:-1][owner] + inner
                w = [r.ranges(r.sums(data), at, at + LENGTH).view(np.int64) for r in (one, two)]
                d, t, s = (part.column(i).to_numpy()[owner] for i in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*w, d, t, s + inner)], names=["w", "v", "d", "t", "lo"])

    rows = contexts.select("d", "t", "start", "bytes").mapInArrow(run, "w long, v long, d long, t long, lo long")
    place = F.struct("d", "t", "lo")
    first = rows.groupBy("w", "v").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = rows.join(first, ["w", "v"]).where(place != F.col("first"))
    return again.select("d", "t", "lo", (F.col("lo") + LENGTH).alias("hi"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Spans (d, t, lo, hi) of bytes that repeat an earlier place; spans of a text may overlap."""
    shared = cut(_hashes(docs).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "anchors")
    places = cut(_places(docs, _bitmap(shared, "h")).join(shared, "h", "left_semi"), "places")
    place = F.struct("d", "t", "p")
    folded = cut(places.groupBy("h", "c").agg(F.min(place).alias("first"), F.count("*").alias("n")), "contexts")
    copies = places.join(folded.where("n > 1").select("h", "c", "first"), ["h", "c"]).where(place != F.col("first"))
    p = F.col("p")
    copies = copies.select("d", "t", _start(p).alias("lo"), (_start(p) + _windows(p) + (LENGTH - 1)).alias("hi"))

    several = folded.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    p = F.col("first.p")
    open_ = folded.join(several, "h").select("h", F.col("first.d").alias("d"), F.col("first.t").alias("t"), _start(p).alias("start"), _windows(p).alias("windows"), (F.col("m") > TOGETHER).alias("many"))
    asked = cut(open_.groupBy("d", "t").agg(F.collect_list(F.struct("h", "start", "windows", "many")).alias("asked")), "asked")
    texts_of = _only(docs.select("d", "t", "k", "text"), _bitmap(asked.select(F.xxhash64("d", "t").alias("k")), "k"), True)
    # Rows equal in id and text are one document.
    there = texts_of.join(asked, ["d", "t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text = b.column(2).slice(i, 1).cast(pa.large_binary())[0].as_py()
                a = b.column(3).slice(i, 1).flatten()
                start, windows = a.field("start").to_numpy(), a.field("windows").to_numpy()
                made = [text[s : s + w - 1 + LENGTH] for s, w in zip(start.tolist(), windows.tolist())]
                n = len(made)
                d, t = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [a.field("h"), pa.array([d] * n, pa.int64()), pa.array([t] * n, pa.int64()), a.field("start"), a.field("many"), pa.array(made, pa.binary())],
                    names=["h", "d", "t", "start", "many", "bytes"],
                )

    contexts = there.select("d", "t", "text", "asked").mapInArrow(run, "h long, d long, t long, start long, many boolean, bytes binary")
    contexts = cut(contexts, "context-bytes")
    return copies.unionByName(_by_suffix_array(contexts.where(~F.col("many")).dropDuplicates(["h", "d", "t", "start"]))).unionByName(_by_window(contexts.where("many")))


def _removed(n: int, spans: np.ndarray) -> np.ndarray:
    """Mask of the bytes within spans (lo, hi)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, spans[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def remove(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept): ``kept`` are the remaining bytes, concatenated."""
    docs = _keyed(df, text, key)
    spans = repeated_spans(docs).groupBy("d", "t").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    spans = cut(spans, "spans")
    sent = _bitmap(spans.select(F.xxhash64("d", "t").alias("k")), "k")
    clean = _only(docs, sent, False).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("text").cast("binary").alias("kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                ns, removed, runs, kept = [], [], [], []
                for raw, found in zip(texts(part.column(1)), part.column(2)):
                    n = len(raw)
                    gone = np.zeros(n, bool)
                    if found.is_valid:
                        v = found.values
                        gone = _removed(n, np.stack([v.field("lo").to_numpy(), v.field("hi").to_numpy()], axis=1))
                    ns.append(n)
                    removed.append(int(gone.sum()))
                    runs.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                    kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (ns, removed, runs)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    touched = _only(docs, sent, True).join(spans, ["d", "t"], "left")
    touched = touched.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return clean.unionByName(touched)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
