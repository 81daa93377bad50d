"""Language-model scores from a hashed maximum-entropy model with class-factored softmax.

P(word | history) = P(class | history) * P(group | class, history) * P(word | group). Words fall into
classes by their ending, and within a class into groups by their hash. Class and group are each
predicted by a softmax over hashed features of the history: the word before (bigram), the two
before (trigram), the word two back and the word three back (skips), each a row of a weight table
of fixed size; the rows for groups are hashed with the class, so history acts on words within
their class. The few words of a group follow the training counts plus one, with one place per
group for words never seen, so probabilities of all words sum to one.

Training reads all texts once, a quarter of them in each of four rounds. In a round every task
starts from the same weights, makes gradient steps over its own texts, and each weight's changes
are averaged over the tasks that touched it, by how often they did, in two levels so that no task
sums up all of them. The counts of words travel packed: a batch's words, sorted by hash, are cut
into slices of the hash; a slice of all batches is counted in one place, which answers each batch
with the counts of its own words. Scoring runs in numpy over batches of sparse feature indices.
Gradient steps follow the batches, so scores (not base scores) depend on how the table's rows are
laid out in files.

Defined cases: null and empty texts have the end token alone; texts of any length are scored whole;
repeated rows are scored and learned from as often as they occur; null ids fall into the fold of
the empty text; without any training text all counts are 0; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from .common import documents, in_fold, mix64, text_bytes, texts

CLASSES = 64
GROUPS = 32  # of a class
# Rows of each hashed weight table: 6 MB in half precision for both.
ROWS = 1 << 15
FEATURES = 4
ROUNDS = 4
RATE = 0.3
STEP = 4096  # tokens per gradient step
PIECE = 1024  # tokens whose classes are worked out together
BATCH_TEXTS, BATCH_TOKENS = 2000, 1 << 20
FOLDS, HELD_OUT = 7, 2
# The end of a text as a word; real words hold no white space.
END = "\n"
CHUNKS = 16  # parts of a weight table that are averaged apart
# Tokens that a task of a round should have at least, so that its changes are small beside its texts.
TASK_TOKENS = 2_000_000
# Words of batches that a slice of the hash has, about.
SLICE_WORDS = 1 << 20
# Batches that are counted together; more are counted in parts, as each may have the same frequent words.
PART_BATCHES = 1 << 17


def class_of(word: str) -> int:
    """0 for the end, else by the last two letters."""
    return 0 if word == END else 1 + zlib.crc32(word[-2:].encode()) % (CLASSES - 1)


def classes_of(names: list[bytes]) -> np.ndarray:
    """``class_of`` each word; plain last letters, of which there are few, are looked at once."""
    seen: dict[bytes, int] = {}
    out = np.empty(len(names), np.uint8)
    for i, x in enumerate(names):
        tail = x[-2:]
        c = seen.get(tail)
        if c is None:
            c = class_of(x.decode())
            if tail.isascii():
                seen[tail] = c
        out[i] = c
    return out


# Texts to batches of word numbers ----------------------------------------------------------------

# Words are told apart by 64-bit hashes (keys), ascending and without sign; tokens are places in the batch's list of keys.
_BATCH = "batch long, ids array<long>, train array<boolean>, lengths array<int>, words int, tokens binary, keys binary, classes binary, counts binary"


def _encode(ids: list, raw: list[bytes]) -> dict:
    words = [x.lower().split() for x in raw]
    flat: list[bytes] = []
    for w in words:
        flat += w
        flat.append(END.encode())
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    coded = pa.array(flat, pa.large_binary()).dictionary_encode()
    tokens = coded.indices.to_numpy()
    names = coded.dictionary.to_pylist()
    keys = np.fromiter((xxhash.xxh64_intdigest(x) for x in names), np.uint64, len(names))
    order = np.argsort(keys)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    tokens = place[tokens]
    train = np.array([in_fold(i, FOLDS) != HELD_OUT for i in ids], bool)
    counts = np.bincount(tokens[np.repeat(train, lengths)], minlength=len(names))
    return {
        "ids": ids,
        "train": train.tolist(),
        "lengths": lengths.tolist(),
        "words": len(names),
        "tokens": tokens.astype("<u2" if len(names) <= 1 << 16 else "<u4").tobytes(),
        "keys": keys[order].tobytes(),
        "classes": classes_of(names)[order].tobytes(),
        "counts": counts.astype("<u4").tobytes(),
    }


def batches(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows of up to some thousand texts: their words as numbers into the batch's own word list."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(_BATCH))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in parts:
            ids, raw = b.column(0).to_pylist(), texts(b.column(1))
            lo = 0
            while lo < len(ids):
                hi, size = lo, 0
                # A word and the space after it take about six bytes.
                while hi < len(ids) and hi - lo < BATCH_TEXTS and (hi == lo or size + len(raw[hi]) // 6 < BATCH_TOKENS):
                    size += len(raw[hi]) // 6
                    hi += 1
                row = _encode(ids[lo:hi], raw[lo:hi])
                # Stored before use, so the number need only be unique in the attempt that is kept.
                row["batch"] = (TaskContext.get().partitionId() << 32) + n
                n += 1
                lo = hi
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, _BATCH)


# Counts of words ---------------------------------------------------------------------------------


def group_of(keys: np.ndarray) -> np.ndarray:
    """Group within its class of each word."""
    return (mix64(keys ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(GROUPS)).astype(np.int64)


def _packed(raw: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Pieces of an array between ``edges`` as binary values."""
    size = raw.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * size).astype(np.int32)), pa.py_buffer(raw.tobytes())])


def _unpack(raw, n: int) -> np.ndarray:
    """``n`` counts of four or eight bytes each."""
    return np.frombuffer(raw, "<u4" if len(raw) == 4 * n else "<u8").astype(np.int64)


def _small(counts: np.ndarray) -> np.ndarray:
    return counts.astype("<u4" if counts.max(initial=0) < 1 << 32 else "<u8")


_CELLS = pa.list_(pa.struct([("cell", pa.int32()), ("n", pa.int64()), ("v", pa.int64())]))
_ASKED = "batch long, slice int, part int, keys binary, classes binary, counts binary"
_COUNTED = "batch long, slice int, n int, counts binary, cells array<struct<cell:int,n:long,v:long>>"


def asked(stored: DataFrame, bits: int, parts: int) -> DataFrame:
    """A row per batch and slice of the hash: the batch's words there, their classes and the batch's own counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                batch = b.column("batch")[i].as_py()
                keys, classes, counts = (np.frombuffer(b.column(c)[i].as_py(), t) for c, t in (("keys", "<u8"), ("classes", "u1"), ("counts", "<u4")))
                at = (keys >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)
                edges = np.r_[0, np.flatnonzero(at[1:] != at[:-1]) + 1, len(keys)]
                n = len(edges) - 1
                values = [pa.array(np.full(n, batch)), pa.array(at[edges[:-1]]), b.column("part").slice(i, 1).take(pa.array(np.zeros(n, np.int32)))]
                yield pa.RecordBatch.from_arrays([*values, *(_packed(x, edges) for x in (keys, classes, counts))], names=["batch", "slice", "part", "keys", "classes", "counts"])

    part = F.pmod(F.xxhash64("batch", F.lit(1)), F.lit(parts)).cast("int").alias("part")
    return stored.select("batch", part, "keys", "classes", "counts").mapInArrow(run, _ASKED)


def _summed(t: pa.Table) -> tuple:
    """Distinct keys of a slice, ascending, their classes and counts; the place among them of each key asked for, and the rows' edges."""
    raw, off = text_bytes(t.column("keys"))
    keys = raw.view("<u8")
    counts = np.concatenate([_unpack(x.as_py(), n) for x, n in zip(t.column("counts"), np.diff(off) // 8)])
    one, first, place = np.unique(keys, return_index=True, return_inverse=True)
    total = np.zeros(len(one), np.int64)
    np.add.at(total, place, counts)
    return one, text_bytes(t.column("classes"))[0][first], total, place, off // 8


def _cells(keys: np.ndarray, classes: np.ndarray, total: np.ndarray) -> list[dict]:
    """Tokens and distinct words of each (class, group) in a slice."""
    cell = classes.astype(np.int64) * GROUPS + group_of(keys)
    size = CLASSES * GROUPS
    # Sums of halves keep whole numbers exact.
    n = sum(np.bincount(cell, x, size).astype(np.int64) << k for x, k in ((total & 0xFFFFFFFF, 0), (total >> 32, 32)))
    v = np.bincount(cell[total > 0], minlength=size)
    return [{"cell": c, "n": int(n[c]), "v": int(v[c])} for c in np.flatnonzero(v).tolist()]


def _told(t: pa.Table, edges: np.ndarray, counts: np.ndarray) -> pa.Table:
    """Rows with the counts asked for."""
    n = pa.array(np.diff(edges).astype(np.int32))
    values = [t.column("batch"), t.column("slice"), n, _packed(_small(counts), edges), pa.nulls(len(t), _CELLS)]
    return pa.table(dict(zip(("batch", "slice", "n", "counts", "cells"), values)))


def _own(slice_: int, cells: list[dict]) -> pa.Table:
    """The row of a slice's cells."""
    values = [pa.nulls(1, pa.int64()), pa.array([slice_], pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([cells], _CELLS)]
    return pa.table(dict(zip(("batch", "slice", "n", "counts", "cells"), values)))


def _answer(t: pa.Table) -> pa.Table:
    """The counts of a slice for each batch that asked, and a row without batch for the slice's cells."""
    one, classes, total, place, edges = _summed(t)
    return pa.concat_tables([_told(t, edges, total[place]), _own(t.column("slice")[0].as_py(), _cells(one, classes, total))])


def _total(t: pa.Table) -> pa.Table:
    """One row for all of a slice's rows."""
    one, classes, total, _, _ = _summed(t)
    whole = np.array([0, len(one)])
    values = [pa.array([0], pa.int64()), t.column("slice").combine_chunks().slice(0, 1), t.column("part").combine_chunks().slice(0, 1)]
    values += [_packed(one, whole), _packed(classes, whole), _packed(_small(total), whole)]
    return pa.Table.from_arrays(values, names=["batch", "slice", "part", "keys", "classes", "counts"])


def _look_up(t: pa.Table, totals: pa.Table) -> pa.Table:
    """The counts of a slice for the batches of one part, from the totals; the first part tells the cells."""
    one, classes, total, _, _ = _summed(totals)
    out = []
    if t.num_rows:
        raw, off = text_bytes(t.column("keys"))
        out.append(_told(t, off // 8, total[np.searchsorted(one, raw.view("<u8"))]))
    first = totals.column("part")[0].as_py() == 0
    if first or not out:
        out.append(_own(totals.column("slice")[0].as_py(), _cells(one, classes, total)).slice(0 if first else 1))
    return pa.concat_tables(out)


def count_words(stored: DataFrame) -> DataFrame:
    """Rows (batch, slice, counts): the training counts of the batch's words in that slice; and rows without batch with the cells of each slice."""
    words, batches_ = stored.agg(F.coalesce(F.sum("words"), F.lit(0)), F.count("*")).first()
    bits = min(30, max(0, int(words) // SLICE_WORDS).bit_length())
    parts = -(-batches_ // PART_BATCHES) or 1
    ask = asked(stored, bits, parts)
    if parts == 1:
        return ask.groupBy("slice").applyInArrow(_answer, _COUNTED)
    some = ask.groupBy("slice", "part").applyInArrow(_total, _ASKED)
    # A slice's totals go to every part.
    totals = some.groupBy("slice").applyInArrow(_total, _ASKED).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return ask.groupBy("slice", "part").cogroup(totals.groupBy("slice", "part")).applyInArrow(_look_up, _COUNTED)


# Model -------------------------------------------------------------------------------------------


class Model:
    """Weights of both layers and the counts per group; a few MB whatever the corpus."""

    def __init__(self, tokens: np.ndarray, types: np.ndarray):
        self.tokens, self.types = tokens, types  # training tokens and distinct words, (CLASSES, GROUPS)
        of_class = tokens.sum(axis=1)
        # Fixed: what is likely without history.
        self.bias = [
            np.log((of_class + 1.0) / (of_class.sum() + CLASSES)).astype(np.float32)[None, :],
            np.log((tokens + 1.0) / (of_class + GROUPS)[:, None]).astype(np.float32),
        ]
        self.weights = [np.zeros((ROWS, CLASSES), np.float32), np.zeros((ROWS, GROUPS), np.float32)]


def features(keys: np.ndarray, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of each token's features, (FEATURES, tokens); a text's start has marks of its own."""
    n = len(tokens)
    word = mix64(keys)[tokens]
    place = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)

    def back(k: int) -> np.ndarray:
        out = np.zeros(n, np.uint64)
        out[k:] = word[: max(n - k, 0)]
        out[place < k] = 0
        return out

    one, two, three = back(1), back(2), back(3)
    kinds = [one, one * np.uint64(0x9E3779B97F4A7C15) + two, two, three]
    return np.stack([mix64(k * np.uint64(2 * FEATURES + 1) + np.uint64(i)) for i, k in enumerate(kinds)])


def rows_of(hashes: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two weight tables, (FEATURES, tokens) each; those for groups depend on the class."""
    salt = mix64(classes.astype(np.uint64) + np.uint64(1))
    return (hashes % np.uint64(ROWS)).astype(np.int64), (mix64(hashes ^ salt) % np.uint64(ROWS)).astype(np.int64)


def _pieces(bias: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """What a softmax starts from, less its maximum, for PIECE tokens at a time, which a core's cache holds. The array is used again."""
    n, width = rows.shape[1], weights.shape[1]
    room, more = np.empty((2, min(n, PIECE), width), np.float32)
    for at in range(0, n, PIECE):
        here = slice(at, min(at + PIECE, n))
        z, x = room[: here.stop - at], more[: here.stop - at]
        # All rows are in the table; without "clip" numpy would go by way of a copy.
        weights.take(rows[0, here], axis=0, out=z, mode="clip")
        for r in rows[1:]:
            weights.take(r[here], axis=0, out=x, mode="clip")
            z += x
        z += bias[here] if len(bias) == n else bias
        z -= z.max(axis=1, keepdims=True)
        yield here, z


def softmax(bias: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.empty((rows.shape[1], weights.shape[1]), np.float32)
    for here, z in _pieces(bias, weights, rows):
        p = np.exp(z, out=out[here])
        p /= p.sum(axis=1, keepdims=True)
    return out


def log_softmax(bias: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.empty((rows.shape[1], weights.shape[1]), np.float32)
    for here, z in _pieces(bias, weights, rows):
        np.subtract(z, np.log(np.exp(z).sum(axis=1, keepdims=True)), out=out[here])
    return out


def log_likely(bias: np.ndarray, weights: np.ndarray, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``log_softmax`` at each token's ``target`` alone."""
    out = np.empty(rows.shape[1], np.float32)
    for here, z in _pieces(bias, weights, rows):
        own = z[np.arange(len(z)), target[here]]
        out[here] = own - np.log(np.exp(z, out=z).sum(axis=1))
    return out


def run_sums(x: np.ndarray, first: np.ndarray, size: np.ndarray, short: int = 8, at: np.ndarray | None = None) -> np.ndarray:
    """Sums of neighbouring rows (of ``x[at]``, if given), ``size`` of them from ``first`` on: the second rows of all short runs together, then the third; long runs alone.

    Runs are taken by falling size, so that those with a k-th row lie side by side; runs given so need not be put back.
    """
    at = np.arange(len(x)) if at is None else at
    fall = np.all(size[1:] <= size[:-1])
    by = slice(None) if fall else np.argsort(-size, kind="stable")
    first, size = first[by], size[by]
    out = x.take(at[first], axis=0, mode="clip")
    long = int(np.searchsorted(-size, -short))
    for i in range(long):
        out[i] = x.take(at[first[i] : first[i] + size[i]], axis=0, mode="clip").sum(axis=0)
    for k in range(1, short):
        end = int(np.searchsorted(-size, -k))
        if end <= long:
            break
        out[long:end] += x.take(at[first[long:end] + k], axis=0, mode="clip")
    if fall:
        return out
    back = np.empty_like(out)
    back[by] = out
    return back


class Trainer:
    """Adaptive gradient steps on one task's texts, for one layer."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights.astype(np.float32)
        self.seen = np.full(ROWS, 1.0, np.float32)
        self.touched = np.zeros(ROWS, np.float32)

    def step(self, bias: np.ndarray, rows: np.ndarray, target: np.ndarray) -> None:
        n = len(target)
        g = softmax(bias, self.weights, rows)
        g[np.arange(n), target] -= 1.0
        # Numbers of 16 bits are sorted by their digits.
        flat = rows.ravel().astype(np.uint16 if ROWS <= 1 << 16 else np.int64)
        order = np.argsort(flat, kind="stable")
        s = flat[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        size = np.diff(np.r_[first, len(s)])
        by = np.argsort((len(s) - size).astype(np.uint16 if len(s) < 1 << 16 else np.int64), kind="stable")
        first, size = first[by], size[by]
        total = run_sums(g, first, size, at=order % n)
        at = s[first].astype(np.int64)
        self.seen[at] += np.einsum("ij,ij->i", total, total)
        self.touched[at] += size
        total *= (RATE / np.sqrt(self.seen[at]))[:, None]
        self.weights[at] = np.subtract(self.weights.take(at, axis=0, mode="clip"), total, out=total)


def _columns(b: pa.RecordBatch, i: int) -> tuple:
    classes = np.frombuffer(b.column("classes")[i].as_py(), np.uint8).astype(np.int64)
    tokens = np.frombuffer(b.column("tokens")[i].as_py(), "<u2" if len(classes) <= 1 << 16 else "<u4").astype(np.int64)
    keys = np.frombuffer(b.column("keys")[i].as_py(), "<u8")
    lengths = np.array(b.column("lengths")[i].as_py(), np.int64)
    return classes, tokens, keys, lengths


def train(stored: DataFrame, model: Model) -> Model:
    """The model after ROUNDS rounds, each over another part of the batches."""
    spark = stored.sparkSession
    columns = ["train", "lengths", "tokens", "keys", "classes"]
    size = ROWS // CHUNKS
    tasks = max(1, min(len(stored.inputFiles()), int(model.tokens.sum() / ROUNDS / TASK_TOKENS)))
    for r in range(ROUNDS):
        # Of fixed size: ROWS * (CLASSES + GROUPS) numbers.
        sent = spark.sparkContext.broadcast((model.bias, [w.astype(np.float16) for w in model.weights]))

        def run(parts: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            layers = None
            for b in parts:
                for i in range(b.num_rows):
                    classes, tokens, keys, lengths = _columns(b, i)
                    use = np.repeat(np.array(b.column("train")[i].as_py(), bool), lengths)
                    if not use.any():
                        continue
                    if layers is None:
                        bias, weights = sent.value
                        layers = [Trainer(w) for w in weights]
                    groups = group_of(keys)
                    hashes = features(keys, tokens, lengths)[:, use]
                    mine = tokens[use]
                    for at in range(0, len(mine), STEP):
                        word = mine[at : at + STEP]
                        first, second = rows_of(hashes[:, at : at + STEP], classes[word])
                        layers[0].step(bias[0], first, classes[word])
                        layers[1].step(bias[1][classes[word]], second, groups[word])
            if layers is not None:
                pid = TaskContext.get().partitionId()
                for k, t in enumerate(layers):
                    before = sent.value[1][k].astype(np.float32)
                    for c in range(CHUNKS):
                        at = np.flatnonzero(t.touched[c * size : (c + 1) * size])
                        whole = at + c * size
                        yield _row(pid, k * CHUNKS + c, at, t.touched[whole], t.weights[whole] - before[whole])

        made = stored.where(F.pmod(F.xxhash64("batch"), F.lit(ROUNDS)) == r).select(*columns).coalesce(tasks).mapInArrow(run, _PART)
        # Tasks meet in about the square root of their number, then those.
        some = made.withColumn("task", F.pmod("task", F.lit(max(1, int(tasks**0.5)))))
        some = some.groupBy("chunk", "task").applyInArrow(_average, _PART)
        total = some.withColumn("task", F.lit(0)).groupBy("chunk", "task").applyInArrow(_average, _PART)
        for x in total.collect():
            layer, c = divmod(x["chunk"], CHUNKS)
            at, _, change = _unpacked(x["chunk"], x["at"], x["weight"], x["change"])
            model.weights[layer][at + c * size] += change
        sent.destroy()
    return model


# What a task changed in a chunk of a table (first those of the classes, then of the groups): the rows, how often it saw each, and the changes.
_PART = "task int, chunk int, at binary, weight binary, change binary"


def _row(task: int, chunk: int, at: np.ndarray, weight: np.ndarray, change: np.ndarray) -> pa.RecordBatch:
    raw = [at.astype(np.int32).tobytes(), weight.astype(np.float32).tobytes(), change.astype(np.float16).tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([chunk], pa.int32()), *(pa.array([x], pa.binary()) for x in raw)], names=["task", "chunk", "at", "weight", "change"])


def _unpacked(chunk: int, at: bytes, weight: bytes, change: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = (CLASSES, GROUPS)[chunk // CHUNKS]
    return np.frombuffer(at, np.int32), np.frombuffer(weight, np.float32), np.frombuffer(change, np.float16).reshape(-1, width).astype(np.float32)


def _average(t: pa.Table) -> pa.Table:
    """Changes of one chunk, averaged over tasks by how often each saw the row."""
    size, chunk = ROWS // CHUNKS, t.column("chunk")[0].as_py()
    total, weights = np.zeros((size, (CLASSES, GROUPS)[chunk // CHUNKS])), np.zeros(size)
    for x in zip(*(t.column(c) for c in ("at", "weight", "change"))):
        at, weight, change = _unpacked(chunk, *(v.as_py() for v in x))
        total[at] += weight[:, None] * change
        weights[at] += weight
    at = np.flatnonzero(weights)
    row = _row(t.column("task")[0].as_py(), chunk, at, weights[at], total[at] / weights[at, None])
    return pa.Table.from_batches([row])


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder, packed tightly, and read back."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def score(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per text with its log10 probability under add-one counts and under the model."""
    first = _stored(batches(df, text, key), "batches")
    counted = _stored(count_words(first), "words")
    tokens, types = np.zeros(CLASSES * GROUPS), np.zeros(CLASSES * GROUPS)
    for r in counted.where("batch IS NULL").select(F.explode("cells").alias("x")).groupBy("x.cell").agg(F.sum("x.n").alias("n"), F.sum("x.v").alias("v")).collect():
        tokens[r["cell"]], types[r["cell"]] = r["n"], r["v"]
    n_all, v_all = int(tokens.sum()), int(types.sum())
    model = train(first, Model(tokens.reshape(CLASSES, GROUPS), types.reshape(CLASSES, GROUPS)))
    back = counted.where("batch IS NOT NULL").groupBy("batch").agg(F.collect_list(F.struct("slice", "n", "counts")).alias("known"))
    both = first.drop("counts", "words").join(back, "batch")
    model.weights = [w.astype(np.float16) for w in model.weights]
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        weights = [w.astype(np.float32) for w in m.weights]
        room = np.log10(m.tokens + m.types + 1.0)
        for b in parts:
            for i in range(b.num_rows):
                classes, tokens, keys, lengths = _columns(b, i)
                groups = group_of(keys)
                # Keys ascend, so slices in order have their counts in order.
                told = sorted(b.column("known")[i].as_py(), key=lambda x: x["slice"])
                c = np.concatenate([_unpack(x["counts"], x["n"]) for x in told]).astype(np.float64)
                starts = np.cumsum(lengths) - lengths
                base = np.log10((c + 1.0) / (n_all + v_all + 1))[tokens]
                inner = (np.log10(c + 1.0) - room[classes, groups])[tokens]
                hashes = features(keys, tokens, lengths)
                outer = np.empty(len(tokens))
                for at in range(0, len(tokens), STEP):
                    word = tokens[at : at + STEP]
                    k, g = classes[word], groups[word]
                    one, two = rows_of(hashes[:, at : at + STEP], k)
                    outer[at : at + STEP] = log_likely(m.bias[0], weights[0], one, k) + log_likely(m.bias[1][k], weights[1], two, g)
                sums = lambda x: np.add.reduceat(x, starts)
                k = len(lengths)
                ids = b.column("ids")[i].values
                held = ~np.array(b.column("train")[i].as_py(), bool)
                values = [held, lengths, sums((c > 0)[tokens].astype(np.int64)), np.full(k, n_all, np.int64), sums(base), sums(inner + outer / np.log(10.0))]
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *map(pa.array, values)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return both.select("ids", "train", "lengths", "tokens", "keys", "classes", "known").mapInArrow(run, _SCORES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
