"""Near duplicates by SimHash and pigeonhole blocks.

A text's fingerprint has a bit set if more than half of its four-word shingles' hashes have it. To
find all pairs within ``radius`` bits, fingerprints are cut into blocks: two that differ in at most
``radius`` bits agree in all but ``radius`` of them, so for every choice of the blocks that must
agree there is a table keyed by those, and each close pair meets in one of the tables. Pairs that
meet are verified by their Hamming distance.

Only distinct fingerprints are joined, so exact copies cost nothing. A bucket comes as arrays of at
most some thousand fingerprints; larger ones are dealt to chunks, and each pair of chunks is
compared in one place. Of the links found there only a star per connected set is passed on, never
all pairs. Components then follow from the links.

Defined cases: null and empty texts, and those of white space alone, have fingerprint zero and are
linked like any other; texts under four words have one shingle; a null doc_id has no part in the
choice of component_id (null if there is no other); repeated rows come out as often as they came
in; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .common import documents, map_batches, texts
from .components import components

SHINGLE = 4
SEED = 42
RADIUS = 4
# Fingerprints a chunk of a bucket has on average.
CHUNK = 2048


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of a text in UTF-8."""
    words = text.lower().split()  # on bytes: A-Z only, and the six white space characters
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if n <= SHINGLE:
        return h(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - SHINGLE].tolist()]
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    hashes = np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(stops))
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (doc_id, t, print): the fingerprint as a signed 64-bit integer; t is a hash of the text."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(x) for x in texts(b.column(2))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found)], names=["doc_id", "t", "print"])

    columns = [F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), F.col(text).cast("string").alias("text")]
    return map_batches(df, columns, one, "doc_id long, t long, print long", 200)


def tables(blocks: int, radius: int = RADIUS, width: int = 64) -> list[int]:
    """A mask for every choice of blocks that must agree."""
    edge = [width * i // blocks for i in range(blocks + 1)]
    block = [(1 << hi) - (1 << lo) for lo, hi in zip(edge, edge[1:])]
    return [sum(c) for c in combinations(block, blocks - radius)]


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """Blocks so that unrelated fingerprints rarely share a bucket; any number finds the same links."""
    blocks = radius + 2
    while n >> (64 * (blocks - radius) // blocks) > 8:
        blocks += 1
    return blocks


def stars(prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected by pairs within ``radius``: each print to its set's first."""
    n = len(prints)
    close = np.empty((n, n), bool)
    for at in range(0, n, 256):
        close[at : at + 256] = np.bitwise_count(prints[at : at + 256, None] ^ prints[None, :]) <= radius
    root = np.full(n, -1, np.int64)
    for first in range(n):
        if root[first] >= 0:
            continue
        root[first] = first
        edge = np.array([first])
        while len(edge):
            new = np.flatnonzero(close[edge].any(axis=0) & (root < 0))
            root[new] = first
            edge = new
    other = np.flatnonzero(root != np.arange(n))
    return prints[root[other]], prints[other]


def _verify(b: pa.RecordBatch, radius: int) -> pa.RecordBatch:
    lists = b.column(0)
    off = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
    size = np.diff(off)
    two = off[:-1][size == 2]
    near = two[np.bitwise_count(flat[two] ^ flat[two + 1]) <= radius]
    a, c = [flat[near]], [flat[near + 1]]
    for i in np.flatnonzero(size > 2):
        x, y = stars(np.unique(flat[off[i] : off[i + 1]]), radius)
        a.append(x)
        c.append(y)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(c).view(np.int64))], names=["a", "b"])


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """(a, b): links among the distinct ``print`` values that connect all that pairs within ``radius`` connect."""
    blocks = blocks or blocks_for(distinct.count(), radius)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = [F.xxhash64(F.lit(t), F.col("print").bitwiseAND(F.lit(signed(m)).cast("long"))) for t, m in enumerate(tables(blocks, radius))]
    rows = distinct.select("print", F.explode(F.array(*keys)).alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    met = rows.join(shared, "bucket")
    own = F.pmod(F.xxhash64("print"), F.col("chunks")).cast("int")
    # A chunk meets every other one of its bucket; a single chunk meets itself.
    others = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: j != F.col("own")))
    met = met.withColumn("own", own).withColumn("other", F.explode(others))
    met = met.groupBy("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).agg(F.collect_list("print").alias("prints")).where(F.size("prints") > 1)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(0).slice(at, 2000)])], names=["prints"])
                yield _verify(part, radius)

    return met.select("prints").mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, radius: int = RADIUS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (doc_id, t, print, root, component_id), one for each row of ``df``; root names the component."""
    prints = cut(fingerprints(df, text, key), "prints")
    nodes = cut(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "distinct-prints")
    roots = components(links(nodes, radius))
    linked = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    members = nodes.join(linked, nodes["print"] == linked["node"], "left").withColumn("root", F.coalesce("root", "print"))
    first = members.groupBy("root").agg(F.min("first").alias("component_id"))
    of = members.select("print", "root").join(first, "root").select("print", "root", "component_id")
    return prints.join(of, "print")


def keep_one(df: DataFrame, radius: int = RADIUS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of ``df`` for each component: the one with the smallest id (null last), then the smallest hash of the text."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    first = near_duplicates(df, radius, text, key).groupBy("root").agg(F.min(rank).alias("first"))
    known = lambda c: F.coalesce(c.cast("long"), F.lit(-(1 << 63)))
    stays = first.select(known(F.col("first.doc_id")).alias("_d"), F.col("first.t").alias("_t"))
    rows = df.withColumns({"_d": known(F.col(key)), "_t": F.xxhash64(text)})
    # Rows equal in id and text are told apart by nothing: any of them stays.
    return rows.join(stays, ["_d", "_t"], "left_semi").dropDuplicates(["_d", "_t"]).drop("_d", "_t")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
