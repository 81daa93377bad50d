"""Document fingerprints: weighted term hashes vote on signed bits; permuted tables find close ones.

The terms of a text are its words and its pairs of neighbouring words, weighted by what they tell
apart (pairs more than single words, long terms more than short ones, each occurrence counted). A
term's hash votes for or against each of 128 bits with its weight, and the sign of the sum is the
bit. The share of equal bits follows the angle between two texts' term vectors.

To find all fingerprints within ``radius`` bits of given ones, 128 bits are cut into blocks, and a
table per block, keyed by that block moved to the front, holds all fingerprints. In a close pair at
least one block differs in at most radius / blocks bits, so each given fingerprint looks into each
table under its own block and under all blocks that far from it; Hamming distances are then
verified. Nothing within the radius is missed, keys that hold many fingerprints are split, and only
counts leave the join.

Defined cases: null and empty texts have no terms and the zero fingerprint; the next document of
the last is the first (of a single one, itself); rows with equal ids follow each other by text;
null ids come first; texts of any length are fingerprinted whole; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .common import Rolling, documents, map_batches, mix64, text_bytes, word_spans

BITS = 128
# Near copies (five-word similarity of 0.8 or more) lie 5 to 21 bits apart, half of them within 11.
RADIUS = 17
# Of 14 or 15 bits; longer ones are emptier, but a query looks into more of them.
BLOCKS = 9
PAIR_WEIGHT = 4
LONGEST = 12  # bytes beyond which a term weighs no more
# Fingerprints of a key that one slice holds on average.
CHUNK = 1 << 16


def prints_of(data: np.ndarray, offsets: np.ndarray, rolling: Rolling) -> list[bytes]:
    """A 16-byte fingerprint for each text between ``offsets``."""
    start, end, counts = word_spans(data, offsets)
    words = rolling.ranges(rolling.sums(data), start, end)
    size = np.minimum(end - start, LONGEST).astype(np.float32)
    out = []
    at = 0
    for n in counts:
        w, s = words[at : at + n], size[at : at + n]
        at += n
        if not n:
            out.append(bytes(BITS // 8))
            continue
        votes = np.zeros(BITS, np.float64)
        for lo in range(0, n, 1 << 13):
            hi = min(lo + (1 << 13), n)
            one, weight = w[lo:hi], s[lo:hi]
            left, right = w[lo : min(hi, n - 1)], w[lo + 1 : min(hi, n - 1) + 1]
            terms = np.concatenate([one, mix64(left * np.uint64(0x9E3779B97F4A7C15) + right)])
            weight = np.concatenate([weight, PAIR_WEIGHT * (s[lo : min(hi, n - 1)] + s[lo + 1 : min(hi, n - 1) + 1])])
            both = np.stack([terms, mix64(terms ^ np.uint64(0xD6E8FEB86659FD93))], axis=1)
            bits = np.unpackbits(both.view(np.uint8).reshape(-1, BITS // 8), axis=1)
            # Weights are whole numbers, so sums are exact in any order.
            votes += 2.0 * (weight @ bits.astype(np.float32)) - float(weight.sum())
        out.append(np.packbits(votes > 0).tobytes())
    return out


def fingerprints(df: DataFrame, columns: dict[str, str], keep: list[str]) -> DataFrame:
    """The ``keep`` columns of ``df`` and, for each text column, its fingerprint (binary) under the name given."""
    rolling = Rolling(6)
    n = len(keep)
    names = [*keep, *columns.values()]

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        made = [pa.array(prints_of(*text_bytes(b.column(n + i)), rolling), pa.binary()) for i in range(len(columns))]
        return pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), *made], names=names)

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"`{c}` binary" for c in columns.values())])
    return map_batches(df, [*keep, *(F.col(c).cast("string") for c in columns)], one, schema, 200)


def words_of(print_: Column) -> list[Column]:
    """A binary fingerprint as unsigned 32-bit blocks."""
    return [F.conv(F.hex(F.substring(print_, 4 * i + 1, 4)), 16, 10).cast("long") for i in range(BITS // 32)]


def distance(a: Column, b: Column) -> Column:
    """Bits in which two fingerprints differ."""
    pairs = [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(words_of(a), words_of(b))]
    return sum(pairs[1:], pairs[0])


def likeness(a: Column, b: Column) -> Column:
    return 1.0 - distance(a, b) / F.lit(float(BITS))


# Search ----------------------------------------------------------------------------------------


def _halves(print_: Column) -> list[Column]:
    """A binary fingerprint as two 64-bit integers."""
    return [F.conv(F.hex(F.substring(print_, 8 * i + 1, 8)), 16, -10).cast("long") for i in range(BITS // 64)]


def _cuts(blocks: int) -> list[tuple[int, int]]:
    """(shift, bits) of each block, from the low end."""
    if not 2 < blocks <= BITS:
        raise ValueError(f"blocks must be from 3 to {BITS}")
    edges = np.linspace(0, BITS, blocks + 1).astype(int).tolist()
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def _block(hi: Column, lo: Column, cut_: tuple[int, int]) -> Column:
    shift, bits = cut_
    if shift >= 64:
        part = F.shiftrightunsigned(hi, shift - 64)
    else:
        part = F.shiftrightunsigned(lo, shift)
        if shift + bits > 64:
            part = part.bitwiseOR(F.shiftleft(hi, 64 - shift))
    return part.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _flips(bits: int, most: int) -> list[int]:
    """All masks of at most ``most`` of ``bits`` bits."""
    return [sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)]


def within(queries: DataFrame, everything: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Rows (print, n): for each distinct query fingerprint, how many of ``everything``'s weights lie within ``radius`` bits.

    ``queries`` has (print), ``everything`` distinct (print, weight). A query makes a row for each
    block and each mask of at most radius / blocks bits (137 at 17 bits and nine blocks, for one
    row in fifty), each fingerprint of ``everything`` one per block. A pair that meets in several
    tables counts in the first of them.
    """
    cuts = _cuts(blocks)
    most = radius // blocks
    split = lambda df: df.withColumns(dict(zip(("hi", "lo"), _halves(F.col("print")))))
    own = lambda t, c: F.struct(F.lit(t).alias("t"), _block(F.col("hi"), F.col("lo"), c).alias("k"))
    there = split(everything).withColumn("b", F.explode(F.array(*(own(t, c) for t, c in enumerate(cuts)))))
    there = there.select("b.t", "b.k", "hi", "lo", "weight")
    # Keys with more fingerprints than a slice holds, few and known by count: theirs are dealt to
    # slices, and who asks for such a key asks in each of them.
    hot = there.groupBy("t", "k").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("slices")).where("slices > 1")
    hot = cut(hot, "hot-keys")
    there = there.join(hot, ["t", "k"], "left").withColumn("slice", F.coalesce(F.pmod(F.xxhash64("hi", "lo"), F.col("slices")).cast("int"), F.lit(0))).drop("slices")

    def asks(t: int, c: tuple[int, int]) -> Column:
        masks = F.lit(_flips(c[1], most)).cast("array<bigint>")
        return F.transform(masks, lambda m: F.struct(F.lit(t).alias("t"), _block(F.col("hi"), F.col("lo"), c).bitwiseXOR(m).alias("k")))

    q = split(queries.distinct()).withColumn("b", F.explode(F.concat(*(asks(t, c) for t, c in enumerate(cuts))))).select("b.t", "b.k", F.col("hi").alias("qh"), F.col("lo").alias("ql"))
    q = q.join(hot, ["t", "k"], "left").withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))).drop("slices")
    apart = [F.col("hi").bitwiseXOR(F.col("qh")), F.col("lo").bitwiseXOR(F.col("ql"))]
    near = F.bit_count(apart[0]) + F.bit_count(apart[1]) <= radius
    # Met in an earlier table: a block before this one is as close, too.
    earlier = [(F.col("t") > t) & (F.bit_count(_block(*apart, c)) <= most) for t, c in enumerate(cuts[:-1])]
    # Spark sizes exploded rows by what they came from and would broadcast them.
    met = q.hint("merge").join(there, ["t", "k", "slice"]).where(near & ~reduce(lambda x, y: x | y, earlier))
    found = met.groupBy("qh", "ql").agg(F.sum("weight").alias("n"))
    whole = F.unhex(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in ("qh", "ql"))))
    return found.select(whole.alias("print"), "n")


# The next document in order of ids ---------------------------------------------------------------


PIECES = 128
# Rows a range of ids has, about.
RANGE_ROWS = 2000


def _ranges(df: DataFrame, rows: int) -> Column:
    """Number of an id's range, growing with the id: pieces between quantiles, each cut evenly; null ids come first."""
    n, lo, hi = df.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    inner = -(-n // (rows * PIECES))
    if lo is None or n <= rows:
        return F.lit(0).cast("long")
    cuts = sorted({int(x) for x in df.stat.approxQuantile("doc_id", [i / PIECES for i in range(1, PIECES)], 0.2 / PIECES)} - {lo})
    edges = F.array(*(F.lit(x).cast("long") for x in [lo, *cuts, hi + 1]))
    piece = F.size(F.filter(F.array(*(F.lit(x).cast("long") for x in cuts)).cast("array<bigint>"), lambda c: c <= F.col("doc_id")))
    begin, end = F.get(edges, piece).cast("double"), F.get(edges, piece + 1).cast("double")
    within = F.least(F.floor((F.col("doc_id") - begin) / (end - begin) * inner), F.lit(inner - 1))
    return F.coalesce(piece * inner + within + 1, F.lit(0)).cast("long")


def with_next(df: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` (doc_id, text) with next_text, the text of the row after it in order of (doc_id, text).

    Ids are cut into ranges with about equal numbers of rows, so that no task holds the whole
    order; the first row of each range is copied into the range before it, and the very first one
    into the last.
    """
    rows = df.select("doc_id", "text", _ranges(df, rows).alias("part"))
    least = rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "text")).alias("first"))
    # A few rows, one per range: each goes to the range before it that has rows.
    order = W.orderBy(F.col("part").desc())
    first = cut(least, "range-starts")
    edges = first.select("first.doc_id", "first.text", F.lead("part").over(order).alias("part"), F.lit(True).alias("edge"))
    last = first.agg(F.max("part").alias("top"), F.min(F.struct("part", "first")).alias("f")).where("top IS NOT NULL").select("f.first.doc_id", "f.first.text", F.col("top").alias("part"), F.lit(True).alias("edge"))
    edges = edges.where("part IS NOT NULL").unionByName(last)
    every = rows.withColumn("edge", F.lit(False)).unionByName(edges)
    w = W.partitionBy("part").orderBy("edge", F.col("doc_id").asc_nulls_first(), "text")
    return every.withColumn("next_text", F.lead("text").over(w)).where(~F.col("edge")).select("doc_id", "text", "next_text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    # The edited text keeps the head and takes as many code points from the start of the next document.
    both = with_next(docs).withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    both = both.withColumn("edited_sha256", F.sha2("edited", 256))
    made = cut(fingerprints(both, {"text": "print", "edited": "edited_print", "next_text": "next_print"}, ["doc_id", "n_chars", "edited_sha256"]), "prints")
    everything = made.groupBy("print").agg(F.count("*").alias("weight"))
    asked = made.where(F.pmod("doc_id", F.lit(50)) == 0).select("print")
    found = within(asked, everything)
    out = made.join(found, "print", "left")
    show = lambda c: F.lower(F.hex(c))
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        show("print").alias("fingerprint"),
        show("edited_print").alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
        # Other documents within the radius, for the stated query set.
        F.when(F.pmod("doc_id", F.lit(50)) == 0, F.col("n") - 1).alias("n_near"),
    )
