"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source gets a target in words. Its documents are dealt to blocks by hash, which permutes them;
whole passes over the source and then the first blocks of one more pass fill the target, and inside
the one block where the target is reached documents are picked until it is met as nearly as whole
documents can. The blocks taken, a count per source, are split among output shards by a tree: at
each node a multivariate-hypergeometric draw says how many blocks of each source go left, so every
shard's composition is a random one with exact totals. Shards then take disjoint runs of each
source's permuted blocks and are shuffled locally.

The plan holds a row per source (targets, quotas, the picked documents of one block) and is made
from counts; documents themselves never move except to their shards. The same seed gives the same
mix on any cluster.

Defined cases: null and empty texts have size 0 and take 0 words; a null source is a source, last
in order; rows equal in id and text are taken together; a null id counts like any other value; an
empty table gives an empty table; other columns pass through (working names start with ``_mix_``).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .common import WORD, documents

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
SHARDS = 64
# Documents a block has on average.
BLOCK_DOCS = 512
# Sources up to which the plan is broadcast (a few kB each); beyond, it is joined by shuffle.
BROADCAST_SOURCES = 2_000


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> list[float]:
    """Words each source should give: shares of all words by weight, none above ``most`` times its size.

    What a source cannot take is shared again among the others by weight until none is above.
    """
    w = np.array([weights[i % len(weights)] for i in range(len(sizes))], float)
    top = most * np.array(sizes, float)
    out = np.zeros(len(sizes))
    free = np.ones(len(sizes), bool)
    while free.any():
        left = float(sum(sizes)) - out[~free].sum()
        out[free] = left * w[free] / w[free].sum()
        above = free & (out > top)
        if not above.any():
            break
        out[above] = top[above]
        free &= ~above
    return out.tolist()


def split_tree(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source in each shard, (source, shard); rows sum to ``counts``."""
    out = np.zeros((len(counts), shards), np.int64)

    def split(have: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[:, lo] = have
            return
        mid = (lo + hi) // 2
        total = int(have.sum())
        wanted = total * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(have, wanted, method="marginals") if total else have
        split(left, lo, mid)
        split(have - left, mid, hi)

    split(np.array(counts, np.int64), 0, shards)
    return out


def pick(items: list[tuple[int, int]], rest: float, over: bool) -> list[int]:
    """Documents (draw, size) whose sizes sum to ``rest`` as nearly as swaps of two can bring them.

    Taken in the order of their draws while they fit; then one more is added or two are exchanged
    as long as that comes nearer. ``over`` tells whether another copy is allowed at all.
    """
    items = sorted(x for x in items if x[1] > 0)
    if not over or not items:
        return []
    size = np.array([x[1] for x in items], float)
    taken, left = np.zeros(len(items), bool), float(rest)
    for i, x in enumerate(size):
        if x <= left:
            taken[i] = True
            left -= x
    while True:
        # What is left after adding j alone, or putting j in for i; a place 0 stands for no document.
        out = np.concatenate([[0.0], np.where(taken, size, np.nan)])
        new = np.where(taken, np.nan, size)
        after = np.abs(left + out[:, None] - new[None, :])
        if np.isnan(after).all():
            break
        i, j = np.unravel_index(np.nanargmin(after), after.shape)
        if after[i, j] >= abs(left) - 1e-9:
            break
        left += out[i] - size[j]
        taken[j] = True
        if i:
            taken[i - 1] = False
    return [x[0] for x, t in zip(items, taken) if t]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _draw(seed: int, key: Column, text: Column) -> Column:
    """A number that permutes documents: the same for the same row anywhere."""
    return F.xxhash64(F.lit(seed), key, text)


def _block(draw: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), draw), blocks)


def _plan(sized: DataFrame, weights, most, shards, seed) -> DataFrame:
    """One row per source: words, target, whole passes, block count, and what the last pass takes.

    ``sized`` has (_mix_source, _mix_size, _mix_draw). Only rows per source and those of one block
    per source come to the driver.
    """
    spark = sized.sparkSession
    stats = sized.groupBy("_mix_source").agg(F.sum("_mix_size").alias("size"), F.count("*").alias("docs")).collect()
    # Code point order is UTF-8 byte order.
    stats.sort(key=lambda r: (r[0] is None, (r[0] or "").encode()))
    wanted = targets([r["size"] for r in stats], weights, most)
    rows = []
    for r, t in zip(stats, wanted):
        passes = int(t // r["size"]) if r["size"] else 0
        rows.append({"source": r[0], "size": r["size"], "target": t, "blocks": max(1, math.ceil(r["docs"] / BLOCK_DOCS)), "passes": passes, "rest": t - passes * r["size"]})
    first = _side(spark, rows, "source string, blocks long, rest double")
    placed = sized.join(first, F.col("_mix_source").eqNullSafe(F.col("source"))).withColumn("block", _block(F.col("_mix_draw"), F.col("blocks")))
    # The block of the last pass in which the target is reached: running sums over blocks, a few per source.
    sums = placed.groupBy("source", "rest", "block").agg(F.sum("_mix_size").alias("words"))
    reached = sums.withColumn("upto", F.sum("words").over(W.partitionBy("source").orderBy("block"))).where("upto > rest").groupBy("source").agg(F.min(F.struct("block", (F.col("upto") - F.col("words")).alias("before"))).alias("edge")).collect()
    edges = {r["source"]: (r["edge"]["block"], r["edge"]["before"]) for r in reached}
    for r in rows:
        # None is reached if the last pass takes nothing that is left to take.
        r["edge"], r["before"] = edges.get(r["source"], (r["blocks"], 0))
    second = _side(spark, rows, "source string, blocks long, edge long")
    at_edge = sized.join(second, F.col("_mix_source").eqNullSafe(F.col("source"))).where(_block(F.col("_mix_draw"), F.col("blocks")) == F.col("edge"))
    inside: dict = {}
    for r in at_edge.groupBy("source", F.col("_mix_draw").alias("draw")).agg(F.sum("_mix_size").alias("size")).collect():
        inside.setdefault(r["source"], []).append((r["draw"], r["size"]))
    for r in rows:
        r["picks"] = pick(inside.get(r["source"], []), r["rest"] - r["before"], r["passes"] + 1 <= most)
    counts = [r["passes"] * r["blocks"] + min(r["edge"] + bool(r["picks"]), r["blocks"]) for r in rows]
    for r, n, parts in zip(rows, counts, split_tree(counts, shards, seed)):
        r["units"] = n
        r["quotas"] = np.cumsum(parts).tolist()
        # Multiplying by a number without a common divisor permutes 0..n-1.
        step = next((k for k in range(n * 5 // 8, n) if k > 0 and math.gcd(k, n) == 1), 1)
        r["step"], r["shift"] = step, int(np.random.default_rng([seed, n]).integers(max(n, 1)))
    schema = "source string, size long, target double, blocks long, passes int, edge long, picks array<long>, units long, quotas array<long>, step long, shift long"
    return _side(spark, rows, schema)


def _side(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    kind = T._parse_datatype_string(schema)
    out = spark.createDataFrame([tuple(r[f.name] for f in kind.fields) for r in rows], kind)
    return F.broadcast(out) if len(rows) <= BROADCAST_SOURCES else out


def mix(df: DataFrame, sized: DataFrame | None = None, source: str = "source", text: str = "text", key: str = "doc_id", weights=WEIGHTS, most: float = MOST, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """Every row of ``df`` with size, source_size, target, taken and the shards its copies go to.

    ``sized`` may give (_mix_source, _mix_size, _mix_draw) of the same rows, stored, to spare a
    second look at the texts; ``df`` is then that table with further columns.
    """
    if sized is None:
        df = measured(df, source, text, key, seed)
        sized = cut(df.select("_mix_source", "_mix_size", "_mix_draw"), "mix-sizes")
    plan = _plan(sized, weights, most, shards, seed)
    p = lambda c: F.col(f"_mix_plan.{c}")
    out = df.join(plan.select(F.struct("*").alias("_mix_plan")), F.col("_mix_source").eqNullSafe(F.col("_mix_plan.source")))
    block = _block(F.col("_mix_draw"), p("blocks"))
    more = (block < p("edge")) | ((block == p("edge")) & F.array_contains(p("picks"), F.col("_mix_draw")))
    out = out.withColumn("_mix_block", block).withColumn("_mix_copies", p("passes") + more.cast("int"))

    def shard(k: Column) -> Column:
        at = (((k * p("blocks") + F.col("_mix_block")) * p("step")) + p("shift")) % F.greatest(p("units"), F.lit(1))
        return F.size(F.filter(p("quotas"), lambda q: q <= at))

    copies = F.when(F.col("_mix_copies") > 0, F.sequence(F.lit(0), F.col("_mix_copies") - 1)).otherwise(F.array().cast("array<int>"))
    return out.withColumns({"_mix_shards": F.transform(copies, shard), "_mix_target": p("target"), "_mix_source_size": p("size"), "_mix_taken": F.col("_mix_size") * F.col("_mix_copies")}).drop("_mix_plan", "_mix_source")


def measured(df: DataFrame, source: str, text: str, key: str, seed: int) -> DataFrame:
    return df.withColumns({"_mix_source": F.col(source).cast("string"), "_mix_size": n_words(F.col(text)), "_mix_draw": _draw(seed, F.col(key), F.col(text))})


def shuffled(mixed: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """The mix itself: a row for every copy, together by shard and in a random order inside it.

    One shuffle by (shard, slice of the order), so no task holds a whole shard.
    """
    own = [c for c in mixed.columns if not c.startswith("_mix_")]
    each = mixed.select(*own, "_mix_draw", F.posexplode("_mix_shards").alias("_mix_copy", "_mix_shard"))
    order = F.xxhash64(F.lit(seed + 1), F.col("_mix_shard"), F.col("_mix_draw"), F.col("_mix_copy"))
    return each.withColumn("_mix_order", order).repartitionByRange("_mix_shard", "_mix_order").sortWithinPartitions("_mix_shard", "_mix_order").select(*own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    sized = cut(measured(docs, "source", "text", "doc_id", 0).select(F.col("doc_id").cast("long").alias("doc_id"), "_mix_source", "_mix_size", "_mix_draw"), "mix-sizes")
    out = mix(sized, sized)
    return out.select("doc_id", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), F.col("_mix_taken").alias("taken"), F.col("_mix_shards").alias("shards"))
