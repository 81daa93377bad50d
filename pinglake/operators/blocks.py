"""Ordered computation over recordings of any length.

A window partitioned by recording puts a whole recording into one task. These helpers cut
each recording into blocks of a bounded number of rows and work by (recording, block):

* neighbours at a bounded distance come from copies of the few rows at block edges;
* running totals and "last known" values come from one summary row per block, scanned
  per recording and joined back.

The detail rows are shuffled once, by (recording, block). The only per-recording scan
is over block summaries, a 65,536th of the rows by default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import block_rows, cut

BLOCK = "_block"
HOME = "_home"


def _rows(df: DataFrame, rows: int | None) -> int:
    return int(rows or block_rows(df.sparkSession))


def index_block(df: DataFrame, idx: str = "ping_index", rows: int | None = None) -> DataFrame:
    """Add the block of a dense index."""
    r = _rows(df, rows)
    return df.withColumn(BLOCK, F.floor(F.col(idx) / F.lit(r)).cast("long"))


# Cut points per recording that value_block takes from the data.
SPLITS = 128
# A recording with more than this share of all rows is heavy: there are fewer than so many.
HEAVY = 1000
_INNER = 1 << 20


def with_facts(df: DataFrame, facts: DataFrame, key: Sequence[str], count: str) -> DataFrame:
    """Rows with the facts of their recording; rows of recordings without facts keep NULLs.

    ``facts`` has one row per recording and in ``count`` how many rows it has. Recordings with
    more than a thousandth of all rows are at most a thousand, so their facts are broadcast and
    their rows need not come together. The rows of the others are joined by recording, where none
    weighs more than that; heavy rows pass that join spread by their contents, without a partner.
    """
    key = list(key)
    names = [c for c in facts.columns if c not in (*key, count)]
    # Stored, as it is read three times: what all add up to, heavy ones, light ones.
    f = cut(facts.select(*key, count, F.struct(*names).alias("_facts")), "facts")
    least = f.agg(F.sum(count).alias("_all")).scalar() / HEAVY
    heavy = F.broadcast(f.where(F.col(count) > least).select(*key, F.col("_facts").alias("_heavy")))
    light = f.where(F.col(count) <= least).select(*key, "_facts", F.lit(0).cast("long").alias("_slot"))
    plain = [c.name for c in df.schema.fields if c.dataType.typeName() not in ("array", "map", "struct", "variant")]
    slot = F.when(F.col("_heavy").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(*plain), F.lit(1 << 20)) + 1)
    d = df.join(heavy, key, "left").withColumn("_slot", slot).join(light, [*key, "_slot"], "left")
    return d.select(*df.columns, *[F.coalesce(F.col("_heavy")[c], F.col("_facts")[c]).alias(c) for c in names])


def join_facts(df: DataFrame, facts: DataFrame, key: Sequence[str]) -> DataFrame:
    """``with_facts`` for facts that do not say how many rows a recording has."""
    n = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
    return with_facts(df, facts.join(n, list(key)), key, "_rows")


def value_block(df: DataFrame, key: Sequence[str], x: str, rows: int | None = None, tie: str | None = None) -> DataFrame:
    """Add the block of an arbitrary order column, from cut points that the data give.

    A recording's range is cut at ``SPLITS`` approximate quantiles (one sketch per recording,
    built before the shuffle), so far-off values do not crowd the others into one block. Up to
    ``SPLITS`` blocks, neighbouring pieces are joined; beyond, each piece is cut again evenly.
    Equal values share a block, unless ``tie`` names a numeric second order column: a value that
    fills two blocks or more is then cut along that column, evenly over its range.
    """
    r = _rows(df, rows)
    v = F.col(x).cast("double")
    cuts = F.percentile_approx(v, [i / SPLITS for i in range(1, SPLITS)], 10000)
    n = F.count(F.lit(1))
    stats = [cuts.alias("_cuts"), F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.ceil(n / F.lit(r)).cast("long").alias("_blocks"), n.alias("_rows")]
    if tie:
        t = F.col(tie).cast("double")
        stats += [F.min(t).alias("_tlo"), F.max(t).alias("_thi")]
    d = with_facts(df, df.groupBy(*key).agg(*stats), key, "_rows")
    cut_at_most = F.size(F.filter("_cuts", lambda c: c <= v)).cast("long")
    d = d.withColumn("_piece", F.when(F.col("_blocks") > 1, cut_at_most).otherwise(F.lit(0)))
    lo = F.coalesce(F.get("_cuts", (F.col("_piece") - 1).cast("int")), F.col("_lo"))
    hi = F.coalesce(F.get("_cuts", F.col("_piece").cast("int")), F.col("_hi"))
    parts = F.ceil(F.col("_blocks") / SPLITS)
    inner = F.when(hi > lo, F.least(F.floor((v - lo) / (hi - lo) * parts), parts - 1)).otherwise(F.lit(0))
    few = F.floor(F.col("_piece") * F.col("_blocks") / SPLITS)
    outer = F.when(F.col("_blocks") <= 1, F.lit(0)).when(F.col("_blocks") <= SPLITS, few).otherwise(F.col("_piece") * parts + inner)
    drop = ["_cuts", "_lo", "_hi", "_blocks", "_piece"]
    if not tie:
        return d.withColumn(BLOCK, F.coalesce(outer, F.lit(0)).cast("long")).drop(*drop)
    # How many cut points a value takes says how many blocks it fills.
    d = d.withColumn("_full", F.floor(F.size(F.filter("_cuts", lambda c: c == v)) * F.col("_blocks") / SPLITS).cast("long"))
    even = F.when(F.col("_thi") > F.col("_tlo"), F.least(F.floor((t - F.col("_tlo")) / (F.col("_thi") - F.col("_tlo")) * F.col("_full")), F.col("_full") - 1)).otherwise(F.lit(0))
    # The block before those of larger values, after whatever of smaller ones it may hold.
    last = F.when(F.col("_blocks") <= SPLITS, few).otherwise(F.col("_piece") * parts) - 1
    b = F.when(F.col("_full") >= 2, last * _INNER + 1 + F.coalesce(even, F.lit(0))).otherwise(outer * _INNER)
    return d.withColumn(BLOCK, F.coalesce(b, F.lit(0)).cast("long")).drop(*drop, "_tlo", "_thi", "_full")


def in_block(key: Sequence[str], *order) -> Window:
    return Window.partitionBy(*key, BLOCK).orderBy(*order)


def with_halo(df: DataFrame, idx: str, before: int, after: int, rows: int | None = None) -> DataFrame:
    """Blocks of a dense index plus copies of edge rows needed as context next door.

    ``before``/``after`` say how many preceding/following rows a row needs. Copies have
    ``_home`` false and are dropped by the caller.
    """
    r = max(_rows(df, rows), before, after, 1)
    home = F.floor(F.col(idx) / F.lit(r)).cast("long")
    off = F.col(idx) - home * F.lit(r)
    # One flag array per row; rows away from the edges yield exactly one copy.
    targets = F.array(home)
    if before:
        targets = F.when(off >= r - before, F.concat(targets, F.array(home + 1))).otherwise(targets)
    if after:
        targets = F.when(off < after, F.concat(targets, F.array(home - 1))).otherwise(targets)
    return df.withColumn("_own", home).withColumn(BLOCK, F.explode(targets)).withColumn(
        HOME, F.col(BLOCK) == F.col("_own")
    ).drop("_own")


def shift(df: DataFrame, key: Sequence[str], outs: dict[str, tuple[str, int]], idx: str = "ping_index",
          rows: int | None = None) -> DataFrame:
    """Values of rows at a fixed distance: ``outs`` maps a new column to (column, distance).

    A positive distance looks back, a negative one ahead; NULL beyond the ends. The index
    must be dense within a recording.
    """
    before = max([d for _, d in outs.values() if d > 0], default=0)
    after = max([-d for _, d in outs.values() if d < 0], default=0)
    w = in_block(key, idx)
    d = with_halo(df, idx, before, after, rows)
    cols = [(F.lag(c, k) if k > 0 else F.lead(c, -k)).over(w).alias(o) for o, (c, k) in outs.items()]
    return d.select("*", *cols).where(F.col(HOME)).drop(HOME, BLOCK)


def _summary(kind: str, c: Column, order: Column) -> Column:
    if kind == "sum":
        return F.sum(c)
    if kind == "max":
        return F.max(c)
    if kind == "last":
        return F.max_by(c, F.when(c.isNotNull(), order))
    if kind == "next":
        return F.min_by(c, F.when(c.isNotNull(), order))
    raise ValueError(kind)


def scan(df: DataFrame, key: Sequence[str], order: Sequence[str], outs: dict[str, tuple[str, str]],
         blocked: bool = False, rows: int | None = None) -> DataFrame:
    """Running values along a recording.

    ``outs`` maps a new column to (kind, column), kind one of ``sum``, ``max`` (up to and
    including this row), ``last`` (latest non-NULL up to and including this row) and
    ``next`` (earliest non-NULL from this row on). Rows with equal order share a result.
    With ``blocked`` the frame already has a block column; else ``order[0]`` is a dense
    index.
    """
    d = df if blocked else index_block(df, order[0], rows)
    o = F.struct(*order)
    parts = d.groupBy(*key, BLOCK).agg(*[_summary(k, F.col(c), o).alias(f"_s_{n}") for n, (k, c) in outs.items()])
    past = Window.partitionBy(*key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*key).orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    carried = []
    for n, (k, _) in outs.items():
        s = F.col(f"_s_{n}")
        e = {
            "sum": lambda: F.coalesce(F.sum(s).over(past), F.lit(0)),
            "max": lambda: F.max(s).over(past),
            "last": lambda: F.last(s, ignorenulls=True).over(past),
            "next": lambda: F.last(s, ignorenulls=True).over(ahead),
        }[k]()
        carried.append(e.alias(f"_c_{n}"))
    parts = parts.select(*key, BLOCK, *carried)
    d = d.join(parts, [*key, BLOCK])
    up = in_block(key, *order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = in_block(key, *[F.desc(c) for c in order]).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cols = []
    for n, (k, c) in outs.items():
        carry = F.col(f"_c_{n}")
        e = {
            "sum": lambda: carry + F.coalesce(F.sum(c).over(up), F.lit(0)),
            "max": lambda: F.greatest(carry, F.max(c).over(up)),
            "last": lambda: F.coalesce(F.last(c, ignorenulls=True).over(up), carry),
            "next": lambda: F.coalesce(F.last(c, ignorenulls=True).over(down), carry),
        }[k]()
        cols.append(e.alias(n))
    return d.select("*", *cols).drop(BLOCK, *[f"_c_{n}" for n in outs])


def dense_index(df: DataFrame, key: Sequence[str], order: Sequence[str], out: str = "ping_index",
                rows: int | None = None, total: str | None = None) -> DataFrame:
    """0-based position within the recording; ``order[0]`` must be numeric.

    Works like a row number by recording, one block at a time; a numeric second order column
    splits values that many rows share. ``total`` names a column for the recording's row count,
    which the block counts give for nothing.
    """
    numeric = ("byte", "short", "integer", "long", "float", "double", "decimal")
    tie = order[1] if len(order) > 1 and df.schema[order[1]].dataType.typeName() in numeric else None
    d = value_block(df, key, order[0], rows, tie)
    counts = d.groupBy(*key, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    past = Window.partitionBy(*key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    whole = [F.sum("_n").over(Window.partitionBy(*key)).alias(total)] if total else []
    counts = counts.select(*key, BLOCK, F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_before"), *whole)
    d = d.join(counts, [*key, BLOCK])
    return d.withColumn(out, F.col("_before") + F.row_number().over(in_block(key, *order)) - 1).drop(BLOCK, "_before")
