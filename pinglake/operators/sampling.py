"""Seeded draws, splits, interleaving and augmentation.

Every draw is a hash of (seed, key, name), so results do not depend on partitioning and
can be repeated anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..session import block_rows, cut
from .asof import linear_between
from .blocks import BLOCK, dense_index, scan, value_block, with_facts
from .quantiles import quantiles
from .smooth import gaussian_time

KEY = ("transect_id",)


def _hash(seed: int, key: Sequence, draw: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[A.col(k).cast("string") for k in key], F.lit(draw)))


def uniform(seed: int, key: Sequence, draw: str = "u") -> Column:
    """Uniform draw in [0, 1) per key."""
    return F.conv(F.substring(_hash(seed, key, draw), 1, 8), 16, 10).cast("double") / 4294967296.0


def between(u: Column, lo, hi) -> Column:
    return A.col(lo) + (A.col(hi) - A.col(lo)) * u


def log_uniform_scale(u: Column, max_factor: float) -> Column:
    """Scale factor between 1/max and max, even on a log scale."""
    return F.exp(F.log(F.lit(float(max_factor))) * (2 * u - 1))


def hash_rank(df: DataFrame, by: Sequence[str], seed: int, key: Sequence[str], out: str = "rank", rows: int | None = None,
              total: str | None = None) -> DataFrame:
    """0-based position of each row in the seeded shuffle of its group.

    The order is that of the hash. It is even, so slices of its range are blocks of about
    equal size, and the position is a running count over slices.
    """
    by = list(by)
    d = df.withColumn("_u", uniform(seed, key, "shuffle")).withColumn("_h", _hash(seed, key, "shuffle"))
    if not by:
        return _overall_index(d, ["_u", "_h"], df.count(), out, rows, total).drop("_u", "_h")
    return dense_index(d, by, ["_u", "_h"], out, rows, total).drop("_u", "_h")


def _overall_index(df: DataFrame, order: Sequence[str], n: int, out: str, rows: int | None = None, total: str | None = None) -> DataFrame:
    """0-based position over all rows; ``order[0]`` is spread evenly over [0, 1).

    The slices follow from the row count alone, so only counts per slice are put in order
    in one place.
    """
    slices = max(1, math.ceil(n / (rows or block_rows(df.sparkSession))))
    d = df.withColumn(BLOCK, F.least(F.floor(F.col(order[0]) * slices), F.lit(slices - 1)).cast("long"))
    counts = d.groupBy(BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    past = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(BLOCK, F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_before"))
    d = d.join(counts, BLOCK).withColumn(out, F.col("_before") + F.row_number().over(Window.partitionBy(BLOCK).orderBy(*order)) - 1)
    return (d.withColumn(total, F.lit(n)) if total else d).drop(BLOCK, "_before")


def split(df: DataFrame, key: Sequence[str], seed: int = 1, strata: Sequence[str] = (), share: float = 0.1, rounded: bool = True) -> DataFrame:
    """Train / test / validate by seeded shuffle within each stratum: column ``part``.

    Test and validate take ``share`` of the rows each, rounded half to even or cut down;
    validate comes last in the shuffle.
    """
    d = hash_rank(df, list(strata), seed, key, "_r", total="_n")
    size = F.col("_n") * share
    k = (F.bround(size) if rounded else F.floor(size + 1e-9)).cast("long")
    part = F.when(F.col("_r") < F.col("_n") - 2 * k, "train").when(F.col("_r") < F.col("_n") - k, "test").otherwise("validate")
    return d.withColumn("part", part).drop("_r", "_n")


def group_split(df: DataFrame, group: str, seed: int = 1, share: float = 0.1) -> DataFrame:
    """Split whole groups; every row follows its group."""
    g = split(df.select(group).distinct(), [group], seed, share=share, rounded=False)
    return df.join(g, group)


def stratified_split(df: DataFrame, key: Sequence[str], leave_out: Column, stratum: Column, seed: int = 1, share: float = 0.1) -> DataFrame:
    """Rows matching ``leave_out`` apart (part ``leaveout``), the rest split within two strata."""
    rest = split(df.where(~leave_out).withColumn("_s", stratum), key, seed, ["_s"], share, rounded=False).drop("_s")
    return rest.unionByName(df.where(leave_out).withColumn("part", F.lit("leaveout")))


def interleave(df: DataFrame, dataset: str, key: Sequence[str], seed: int = 1, out: str = "position") -> DataFrame:
    """One order over several data sets, each shuffled, at constant proportions, without repeats.

    A row's place is its position's share of its own data set. Proportions stay within one
    row of the sizes' ratio; ties go by data set name.
    """
    d = hash_rank(df, [dataset], seed, key, "_r", total="_n")
    d = d.withColumn("_at", (F.col("_r") + 0.5) / F.col("_n"))
    return _overall_index(d, ["_at", dataset], df.count(), out).drop("_r", "_n", "_at")


def evenly_spaced(df: DataFrame, position: str, every: int, at_most: int = 32) -> DataFrame:
    """Every n-th row by position, at most ``at_most`` rows. The cap is the feature."""
    return df.where((F.col(position) % every == 0) & (F.col(position) < every * at_most))


def head_of(df: DataFrame, order: Sequence[str], n: int = 1) -> DataFrame:
    """First rows of a named part. The limit is the feature."""
    return df.orderBy(*order).limit(n)


# --- Augmentation ---


def reflect_time(df: DataFrame, seed: int, p: float = 0.5, key: Sequence[str] = KEY, idx: str = "ping_index") -> DataFrame:
    """Reverse the pings of randomly chosen windows; only the index changes."""
    n = df.groupBy(*key).agg(F.max(idx).alias("_last"), F.min(idx).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    u = uniform(seed, key, "reflect")
    return with_facts(df, n, key, "_rows").withColumn(idx, F.when(u <= p, F.col("_last") + F.col("_first") - F.col(idx)).otherwise(F.col(idx))).drop("_last", "_first")


def jitter_range(value: float | tuple[float, float], center: float, floor: float = float("-inf")) -> tuple[float, float]:
    """Bounds of a random factor: a pair as given, or a distance around ``center`` cut at ``floor``."""
    pair = tuple(map(float, value)) if isinstance(value, Sequence) else (max(center - value, floor), center + value)
    if len(pair) != 2 or not floor <= pair[0] <= pair[1]:
        raise ValueError(f"no range from {value!r}: two bounds in order, or one distance, none below {floor}")
    return pair


def colour_jitter(df: DataFrame, seed: int, brightness=0.0, contrast=0.0, key: Sequence[str] = KEY, value: str = "sv") -> DataFrame:
    """Add a random brightness and multiply by a random contrast, in random order, per window."""
    b = between(uniform(seed, key, "brightness"), *map(F.lit, jitter_range(brightness, 0.0)))
    c = between(uniform(seed, key, "contrast"), *map(F.lit, jitter_range(contrast, 1.0, floor=0.0)))
    first = uniform(seed, key, "order") < 0.5
    args = F.struct(F.col(value).alias("v"), b.alias("b"), c.alias("c"), first.alias("f"))
    out = A.let(args, lambda s: F.transform(s["v"], lambda x: F.when(s["f"], (x + s["b"]) * s["c"]).otherwise(x * s["c"] + s["b"])))
    return df.withColumn(value, out)


def crop_width(df: DataFrame, seed: int, max_fraction: float, key: Sequence[str] = KEY, idx: str = "ping_index") -> DataFrame:
    """Centred crop in time by a random fraction; the index starts at 0 again."""
    n = df.groupBy(*key).agg((F.max(idx) + 1).alias("_n"), F.count(F.lit(1)).alias("_rows"))
    amount = uniform(seed, key, "width") * max_fraction * F.col("_n")
    d = with_facts(df, n, key, "_rows").withColumns({"_l": F.floor(amount / 2), "_r": F.floor(amount / 2) + F.col("_n") - F.floor(amount)})
    d = d.where((F.col(idx) >= F.col("_l")) & (F.col(idx) < F.col("_r")))
    return d.withColumn(idx, (F.col(idx) - F.col("_l")).cast("long")).drop("_l", "_r", "_n")


def random_depth_limits(df: DataFrame, seed: int, p_none: float = 0.1, p_optimal: float = 0.1, p_close: float = 0.4, p_near_side: float = 0.5,
                        fraction: float = 0.25, key: Sequence[str] = KEY, rows: int | None = None) -> DataFrame:
    """Random depth crop per window: ``crop_lo``, ``crop_hi``, ``branch`` and ``error``.

    Branches: none, optimal, close to optimal, random. The limits that a crop may take
    come from the lines; a window whose limits contradict each other gets an error row.
    """
    from .lines import optimal_limits  # noqa: PLC0415

    key = list(key)
    step = F.abs(F.col("depth_stop") - F.col("depth_start")) / (F.size("sv") - 1)
    lo_g, hi_g = F.least("depth_start", "depth_stop"), F.greatest("depth_start", "depth_stop")
    old_b = "bottom_original" if "bottom_original" in df.columns else "bottom"
    g = df.groupBy(*key).agg(
        F.first("is_upfacing").alias("up"), F.first(step).alias("st"), F.min(lo_g).alias("g0"), F.max(hi_g).alias("g1"),
        F.min("bottom").alias("bmin"), F.max("turbulence").alias("tmax"), F.min(F.when(F.col("surface") > lo_g, F.col("surface"))).alias("smin"),
        F.max(old_b).alias("bomax"),
    )
    qt = quantiles(df, key, "turbulence", [0.25, 0.5], "qt", rows).drop("_count")
    qb = quantiles(df, key, old_b, [0.5], "qb", rows).drop("_count")
    g = cut(g.join(qt, key).join(qb, key).join(optimal_limits(df, key), key), "limits")
    c = F.col
    t25, t50, b50 = F.get("qt", F.lit(0)), F.get("qt", F.lit(1)), F.get("qb", F.lit(0))
    g = g.withColumns({"top_deep": F.greatest(c("g0") + c("st"), c("bmin") - c("st")), "bot_shal": F.least(c("g1") - c("st"), F.greatest("tmax", "bmin"))})
    g = g.withColumns(
        {
            "opt_top": F.when(c("up"), F.greatest("g0", F.coalesce("smin", "g0"))).otherwise(c("g0")),
            "opt_bot": F.when(c("up"), c("g1")).otherwise(c("bomax")),
        }
    )
    rng = F.abs(c("opt_bot") - c("opt_top"))
    g = g.withColumns({"grow": fraction * rng, "shrink": rng * fraction / (1 + fraction)})
    g = g.withColumns(
        {
            "ct0": F.least("top_deep", F.greatest(c("g0"), c("opt_top") - c("grow"))),
            "ct1": F.least(c("top_deep"), c("opt_top") + c("shrink"), t25),
            "cb0": F.least(c("g1"), F.when(c("up"), F.greatest(c("bot_shal"), c("opt_bot") - c("shrink"))).otherwise(F.greatest(c("bot_shal"), c("opt_bot") - c("shrink"), b50))),
            "cb1": F.least(c("g1"), F.greatest("bot_shal", "opt_bot") + c("grow")),
        }
    )
    g = g.withColumns(
        {
            "rt1": F.greatest(c("g0"), F.least(c("top_deep"), F.greatest(t50, c("opt_top") + c("shrink")))),
            "rb0": F.least(c("g1"), F.when(c("up"), c("cb0")).otherwise(F.greatest(c("bot_shal"), b50))),
        }
    )
    bad = (c("ct0") > c("ct1")) | (c("cb0") > c("cb1")) | (c("ct1") >= c("cb0")) | (c("g0") > c("rt1")) | (c("rb0") > c("g1")) | (c("rt1") >= c("rb0"))
    u = lambda name: uniform(seed, key, name)
    # What is left of the first draw decides between close and random.
    left = u("branch") - p_none - p_optimal
    branch = F.when(u("branch") < p_none, "none").when(left < 0, "optimal").when(left < p_close, "close").otherwise("random")
    close_lo = F.when(u("grow-top") < 0.5, between(u("top"), c("ct0"), c("opt_top"))).otherwise(between(u("top"), c("opt_top"), c("ct1")))
    close_hi = F.when(u("grow-low") < 0.5, between(u("low"), c("cb0"), c("opt_bot"))).otherwise(between(u("low"), c("opt_bot"), c("cb1")))
    side = u("near-side") < p_near_side
    rand_lo = F.when(c("up") | side, between(u("top"), c("g0"), c("rt1"))).otherwise(c("opt_top"))
    rand_hi = F.when(~c("up") | side, between(u("low"), c("rb0"), c("g1"))).otherwise(c("opt_bot"))
    g = g.withColumn("branch", branch)
    g = g.withColumn("error", F.when(c("branch").isin("close", "random") & bad, F.lit("limits contradict each other")))

    def pick(none, optimal, close, rand):
        return F.when(c("error").isNotNull(), F.lit(None).cast("double")).when(c("branch") == "none", none).when(c("branch") == "optimal", optimal).when(
            c("branch") == "close", close).otherwise(rand)

    null = F.lit(None).cast("double")
    return g.select(*key, "branch", "error", pick(null, c("crop_lo"), close_lo, rand_lo).alias("crop_lo"), pick(null, c("crop_hi"), close_hi, rand_hi).alias("crop_hi"))


def resample_time(df: DataFrame, seed: int, n_out: int, p: float = 1.0, elastic: float | None = None, sigma: float = 8.0,
                  cols: Sequence[str] = ("signal",), key: Sequence[str] = KEY, idx: str = "ping_index", rows: int | None = None) -> DataFrame:
    """Resample windows onto a new random time grid, linear.

    By default the new grid is sorted uniform draws. With ``elastic`` it is the even grid
    shifted by smoothed noise of that relative size. Windows drawn with probability 1-p keep
    the even grid. Positions are in pings; the output index counts the new grid.
    """
    key = list(key)
    n = df.groupBy(*key).agg((F.max(idx) + 1).alias("_n"))
    g = n.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n_out - 1))))
    even = F.col("_k") * (F.col("_n") - 1) / max(n_out - 1, 1)
    use = uniform(seed, key, "use") <= p
    if elastic is None:
        g = g.withColumn("_x", F.when(use, uniform(seed, [*key, "_k"], "x") * (F.col("_n") - 1)).otherwise(even))
    else:
        gap = (F.col("_n") - 1) / max(n_out - 1, 1)
        noise = gap * 2 * (uniform(seed, [*key, "_k"], "x") - 0.5)
        g = gaussian_time(cut(g.withColumn("_d", noise), "grid"), "_d", sigma, mode="symmetric", key=key, idx="_k", rows=rows)
        g = g.withColumn("_x", F.when(use, F.greatest(F.lit(0.0), F.least((F.col("_n") - 1).cast("double"), even + F.col("_d") * elastic * F.col("_n")))).otherwise(even))
    # Sorting the new positions is counting them.
    g = dense_index(cut(g.select(*key, "_k", "_x"), "grid"), key, ["_x", "_k"], "_out", rows).drop("_k")
    src = df.select(*key, F.col(idx).cast("double").alias("_x"), *[F.struct(F.col(idx).cast("double").alias("x"), F.col(c).cast("double").alias("y")).alias(f"_p_{c}") for c in cols])
    u = g.unionByName(src, allowMissingColumns=True)
    outs = {}
    for c in cols:
        outs[f"_b_{c}"], outs[f"_a_{c}"] = ("last", f"_p_{c}"), ("next", f"_p_{c}")
    s = scan(value_block(u, key, "_x", rows), key, ["_x"], outs, blocked=True).where(F.col("_out").isNotNull())
    return s.select(*key, F.col("_out").alias(idx), F.col("_x").alias("position"), *[linear_between(F.col("_x"), F.col(f"_b_{c}"), F.col(f"_a_{c}")).alias(c) for c in cols])


def order_choice(seed: int, key: Sequence, orders: Sequence[int] = (0, 1)) -> Column:
    """Resampling order drawn evenly from ``orders``."""
    i = F.floor(uniform(seed, key, "order") * len(orders)).cast("int")
    return F.get(F.array(*[F.lit(o) for o in orders]), i)

