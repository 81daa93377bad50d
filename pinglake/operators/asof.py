"""Two-sided as-of interpolation and interval flags, without pairing rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import scan, value_block


def linear_between(x: Column, before: Column, after: Column) -> Column:
    """Value at x between two (x, y) neighbours; the nearer end is held outside."""
    slope = (after["y"] - before["y"]) / (after["x"] - before["x"])
    return (
        F.when(before.isNull(), after["y"])
        .when(after.isNull(), before["y"])
        .when(after["x"] <= before["x"], before["y"])
        .otherwise(before["y"] + slope * (x - before["x"]))
    )


def interpolate_onto(targets: DataFrame, points: DataFrame, key: Sequence[str], x: str,
                     cols: Sequence[str], rows: int | None = None) -> DataFrame:
    """Lines on their own times, interpolated at the target times.

    Every column of ``cols`` is a line; its undefined (NULL) points are skipped. Between
    points the value is linear, outside them the end value is held. Points of one
    recording need distinct x. Both inputs go through one shuffle.
    """
    other = [c for c in targets.columns if c not in (*key, x)]
    t = targets.select(*key, x, F.struct(*other).alias("_row"))
    p = points.select(
        *key, x, *[F.when(F.col(c).isNotNull(), F.struct(F.col(x).cast("double").alias("x"), F.col(c).cast("double").alias("y"))).alias(f"_p_{c}") for c in cols]
    )
    u = t.unionByName(p, allowMissingColumns=True)
    outs = {}
    for c in cols:
        outs[f"_b_{c}"] = ("last", f"_p_{c}")
        outs[f"_a_{c}"] = ("next", f"_p_{c}")
    s = scan(value_block(u, key, x, rows), key, [x], outs, blocked=True).where(F.col("_row").isNotNull())
    return s.select(
        *key, x, "_row.*", *[linear_between(F.col(x), F.col(f"_b_{c}"), F.col(f"_a_{c}")).alias(c) for c in cols]
    )


def fill_linear(df: DataFrame, key: Sequence[str], x: str, cols: Sequence[str], idx: str = "ping_index",
                suffix: str = "", rows: int | None = None) -> DataFrame:
    """NULL rows of line columns filled from the other rows of the same recording."""
    d = df
    outs = {}
    for c in cols:
        d = d.withColumn(f"_p_{c}", F.when(F.col(c).isNotNull(), F.struct(F.col(x).cast("double").alias("x"), F.col(c).cast("double").alias("y"))))
        outs[f"_b_{c}"] = ("last", f"_p_{c}")
        outs[f"_a_{c}"] = ("next", f"_p_{c}")
    d = scan(d, key, [idx], outs, rows=rows)
    for c in cols:
        d = d.withColumn(
            c + suffix, F.coalesce(F.col(c).cast("double"), linear_between(F.col(x), F.col(f"_b_{c}"), F.col(f"_a_{c}")))
        )
    return d.drop(*[f"_{k}_{c}" for k in "pba" for c in cols])


def flag_in_intervals(targets: DataFrame, intervals: DataFrame, key: Sequence[str], x: str, start: str, stop: str,
                      out: str, closed: bool = True, rows: int | None = None) -> DataFrame:
    """True where x falls in any interval of its recording.

    Starts add one and stops take one away; a target is inside while the running total is
    positive. ``closed`` includes the stop. Cost does not depend on how long or how
    overlapping the intervals are.
    """
    other = [c for c in targets.columns if c not in (*key, x)]
    t = targets.select(
        *key, F.col(x).cast("double").alias("_x"), F.lit(1).alias("_rank"), F.lit(0).alias("_step"),
        F.struct(x, *other).alias("_row"),
    )
    # A target at x meets starts at x already applied, and stops at x not yet (closed) or already (open).
    iv = intervals.where(F.col(start) <= F.col(stop) if closed else F.col(start) < F.col(stop))
    a = iv.select(*key, F.col(start).cast("double").alias("_x"), F.lit(0).alias("_rank"), F.lit(1).alias("_step"))
    b = iv.select(*key, F.col(stop).cast("double").alias("_x"), F.lit(2 if closed else 0).alias("_rank"), F.lit(-1).alias("_step"))
    u = t.unionByName(a, allowMissingColumns=True).unionByName(b, allowMissingColumns=True)
    s = scan(value_block(u, key, "_x", rows), key, ["_x", "_rank"], {"_open": ("sum", "_step")}, blocked=True)
    return s.where(F.col("_row").isNotNull()).select(*key, "_row.*", (F.col("_open") > 0).alias(out))


def grids_match(a: DataFrame, b: DataFrame, key: Sequence[str], idx: str, cols: Sequence[str],
                rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Per recording: same length, and every column of ``cols`` close at every index."""
    left = a.select(*key, idx, F.struct(*cols).alias("_l"))
    right = b.select(*key, idx, F.struct(*cols).alias("_r"))
    j = left.join(right, [*key, idx], "full_outer")
    close = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    for c in cols:
        close = close & (F.abs(F.col(f"_l.{c}") - F.col(f"_r.{c}")) <= atol + rtol * F.abs(F.col(f"_r.{c}")))
    return j.groupBy(*key).agg(
        F.count("_l").alias("n_left"), F.count("_r").alias("n_right"), F.bool_and(F.coalesce(close, F.lit(False))).alias("same_grid")
    )


def nearest_cell(points: DataFrame, grid: DataFrame, key: Sequence[str], x: str, grid_x: str, grid_idx: str,
                 out: str, half_step: str, rows: int | None = None) -> DataFrame:
    """First grid index whose value plus half a step reaches x; the grid length if none does.

    ``half_step`` is a column of ``grid``, constant per recording.
    """
    other = [c for c in points.columns if c not in (*key, x)]
    p = points.select(*key, F.col(x).cast("double").alias("_x"), F.struct(x, *other).alias("_row"))
    g = grid.select(
        *key,
        (F.col(grid_x) + F.col(half_step)).cast("double").alias("_x"),
        F.col(grid_idx).cast("long").alias("_i"),
        F.col(grid_idx).cast("long").alias("_last"),
    )
    u = p.unionByName(g, allowMissingColumns=True)
    s = scan(value_block(u, key, "_x", rows), key, ["_x"], {"_hit": ("next", "_i"), "_below": ("last", "_last")}, blocked=True)
    return s.where(F.col("_row").isNotNull()).select(
        *key, "_row.*", F.coalesce(F.col("_hit"), F.col("_below") + 1).alias(out)
    )
