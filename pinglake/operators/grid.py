"""Depth grids: regridding ragged pings, facing, cropping, resizing, normalising, filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..session import cut
from .blocks import join_facts, scan, shift
from .quantiles import quantiles

KEY = ("transect_id",)


def grouped_mode(df: DataFrame, key: Sequence[str], value: str, out: str) -> DataFrame:
    """Most frequent non-NULL value per group, the smallest among ties."""
    c = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count(F.lit(1)).alias("_c"))
    top = c.groupBy(*key).agg(F.max("_c").alias("_top"))
    return c.join(top, list(key)).where(F.col("_c") == F.col("_top")).groupBy(*key).agg(F.min(value).alias(out))


def row_length(df: DataFrame, how: str = "mode", key: Sequence[str] = KEY, idx: str = "ping_index") -> DataFrame:
    """Cell count to use per recording, as column ``n_depth``, chosen from its row lengths."""
    d = df.select(*key, idx, (F.col("_len") if "_len" in df.columns else F.size("sv")).alias("_len"))
    if how == "min":
        return d.groupBy(*key).agg(F.min("_len").alias("n_depth"))
    if how == "max":
        return d.groupBy(*key).agg(F.max("_len").alias("n_depth"))
    if how == "init":
        return d.groupBy(*key).agg(F.min_by("_len", idx).alias("n_depth"))
    if how == "mode":
        return grouped_mode(d, key, "_len", "n_depth")
    if how == "median":
        # The median if it occurs, else it rounded if that occurs, else the median without
        # the last ping, which is then an observed length.
        seen = d.groupBy(*key).agg(F.collect_set("_len").alias("_seen"), F.max(idx).alias("_last"))
        m1 = quantiles(d, key, "_len", [0.5], "_q1").select(*key, F.get("_q1", F.lit(0)).alias("_m1"))
        rest = d.join(seen.select(*key, "_last"), list(key)).where(F.col(idx) < F.col("_last"))
        m2 = quantiles(rest, key, "_len", [0.5], "_q2").select(*key, F.get("_q2", F.lit(0)).alias("_m2"))
        j = seen.join(m1, list(key)).join(m2, list(key), "left")

        def occurs(c: Column):
            return F.exists("_seen", lambda x: x == c)

        pick = (
            F.when(occurs(F.col("_m1")), F.col("_m1"))
            .when(occurs(F.bround("_m1")), F.bround("_m1"))
            .otherwise(F.coalesce("_m2", F.bround("_m1")))
        )
        return j.select(*key, pick.cast("int").alias("n_depth"))
    raise ValueError(f"unknown row length rule {how!r}")


def regrid(df: DataFrame, how: str = "mode", skip: int = 0, threshold: float = 0.3, key: Sequence[str] = KEY,
           idx: str = "ping_index") -> DataFrame:
    """Put every ping of a recording on one depth grid.

    Input pings have their own ``sv`` length and ``depth_start``/``depth_stop``. The grid
    takes the length chosen by ``how`` and the usual extent of pings of that length. The
    per-recording choice is a small table joined back; resampling is per row.
    """
    d = df.where(F.col(idx) >= skip) if skip else df
    d = d.withColumn("sv", A.sentinel_to_null("sv"))
    # The choice needs three numbers per ping, not the samples.
    head = cut(d.select(*key, idx, F.size("sv").alias("_len"), "depth_start", "depth_stop"), "extents")
    n = cut(row_length(head, how, key, idx), "lengths")
    same = head.join(n, list(key)).where("_len = n_depth")
    if how == "median":
        a = quantiles(same, key, "depth_start", [0.5]).select(*key, F.get("q", F.lit(0)).alias("grid_start"))
        b = quantiles(same, key, "depth_stop", [0.5]).select(*key, F.get("q", F.lit(0)).alias("grid_stop"))
    else:
        a = grouped_mode(same, key, "depth_start", "grid_start")
        b = grouped_mode(same, key, "depth_stop", "grid_stop")
    grid = cut(n.join(a, list(key)).join(b, list(key)), "grid")
    d = join_facts(d, grid, key)
    down = F.col("depth_start") < F.col("depth_stop")
    d = d.withColumns(
        {
            "_v": F.when(down, F.col("sv")).otherwise(F.reverse("sv")),
            "_a": F.least("depth_start", "depth_stop"),
            "_b": F.greatest("depth_start", "depth_stop"),
        }
    )
    sv = A.regrid_keep_missing("_v", "_a", "_b", "grid_start", "grid_stop", F.col("n_depth"), threshold)
    # Most pings are on the grid already: there every sample stays as it is.
    fits = (F.col("depth_start") == F.col("grid_start")) & (F.col("depth_stop") == F.col("grid_stop")) & (F.size("sv") == F.col("n_depth"))
    some = F.size(F.filter("sv", lambda x: x.isNotNull())) >= 2
    sv = F.when(fits & (F.col("depth_start") != F.col("depth_stop")) & some, F.col("sv")).otherwise(sv)
    return d.withColumn("sv", sv).withColumn("depth_start", F.col("grid_start")).withColumn("depth_stop", F.col("grid_stop")).drop(
        "_v", "_a", "_b", "grid_start", "grid_stop", "n_depth"
    )


def face_down(df: DataFrame, facing: str = "auto", arrays: Sequence[str] = ("sv",)) -> DataFrame:
    """Turn pings so that depth increases; add ``is_upfacing`` and ``facing_mismatch``.

    ``auto`` follows the depth order; ``up``/``down`` force the answer, and only ``up``
    flips.
    """
    seen = F.col("depth_stop") < F.col("depth_start")
    if facing == "auto":
        flip, up, bad = seen, seen, F.lit(False)
    elif facing.startswith("up"):
        flip, up, bad = F.lit(True), F.lit(True), ~seen
    elif facing.startswith("down"):
        flip, up, bad = F.lit(False), F.lit(False), seen
    else:
        raise ValueError('facing must be one of "downward", "upward" and "auto"')
    cols = {c: F.when(flip, F.reverse(c)).otherwise(F.col(c)) for c in arrays}
    cols |= {
        "depth_start": F.when(flip, F.col("depth_stop")).otherwise(F.col("depth_start")),
        "depth_stop": F.when(flip, F.col("depth_start")).otherwise(F.col("depth_stop")),
        "is_upfacing": up,
        "facing_mismatch": bad,
    }
    return df.withColumns(cols)


def crop_depth(df: DataFrame, lo=None, hi=None, arrays: Sequence[str] = ("sv",)) -> DataFrame:
    """Keep cells with lo <= depth <= hi in every array column; bounds may be columns."""
    n = F.size(arrays[0])
    d = A.depth_grid(arrays[0])
    lo = F.lit(float("-inf")) if lo is None else (lo if isinstance(lo, Column) else F.lit(float(lo)))
    hi = F.lit(float("inf")) if hi is None else (hi if isinstance(hi, Column) else F.lit(float(hi)))
    # A NULL bound keeps everything on that side.
    lo, hi = F.coalesce(lo.cast("double"), F.lit(float("-inf"))), F.coalesce(hi.cast("double"), F.lit(float("inf")))
    inside = F.transform(d, lambda x: (x >= lo) & (x <= hi))
    c = df.withColumns({"_first": A.first_index(inside), "_last": A.last_index(inside), "_n": n})
    size = F.when(F.col("_first") < 0, F.lit(0)).otherwise(F.col("_last") - F.col("_first") + 1)
    step = (F.col("depth_stop") - F.col("depth_start")) / F.greatest(F.col("_n") - 1, F.lit(1))
    out = {a: F.slice(a, F.greatest(F.col("_first"), F.lit(0)) + 1, size) for a in arrays}
    out["_a"] = F.when(size > 0, F.col("depth_start") + F.col("_first") * step)
    out["_b"] = F.when(size > 0, F.col("depth_start") + F.col("_last") * step)
    return c.withColumns(out).withColumn("depth_start", F.col("_a")).withColumn("depth_stop", F.col("_b")).drop("_first", "_last", "_n", "_a", "_b")


def samples(df: DataFrame, key: Sequence[str] = KEY, idx: str = "ping_index", value: str = "sv", carry: Sequence[str] = ()) -> DataFrame:
    """One row per cell: position ``j`` and value ``v``."""
    return df.select(*key, idx, *carry, F.posexplode(value).alias("j", "v"))


_CENTER = {"mean": None, "median": 0.5, "pc10": 0.10}
_SPREAD = {"iqr": (0.25, 0.75, 1.35), "idr": (0.10, 0.90, 2.56), "i7r": (0.07, 0.93, 3.0)}
_MAD_SCALE = 1.4826


def signal_stats(df: DataFrame, center="mean", deviation="stdev", robust2stdev: bool = True, key: Sequence[str] = KEY,
                 idx: str = "ping_index", value: str = "sv", rows: int | None = None) -> DataFrame:
    """Centre and spread of all cells of each group, as columns ``center`` and ``deviation``."""
    s = samples(df, key, idx, value).where(F.col("v").isNotNull()).select(*key, "v")
    need, probs = df.select(*key).distinct(), []
    dev = deviation.lower() if isinstance(deviation, str) else deviation
    if isinstance(center, str):
        if center not in _CENTER:
            raise ValueError(f"unknown centre {center!r}")
        if _CENTER[center] is not None:
            probs.append(_CENTER[center])
    if isinstance(dev, str):
        if dev in _SPREAD:
            probs += list(_SPREAD[dev][:2])
        elif dev == "mad":
            probs.append(0.5)
        elif dev not in ("std", "stdev"):
            raise ValueError(f"unknown deviation {deviation!r}")
    probs = sorted(set(probs))
    out = need
    if probs:
        out = out.join(quantiles(s, key, "v", probs, "_q", rows).drop("_count"), list(key), "left")
    if center == "mean" or dev in ("std", "stdev"):
        out = out.join(s.groupBy(*key).agg(F.avg("v").alias("_mean"), F.stddev_pop("v").alias("_std")), list(key), "left")

    def q(p):
        return F.get("_q", F.lit(probs.index(p)))

    if dev == "mad":
        med = out.select(*key, q(0.5).alias("_med"))
        a = s.join(med, list(key)).select(*key, F.abs(F.col("v") - F.col("_med")).alias("_a"))
        out = out.join(quantiles(a, key, "_a", [0.5], "_m", rows).select(*key, F.get("_m", F.lit(0)).alias("_mad")), list(key), "left")
    c = F.lit(float(center)) if not isinstance(center, str) else (F.col("_mean") if center == "mean" else q(_CENTER[center]))
    if not isinstance(dev, str):
        spread = F.lit(float(dev))
    elif dev in ("std", "stdev"):
        spread = F.col("_std")
    elif dev == "mad":
        spread = F.col("_mad") * (_MAD_SCALE if robust2stdev else 1.0)
    else:
        lo, hi, scale = _SPREAD[dev]
        spread = (q(hi) - q(lo)) / (scale if robust2stdev else 1.0)
    return out.select(*key, c.alias("center"), spread.alias("deviation"))


def normalise(df: DataFrame, center="mean", deviation="stdev", robust2stdev: bool = True, key: Sequence[str] = KEY,
              idx: str = "ping_index", value: str = "sv", rows: int | None = None) -> DataFrame:
    """Shift by the centre and divide by the spread of the recording."""
    if isinstance(center, str) or isinstance(deviation, str):
        st = signal_stats(df, center, deviation, robust2stdev, key, idx, value, rows)
        d = join_facts(df, st, key)
    else:
        d = df.withColumns({"center": F.lit(float(center)), "deviation": F.lit(float(deviation))})
    c, s = F.col("center"), F.col("deviation")
    return d.withColumn(value, F.transform(value, lambda x: F.when(s != 0, (x - c) / s))).drop("center", "deviation")


def resize(df: DataFrame, n: int, order: int = 1, arrays: Sequence[str] = ("sv",)) -> DataFrame:
    """Resize the depth axis to n cells, order 0 (nearest) or 1 (linear).

    Values use the pixel-centre map; the depth grid keeps its end points.
    """
    fn = {0: A.resample_nearest, 1: A.resample_linear}
    if order not in fn:
        raise ValueError("order must be 0 or 1")
    return df.withColumns({a: fn[order](a, n) for a in arrays})


def fill_holes(df: DataFrame, min_missing: int = 2, margin: int = 4, key: Sequence[str] = KEY, idx: str = "ping_index",
               value: str = "sv", rows: int | None = None) -> DataFrame:
    """Fill missing cells inside the extent of the holes.

    The extent spans pings and depths with at least ``min_missing`` missing cells (the
    outermost pings not counted; if only one axis has such lines, any missing cell counts
    on the other), widened by ``margin``. A missing cell gets the mean of the linear fills
    along time and along depth that have a present cell on both sides inside the extent.
    """
    key = list(key)
    missing = F.filter(F.transform(value, lambda x, j: F.when(x.isNull(), j)), lambda j: j.isNotNull())
    # Which cells are missing says where the holes are: few numbers per ping, not its samples.
    head = cut(df.select(*key, idx, F.size(value).alias("_nd"), missing.alias("_na")), "holes")
    size = head.groupBy(*key).agg(F.min(idx).alias("_i0"), F.max(idx).alias("_i1"), F.max("_nd").alias("_nd"))
    inner = head.drop("_nd").join(size, key).where((F.col(idx) > F.col("_i0")) & (F.col(idx) < F.col("_i1")))
    by_ping = inner.where(F.size("_na") > 0).select(*key, idx, F.size("_na").alias("_c"))
    by_depth = inner.select(*key, F.explode("_na").alias("j")).groupBy(*key, "j").agg(F.count(F.lit(1)).alias("_c"))

    def extent(d, axis, lo, hi):
        many = F.col("_c") >= min_missing
        return d.groupBy(*key).agg(
            F.min(F.when(many, F.col(axis))).alias(f"{lo}m"), F.max(F.when(many, F.col(axis))).alias(f"{hi}m"),
            F.min(axis).alias(f"{lo}a"), F.max(axis).alias(f"{hi}a"),
        )

    e = size.join(extent(by_ping, idx, "_x0", "_x1"), list(key)).join(extent(by_depth, "j", "_y0", "_y1"), list(key))
    e = e.where(F.col("_x0m").isNotNull() | F.col("_y0m").isNotNull())
    # The depth axis keeps the shift by one that the extent has in time.
    e = e.select(
        *key,
        F.greatest(F.col("_i0"), F.coalesce("_x0m", "_x0a") - margin).alias("_x0"),
        F.least(F.col("_i1"), F.coalesce("_x1m", "_x1a") + margin).alias("_x1"),
        F.greatest(F.lit(0), F.coalesce("_y0m", "_y0a") + 1 - margin).alias("_y0"),
        F.least(F.col("_nd") - 1, F.coalesce("_y1m", "_y1a") + 1 + margin).alias("_y1"),
    )
    e = cut(e, "extents")
    # A missing cell is filled from the ends of its run of missing cells. Along time, an end is missing (or not there) in the
    # ping before or after it; so of a ping's cells those missing in it or next to it are all that is needed.
    near = shift(head, key, {"_na0": ("_na", 1), "_nd0": ("_nd", 1), "_na1": ("_na", -1), "_nd1": ("_nd", -1)}, idx, rows)
    none = F.expr("cast(array() as array<int>)")
    beyond = lambda n: F.when(F.col(n) < F.col("_nd"), F.sequence(F.col(n), F.col("_nd") - 1)).otherwise(none)
    places = F.array_distinct(F.concat("_na", *[F.coalesce(f"_na{i}", none) for i in (0, 1)], *[beyond(f"_nd{i}") for i in (0, 1)]))
    near = near.select(*key, idx, F.filter(places, lambda j: j < F.col("_nd")).alias("_near")).where(F.size("_near") > 0)
    near = near.join(e, key).where(F.col(idx).between(F.col("_x0"), F.col("_x1")))
    near = near.withColumn("_near", F.filter("_near", lambda j: j.between(F.col("_y0"), F.col("_y1")))).where(F.size("_near") > 0)
    box = df.select(*key, idx, F.col(value).alias("_cells")).join(near.select(*key, idx, "_near", "_y0", "_y1"), [*key, idx])
    # Along depth a ping's cells inside the extent are filled row by row.
    row = F.struct(F.slice("_cells", F.col("_y0") + 1, F.col("_y1") - F.col("_y0") + 1).alias("v"), "_cells", "_near", F.col("_y0").alias("y0"))

    def picked(r):
        n = F.size(r["v"])
        filled = A.regrid_keep_missing(r["v"], F.lit(0.0), (n - 1).cast("double"), F.lit(0.0), (n - 1).cast("double"), n, 2.0)
        filled = F.when(F.exists(r["_near"], lambda j: F.get(r["_cells"], j).isNull()), filled)
        return A.let(filled, lambda f: F.transform(r["_near"], lambda j: F.struct(j.alias("j"), F.get(r["_cells"], j).alias("v"), F.get(f, j - r["y0"]).alias("_fd"))))

    box = box.select(*key, idx, F.explode(A.let(row, picked)).alias("_z")).select(*key, idx, "_z.*")
    pt = lambda x: F.when(F.col("v").isNotNull(), F.struct(F.col(x).cast("double").alias("x"), F.col("v").alias("y")))
    t = scan(box.withColumn("_p", pt(idx)), [*key, "j"], [idx], {"_b": ("last", "_p"), "_a": ("next", "_p")}, rows=rows)
    both = t.where(F.col("v").isNull()).withColumn("_ft", _inside(F.col(idx)))
    fill = both.select(
        *key, idx, "j",
        ((F.coalesce("_ft", F.lit(0.0)) + F.coalesce("_fd", F.lit(0.0)))
         / F.nullif(F.col("_ft").isNotNull().cast("int") + F.col("_fd").isNotNull().cast("int"), F.lit(0))).alias("_f"),
    ).where(F.col("_f").isNotNull())
    maps = fill.groupBy(*key, idx).agg(F.map_from_entries(F.collect_list(F.struct("j", "_f"))).alias("_fills"))
    d = df.join(maps, [*key, idx], "left")
    new = F.transform(value, lambda x, j: F.coalesce(x, F.try_element_at("_fills", j)))
    return d.withColumn(value, F.when(F.col("_fills").isNull(), F.col(value)).otherwise(new)).drop("_fills")


def _inside(x: Column) -> Column:
    b, a = F.col("_b"), F.col("_a")
    return F.when(b.isNotNull() & a.isNotNull(), b["y"] + (a["y"] - b["y"]) * (x - b["x"]) / (a["x"] - b["x"]))
