"""Statistics over recordings and data sets, and integration over a grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .blocks import with_facts
from .grid import samples
from .quantiles import quantiles

KEY = ("transect_id",)
# Percentiles reported per segment.
PERCENTILES = (0, 0.1, 1, 5, 7, 10, 15, 20, 25, 30, 35, 40, 50, 75, 90, 93, 95, 99, 99.9, 100)


def _cells(df: DataFrame, max_depth: float, by: Sequence[str], idx: str) -> DataFrame:
    """Cells used for statistics: first ping of a segment dropped, at least two left."""
    first = df.groupBy(*by).agg(F.min(idx).alias("_i0"), F.count(F.lit(1)).alias("_n")).where("_n > 2")
    d = df.join(first, list(by)).where(F.col(idx) > F.col("_i0"))
    step = (F.col("depth_stop") - F.col("depth_start")) / (F.size("sv") - 1)
    s = samples(d, by, idx, carry=["depth_start", step.alias("_step")])
    return s.where((F.col("depth_start") + F.col("j") * F.col("_step") <= max_depth) & F.col("v").isNotNull()).select(*by, "v")


def segment_statistics(df: DataFrame, max_depth: float = 70, by: Sequence[str] = ("transect_id", "segment_id"), idx: str = "ping_index",
                       rows: int | None = None) -> DataFrame:
    """Per segment: mean, stdev, median, MAD, percentiles and spread about the 25th."""
    c = cut(_cells(df, max_depth, by, idx), "cells")
    m = c.groupBy(*by).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("stdev"))
    q = quantiles(c, by, "v", [p / 100 for p in PERCENTILES], "percentiles", rows).drop("_count")
    base = cut(
        m.join(q, list(by)).withColumns(
            {"median": F.get("percentiles", F.lit(PERCENTILES.index(50))), "_p25": F.get("percentiles", F.lit(PERCENTILES.index(25)))}
        ),
        "segment-base",
    )
    d = c.join(base.select(*by, "median", "_p25"), list(by))
    mad = quantiles(d.withColumn("_a", F.abs(F.col("v") - F.col("median"))), by, "_a", [0.5], "_q", rows).select(*by, F.get("_q", F.lit(0)).alias("mad"))
    s25 = d.groupBy(*by).agg(F.sqrt(F.avg(F.pow(F.col("v") - F.col("_p25"), 2))).alias("std25"))
    return base.drop("_p25").join(mad, list(by)).join(s25, list(by))


def dataset_statistics(df: DataFrame, max_depth: float = 70, by: Sequence[str] = ("transect_id", "segment_id"), idx: str = "ping_index",
                       rows: int | None = None) -> DataFrame:
    """Each segment statistic over all segments: mean, extremes, standard error, relative error.

    ``variance`` is the mean square about the mean of segment means.
    """
    s = cut(segment_statistics(df, max_depth, by, idx, rows), "segment-stats")
    p = lambda x: F.get("percentiles", F.lit(PERCENTILES.index(x)))
    est = {
        "mean": F.col("mean"), "median": F.col("median"), "stdev": F.col("stdev"), "mad": F.col("mad"), "iqr": p(75) - p(25),
        "idr": p(90) - p(10), "i7r": p(93) - p(7), "std25": F.col("std25"),
    }
    long = s.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("x")) for k, v in est.items()])).alias("_e")).select("_e.*")
    # One number reaches the driver. A segment's mean square about it follows from the
    # segment's own mean and spread, so the cells are not read again.
    m = s.agg(F.avg("mean")).first()[0]
    spread = F.pow("stdev", F.lit(2)) + F.pow(F.col("mean") - F.lit(m), F.lit(2))
    var = s.select(F.lit("variance").alias("name"), spread.alias("x"))
    sem = F.stddev_samp("x") / F.sqrt(F.count("x"))
    return long.unionByName(var).groupBy("name").agg(
        F.avg("x").alias("mean"), F.min("x").alias("low"), F.max("x").alias("high"), sem.alias("sem"),
        (sem / F.abs(F.avg("x")) * 100).alias("pc_error"),
    )


def echo_integration(df: DataFrame, minutes: float | None = 0.5, metres: float | None = 1.0, reference: str = "bottom",
                     above: str | None = None, below: str | None = None, bad: str | None = None, key: Sequence[str] = KEY,
                     idx: str = "ping_index", ts: str = "ts_s", value: str = "sv") -> DataFrame:
    """Sample count, extremes and mean level per cell of a time by depth grid.

    Depth bins are measured upwards from the reference line; ``None`` for either size
    means one bin. Samples above line ``above``, below line ``below`` or in pings flagged
    ``bad`` are left out. The mean is taken in linear units.
    """
    t0 = df.groupBy(*key).agg(F.min(ts).alias("_t0"), F.count(F.lit(1)).alias("_rows"))
    d = df.where(~F.col(bad)) if bad else df
    lines = [c for c in dict.fromkeys([reference, above, below]) if c]
    step = (F.col("depth_stop") - F.col("depth_start")) / (F.size(value) - 1)
    d = with_facts(d, t0, key, "_rows").select(
        *key, (F.floor((F.col(ts) - F.col("_t0")) / (60 * minutes)) if minutes else F.lit(0)).cast("long").alias("time_bin"),
        "depth_start", step.alias("_step"), *lines, F.posexplode(value).alias("j", "v"),
    )
    d = d.withColumn("depth", F.col("depth_start") + F.col("j") * F.col("_step")).where(F.col("v").isNotNull())
    if above:
        d = d.where(F.col("depth") > F.col(above))
    if below:
        d = d.where(F.col("depth") < F.col(below))
    b = F.floor((F.col(reference) - F.col("depth")) / metres) if metres else F.lit(0)
    # Partial aggregation leaves one row per cell and task before the shuffle.
    return d.withColumn("depth_bin", b.cast("long")).groupBy(*key, "time_bin", "depth_bin").agg(
        F.count("v").alias("n_samples"), F.min("v").alias("sv_min"), F.max("v").alias("sv_max"),
        (10 * F.log10(F.avg(F.pow(F.lit(10.0), F.col("v") / 10)))).alias("sv_mean"),
    )


def percentile_scan(df: DataFrame, first_cell: int = 34, key: Sequence[str] = KEY, idx: str = "ping_index", value: str = "sv",
                    rows: int | None = None) -> DataFrame:
    """For each whole percentile of the cells from ``first_cell`` on: how many pings never exceed it."""
    part = df.select(*key, idx, F.slice(value, F.lit(first_cell + 1), F.greatest(F.size(value) - first_cell, F.lit(0))).alias("_v"))
    q = quantiles(samples(part, key, idx, "_v"), key, "v", [i / 100 for i in range(100)], rows=rows).drop("_count")
    top = part.select(*key, F.array_max("_v").alias("_top")).join(q, list(key))
    # A ping counts from the first percentile at or above its maximum: that count is kept
    # per percentile and summed up, so a ping yields one row and not a hundred.
    k = F.when(F.col("_top").isNull(), F.lit(0)).otherwise(F.size(F.filter("q", lambda c: F.col("_top") > c)))
    at = top.withColumn("_k", k).groupBy(*key, "_k").agg(F.count(F.lit(1)).alias("_c")).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_c"))).alias("_m"))
    j = q.join(at, list(key)).select(*key, "_m", F.posexplode("q").alias("pc", "cut"))
    n = F.aggregate(F.sequence(F.lit(0), F.col("pc")), F.lit(0).cast("long"), lambda a, i: a + F.coalesce(F.try_element_at("_m", i), F.lit(0).cast("long")))
    return j.select(*key, "pc", "cut", n.alias("n_pings"))


