"""Runs of a per-ping flag: finding, merging, and turning them into time regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .blocks import BLOCK, HOME, in_block, scan, shift, with_halo

KEY = ("transect_id",)


def flag_runs(df: DataFrame, flag: str, key: Sequence[str] = KEY, idx: str = "ping_index", max_step: int = 1,
              rows: int | None = None) -> DataFrame:
    """Runs of pings with the flag set: first and last index, both included.

    Set pings at most ``max_step`` apart belong to one run. A run begins where the latest
    earlier set ping is further away; runs are numbered by a running count and reduced to
    their ends before they meet in one place.
    """
    d = numbered_runs(df.where(flag).select(*key, idx), key, idx, max_step, rows)
    return d.groupBy(*key, "run").agg(F.min(idx).alias("first"), F.max(idx).alias("last"), F.count(F.lit(1)).alias("n_set"))


def numbered_runs(pings: DataFrame, key: Sequence[str] = KEY, idx: str = "ping_index", max_step: int = 1,
                  rows: int | None = None) -> DataFrame:
    """Number (from 1) of the run each of the given pings belongs to, as column ``run``."""
    w = in_block(key, idx)
    d = with_halo(pings, idx, max_step, 0, rows)
    prev = F.lag(idx).over(w)
    d = d.withColumn("_new", F.when(prev.isNull() | (F.col(idx) - prev > max_step), 1).otherwise(0)).where(HOME).drop(HOME, BLOCK)
    return scan(d, key, [idx], {"run": ("sum", "_new")}, rows=rows).drop("_new")


def exclusive_runs(df: DataFrame, flag: str, key: Sequence[str] = KEY, idx: str = "ping_index", rows: int | None = None) -> DataFrame:
    """Runs with half-open bounds [start, end)."""
    return flag_runs(df, flag, key, idx, rows=rows).select(
        *key, F.col("first").alias("start"), (F.col("last") + 1).alias("end")
    )


def squash_gaps(df: DataFrame, flag: str, max_gap: int | Column, key: Sequence[str] = KEY, idx: str = "ping_index",
                out: str | None = None, rows: int | None = None) -> DataFrame:
    """Clear runs of set pings no longer than min(max_gap, n-1)-1, end runs included."""
    out = out or flag
    src = df.withColumn("_f", F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))
    gap = max_gap if isinstance(max_gap, Column) else F.lit(max_gap)
    lengths = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    # The run a set ping lies in is bounded by the nearest clear pings on either side.
    src = src.withColumn("_clear", F.when(~F.col("_f"), F.col(idx).cast("long")))
    s = scan(src, key, [idx], {"_lo": ("last", "_clear"), "_hi": ("next", "_clear")}, rows=rows)
    s = s.join(lengths, list(key))
    length = F.coalesce(F.col("_hi"), F.col("_n")) - F.coalesce(F.col("_lo"), F.lit(-1)) - 1
    keep = F.col("_f") & (length > F.least(gap, F.col("_n") - 1) - 1)
    return s.withColumn(out, keep).drop("_f", "_clear", "_lo", "_hi", "_n")


def close_gaps(df: DataFrame, flag: str, collate: int, key: Sequence[str] = KEY, idx: str = "ping_index",
               rows: int | None = None) -> DataFrame:
    """Set the flag in gaps shorter than ``collate`` pings, gaps at the ends included."""
    if collate <= 1:
        return df
    d = squash_gaps(df.withColumn("_not", ~F.col(flag)), "_not", collate, key, idx, rows=rows)
    return d.withColumn(flag, ~F.col("_not")).drop("_not")


def flag_regions(df: DataFrame, flag: str, kind: str, collate: int = 0, min_length: float = 0, name_suffix: str = "",
                 key: Sequence[str] = KEY, idx: str = "ping_index", ts: str = "ts_s", rows: int | None = None) -> DataFrame:
    """Flagged stretches as rectangle regions.

    ``kind`` is ``passive`` or ``removed``. A stretch covers its pings plus half a ping
    either side, in time by linear interpolation (extrapolated at the ends). Stretches of
    length <= ``min_length`` are dropped, and ``min_length=-1`` drops all. Names count the
    kept stretches of a recording from 1.
    """
    title, label = {"passive": ("Passive data", "Passive"), "removed": ("Removed data block", "Removed block")}[kind]
    d = close_gaps(df.select(*key, idx, ts, F.coalesce(F.col(flag).cast("boolean"), F.lit(False)).alias("_flag")), "_flag", collate, key, idx, rows)
    d = shift(d, key, {"_pt": (ts, 1), "_nt": (ts, -1)}, idx, rows)
    d = d.withColumn("_left", F.coalesce((F.col(ts) + F.col("_pt")) / 2, F.col(ts) - (F.col("_nt") - F.col(ts)) / 2)).withColumn(
        "_right", F.coalesce((F.col(ts) + F.col("_nt")) / 2, F.col(ts) + (F.col(ts) - F.col("_pt")) / 2)
    )
    on = numbered_runs(cut(d.where("_flag"), "flagged"), key, idx, 1, rows)
    r = on.groupBy(*key, "run").agg(
        F.min(idx).alias("first"), F.max(idx).alias("last"), F.min("_left").alias("ts_start"), F.max("_right").alias("ts_end")
    )
    r = r.withColumn("length", (F.col("last") - F.col("first") + 1).cast("double"))
    r = cut(r.where(F.lit(min_length != -1) & (F.col("length") > min_length)), "runs")
    # ``run`` is dense before the length filter; a running count renumbers the rest.
    r = scan(r.withColumn("_one", F.lit(1)), key, ["run"], {"number": ("sum", "_one")}, rows=rows).drop("_one", "run")
    return r.select(
        *key,
        F.lit(kind).alias("kind"),
        F.col("number").cast("long").alias("number"),
        "first",
        "last",
        "length",
        "ts_start",
        "ts_end",
        F.concat(F.lit(f"{label}{name_suffix} "), F.col("number").cast("string")).alias("region_name"),
        F.format_string(
            f"{title}\nLength in pixels: %s\nDuration in seconds: %s",
            F.col("length").cast("string"),
            (F.col("ts_end") - F.col("ts_start")).cast("string"),
        ).alias("notes"),
        F.lit(4).alias("creation_type"),
        F.lit(0).alias("region_type"),
    )
