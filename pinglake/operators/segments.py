"""Splitting recordings into segments, overlap padding, joining back, windows, padding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .blocks import index_block, join_facts, scan, shift
from .quantiles import quantiles

KEY = ("transect_id",)
SHARD = 128


def split_gaps(df: DataFrame, threshold: float = 20, percentile: float = 97.5, key: Sequence[str] = KEY,
               idx: str = "ping_index", ts: str = "ts_s", out: str = "segment_id", rows: int | None = None) -> DataFrame:
    """Number segments of contiguous recording from 0.

    A new segment starts where the step in time exceeds ``threshold`` times the given
    percentile of the recording's steps. Only index and time are worked on; the number
    joins the other columns by (recording, index).
    """
    steps = shift(df.select(*key, idx, ts), key, {"_pt": (ts, 1)}, idx, rows)
    steps = cut(steps.select(*key, idx, (F.col(ts) - F.col("_pt")).alias("_dt")), "steps")
    base = quantiles(steps, key, "_dt", [percentile / 100.0], rows=rows).select(*key, F.get("q", F.lit(0)).alias("_q"))
    d = join_facts(steps, base, key)
    # Breaks are few: the pings are numbered from the table of breaks' running count.
    d = d.withColumn("_break", F.coalesce((F.col("_dt") > F.col("_q") * threshold).cast("int"), F.lit(0)))
    seg = scan(cut(d.select(*key, idx, "_break"), "breaks"), key, [idx], {out: ("sum", "_break")}, rows=rows).drop("_break")
    return df.drop(out).join(seg, [*key, idx])


def segment_table(df: DataFrame, max_length: int = 0, key: Sequence[str] = KEY, idx: str = "ping_index",
                  segment: str = "segment_id", rows: int | None = None) -> DataFrame:
    """One row per segment: its index range, its number of parts and the first part's number.

    Parts are near-equal and at most ``max_length`` pings (0: one part). ``total`` is the
    length of the recording.
    """
    b = df.groupBy(*key, segment).agg(F.min(idx).alias("seg_start"), (F.max(idx) + 1).alias("seg_end"))
    size = F.col("seg_end") - F.col("seg_start")
    n = F.greatest(F.ceil(size / F.lit(max_length)).cast("long"), F.lit(1)) if max_length and max_length > 0 else F.lit(1).cast("long")
    b = cut(b.withColumn("n_parts", n), "segments")
    t = b.groupBy(*key).agg(F.max("seg_end").alias("total"))
    b = scan(index_block(b, "seg_start", rows), key, ["seg_start"], {"_upto": ("sum", "n_parts")}, blocked=True)
    return b.withColumn("first_part", F.col("_upto") - F.col("n_parts")).drop("_upto").join(t, list(key))


def _edge(j: Column) -> Column:
    a, b = F.col("seg_start"), F.col("seg_end")
    return F.bround(a + (b - a) * j / F.col("n_parts")).cast("long")


def cut_long(df: DataFrame, max_length: int = 0, key: Sequence[str] = KEY, idx: str = "ping_index",
             segment: str = "segment_id", rows: int | None = None) -> DataFrame:
    """Cut segments into near-equal parts of at most ``max_length`` pings, edges rounded half to even.

    Adds ``part_id`` (from 0 along the recording), ``part_start``, ``part_end``, whether
    each edge comes from the length limit (``cut_before``/``cut_after``) and ``total``.
    Segment bounds are a small table; a ping's part is arithmetic on its index.
    """
    d = df.join(segment_table(df, max_length, key, idx, segment, rows), [*key, segment])
    a, b = F.col("seg_start"), F.col("seg_end")
    # The part is the proportional guess or a neighbour of it, since edges are rounded.
    d = d.withColumn("_g", F.floor((F.col(idx) - a) * F.col("n_parts") / (b - a)).cast("long"))
    g = F.col("_g")
    part = F.when(F.col(idx) < _edge(g), g - 1).when(F.col(idx) >= _edge(g + 1), g + 1).otherwise(g)
    d = d.withColumn("_part", F.greatest(F.lit(0), F.least(part, F.col("n_parts") - 1)))
    p = F.col("_part")
    return d.withColumns(
        {
            "part_id": F.col("first_part") + p,
            "part_start": _edge(p),
            "part_end": _edge(p + 1),
            "cut_before": p > 0,
            "cut_after": p < F.col("n_parts") - 1,
        }
    ).drop("_g", "_part", "seg_start", "seg_end", "n_parts", "first_part")


def pad_overlap(df: DataFrame, pad: int = 32, pad_on: str = "max", key: Sequence[str] = KEY, idx: str = "ping_index") -> DataFrame:
    """Repeat pings near part edges in the neighbouring parts.

    ``pad_on`` chooses the edges: ``max`` those from the length limit, ``thr`` those from
    recording gaps, ``all``, or ``none``; recording ends are never padded. Output: one row
    per (part, ping) with ``is_pad``, and ``pad_start``/``pad_end``, the pings repeated on
    each side. Padding stops at the recording's ends, so it may be shorter than ``pad``.

    Each part lists the at most 2*``pad`` indices it needs, and those are looked up by key.
    """
    if pad_on not in {"max", "thr", "all", "none"}:
        raise ValueError(f"unknown pad_on {pad_on!r}")
    on_before = {"max": F.col("cut_before"), "thr": ~F.col("cut_before"), "all": F.lit(True), "none": F.lit(False)}[pad_on]
    on_after = {"max": F.col("cut_after"), "thr": ~F.col("cut_after"), "all": F.lit(True), "none": F.lit(False)}[pad_on]
    room = F.col("total") - F.col("part_end")
    d = df.withColumns(
        {
            "pad_start": F.when(on_before, F.least(F.lit(pad), F.col("part_start"))).otherwise(F.lit(0)).cast("long"),
            "pad_end": F.when(on_after, F.least(F.lit(pad), room)).otherwise(F.lit(0)).cast("long"),
            "is_pad": F.lit(False),
        }
    ).drop("cut_before", "cut_after", "total")
    of_part = ["part_id", "part_start", "part_end", "pad_start", "pad_end"]
    parts = d.where(F.col(idx) == F.col("part_start")).select(*key, *of_part)
    none = F.expr("cast(array() as array<bigint>)")
    a, b = F.col("part_start"), F.col("part_end")
    want = parts.withColumn(
        idx,
        F.explode(
            F.concat(
                F.when(F.col("pad_start") > 0, F.sequence(a - F.col("pad_start"), a - 1)).otherwise(none),
                F.when(F.col("pad_end") > 0, F.sequence(b, b + F.col("pad_end") - 1)).otherwise(none),
            )
        ),
    )
    copies = d.drop(*of_part).join(want, [*key, idx]).withColumn("is_pad", F.lit(True))
    return d.unionByName(copies)


def join_parts(df: DataFrame, raise_on_mismatch: bool = True, key: Sequence[str] = KEY, idx: str = "ping_index",
               grid: Sequence[str] = ("depth_start", "depth_stop")) -> DataFrame:
    """Undo ``pad_overlap``: drop repeated pings. All parts must share one depth grid."""
    d = df.where(~F.col("is_pad"))
    grid = [g for g in grid if g in df.columns]
    if grid and raise_on_mismatch:
        spread = [F.max(g) - F.min(g) <= 1e-8 + 1e-5 * F.abs(F.min(g)) for g in grid]
        ok = spread[0]
        for s in spread[1:]:
            ok = ok & s
        chk = df.groupBy(*key).agg(ok.alias("_ok"))
        d = d.join(chk, list(key)).withColumn(
            "_ok", F.when(F.col("_ok"), F.lit(True)).otherwise(F.raise_error(F.lit("parts have different depth grids")).cast("boolean"))
        ).where("_ok").drop("_ok")
    return d.drop("is_pad", "pad_start", "pad_end", "part_id", "part_start", "part_end")


def source_index(k: Column, n: Column, mode: str) -> Column:
    """Index inside [0, n) that stands in for k when a recording is extended."""
    if mode == "edge":
        return F.greatest(F.lit(0), F.least(k, n - 1))
    if mode == "reflect":
        period = F.greatest(2 * (n - 1), F.lit(1))
        m = F.pmod(k, period)
        return F.when(n == 1, F.lit(0)).otherwise(F.when(m < n, m).otherwise(2 * (n - 1) - m))
    if mode == "symmetric":
        m = F.pmod(k, F.greatest(2 * n, F.lit(1)))
        return F.when(m < n, m).otherwise(2 * n - 1 - m)
    if mode == "constant":
        return F.when((k >= 0) & (k < n), k)
    raise ValueError(f"unknown padding mode {mode!r}")


def stood_for(i: Column, n: Column, pad: int, mode: str) -> Column:
    """Positions k outside [0, n), at most ``pad`` away, for which ``source_index`` gives i."""
    first, last = F.lit(-pad).cast("long"), n + pad - 1
    if mode == "constant":
        return F.expr("cast(array() as array<bigint>)")
    if mode in ("reflect", "symmetric"):
        # Every position that is i, or its mirror image, up to whole periods.
        period, mirror = (2 * (n - 1), -i) if mode == "reflect" else (2 * n, -i - 1)
        period = F.greatest(period, F.lit(1)).cast("long")
        ks = [F.sequence(first + F.pmod(c - first, period), last, period) for c in (i, mirror)]
        # A period may have no place in reach: the sequence would run backwards.
        ks = [F.when(first + F.pmod(c - first, period) <= last, k).otherwise(F.expr("cast(array() as array<bigint>)")) for c, k in zip((i, mirror), ks)]
        return F.filter(F.array_union(*ks), lambda k: (k < 0) | (k >= n))
    if mode == "edge":
        none = F.expr("cast(array() as array<bigint>)")
        low = F.when((i == 0) & F.lit(pad > 0), F.sequence(first, F.lit(-1).cast("long"))).otherwise(none)
        high = F.when((i == n - 1) & F.lit(pad > 0), F.sequence(n, last)).otherwise(none)
        return F.concat(low, high)
    raise ValueError(f"unknown padding mode {mode!r}")


def pad_in_time(df: DataFrame, pad: int, mode: str = "reflect", previous: str = "diff", key: Sequence[str] = KEY,
                idx: str = "ping_index") -> DataFrame:
    """Extend every recording (or part) by ``pad`` pings on either side.

    ``edge`` repeats the end ping, ``reflect`` mirrors about it, ``symmetric`` mirrors with
    the end ping repeated, ``constant`` gives NULL columns (fill them with 0 for zeros). Earlier padding in ``pad_start``/``pad_end`` is
    topped up (``diff``), added to (``add``), or left alone where present (``noop``).
    Index starts at -added; ``pad_start``/``pad_end`` give the new totals. Rows outside
    the recording come from the few pings that stand in for them.
    """
    if previous not in {"diff", "add", "noop"}:
        raise ValueError(f"unknown previous padding rule {previous!r}")
    has = "pad_start" in df.columns
    d = df if has else df.withColumns({"pad_start": F.lit(0).cast("long"), "pad_end": F.lit(0).cast("long")})

    def amount(c):
        old = F.col(c)
        return {
            "diff": F.greatest(F.lit(0), F.lit(pad) - old),
            "add": F.lit(pad) + old * 0,
            "noop": F.when(old != 0, F.lit(0)).otherwise(F.lit(pad)),
        }[previous].cast("long")

    ends = d.groupBy(*key).agg(
        F.min(idx).cast("long").alias("_lo"), F.max(idx).cast("long").alias("_hi"),
        F.first(amount("pad_start")).alias("_a"), F.first(amount("pad_end")).alias("_b"),
        F.first("pad_start").alias("_ps"), F.first("pad_end").alias("_pe"),
    )
    n = F.col("_hi") - F.col("_lo") + 1
    others = [c for c in d.columns if c not in (*key, idx)]
    # Each ping says which positions beyond the ends it stands in for: nothing but a row per recording meets the pings.
    body = d.join(ends, list(key)).withColumn(idx, F.col(idx).cast("long"))
    i = F.col(idx) - F.col("_lo")
    reach = F.filter(stood_for(i, n, pad, mode), lambda k: (k >= -F.col("_a")) & (k < n + F.col("_b")))
    body = body.withColumn("_k", F.explode(F.concat(F.array(i), reach))).withColumn("is_extra", F.col("_k") != i)
    out = body.select(*key, (F.col("_k") + F.col("_lo")).alias(idx), *others, "_a", "_b", "is_extra")
    if mode == "constant":
        none = F.expr("cast(array() as array<bigint>)")
        low = F.when(F.col("_a") > 0, F.sequence(-F.col("_a"), F.lit(-1).cast("long"))).otherwise(none)
        high = F.when(F.col("_b") > 0, F.sequence(n, n + F.col("_b") - 1)).otherwise(none)
        fresh = ends.select(*key, "_lo", "_a", "_b", F.col("_ps").alias("pad_start"), F.col("_pe").alias("pad_end"), F.explode(F.concat(low, high)).alias("_k"))
        fresh = fresh.select(*key, (F.col("_k") + F.col("_lo")).alias(idx), "pad_start", "pad_end", "_a", "_b", F.lit(True).alias("is_extra"))
        out = out.unionByName(fresh, allowMissingColumns=True)
    return out.withColumn("pad_start", F.col("pad_start") + F.col("_a")).withColumn("pad_end", F.col("pad_end") + F.col("_b")).drop("_a", "_b")


def windows(lengths: DataFrame, window_len: int = 128, key: Sequence[str] = KEY, n: str = "n_pings",
            num_windows: int = 0, shift_by: Column | None = None, width: Column | None = None) -> DataFrame:
    """Window centres over recordings of known length.

    ceil(n/window_len) windows (or ``num_windows``), evenly spread, centres rounded half
    to even. By default they sit in the middle of their share; ``shift_by`` (0..1) shifts
    them instead, and ``width`` overrides the width.
    """
    nn = F.col(n)
    k = F.lit(num_windows) if num_windows else F.ceil(nn / F.lit(window_len))
    k = k.cast("int")
    d = lengths.where(nn > 0).withColumn("_k", k).withColumn("window", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    share = nn / F.col("_k")
    off = F.lit(0.5) if shift_by is None else shift_by
    d = d.withColumn("center", F.bround(F.col("window") * share + off * share).cast("long"))
    wlen = F.lit(window_len) if width is None else F.bround(width).cast("long")
    d = d.withColumn("width", wlen.cast("long"))
    i1 = F.col("center") - F.floor(F.col("width") / 2)
    return d.drop("_k").withColumns({"i1": i1.cast("long"), "i2": (i1 + F.col("width")).cast("long")})


def read_ranges(pings: DataFrame, ranges: DataFrame, mode: str = "edge", key: Sequence[str] = KEY,
                idx: str = "ping_index", shard_len: int = SHARD, lengths: DataFrame | None = None) -> DataFrame:
    """Pings of index ranges [i1, i2), extended by ``mode`` beyond the recording's ends.

    The join is on (recording, shard, index), so a stored shard column prunes the read.
    A range wholly outside its recording is an error.
    """
    if lengths is None:
        lengths = pings.groupBy(*key).agg((F.max(idx) + 1).alias("n_pings"))
    r = ranges.drop("n_pings").join(lengths.select(*key, "n_pings"), list(key))
    outside = (F.col("i1") > F.col("n_pings")) | (F.col("i2") < 0)
    r = r.withColumn("i1", F.when(outside, F.raise_error(F.lit("range is wholly outside its recording")).cast("long")).otherwise(F.col("i1")))
    r = r.withColumn("out_index", F.explode(F.sequence(F.col("i1"), F.col("i2") - 1)))
    lo = F.greatest(F.col("i1"), F.lit(0))
    hi = F.least(F.col("i2"), F.col("n_pings"))
    # Extension happens inside the part that was read, as it is all a reader holds.
    src = source_index(F.col("out_index") - lo, hi - lo, mode) + lo
    r = r.withColumn(idx, src.cast("long")).withColumn("shard", F.floor(F.col(idx) / F.lit(shard_len)).cast("long")).drop("n_pings")
    p = pings if "shard" in pings.columns else pings.withColumn("shard", F.floor(F.col(idx) / F.lit(shard_len)).cast("long"))
    how = "left" if mode == "constant" else "inner"
    return r.join(p, [*key, "shard", idx], how)
