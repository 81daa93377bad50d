"""Boundary lines: from masks and probabilities, fixing, offsetting, clipping, indexing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from .asof import fill_linear, interpolate_onto
from .blocks import with_facts

KEY = ("transect_id",)
UNDEFINED_DEPTH = -10000.99  # fixed value: marks an undefined depth in line files
LINES = ("surface", "turbulence", "bottom")


def is_undefined(depth) -> Column:
    """Whether a depth is the undefined marker, within relative 1e-5 and absolute 1e-8."""
    return F.abs(A.col(depth) - F.lit(UNDEFINED_DEPTH)) <= F.lit(1e-8 + 1e-5 * abs(UNDEFINED_DEPTH))


def lines_from_mask(df: DataFrame, mask: str = "mask", max_gap: float = 1.0, top: str = "turbulence_new",
                    low: str = "bottom_new") -> DataFrame:
    """Lines half a step outside the shallowest and deepest kept cells of each ping.

    Kept runs too short for ``max_gap`` metres are dropped first. The step is signed, so on
    grids with falling depth nothing is dropped and the half step points inwards. Pings
    with nothing kept give NULL.
    """
    n = F.size(mask)
    step = (F.col("depth_stop") - F.col("depth_start")) / (n - 1)
    m = A.squash_short_runs(mask, F.bround(F.lit(max_gap) / step).cast("int"))
    d = df.withColumn("_m", m)
    i, j = A.first_index("_m"), A.last_index("_m")
    a, b = F.col("depth_start") + i * step, F.col("depth_start") + j * step
    return d.withColumns(
        {top: F.when(i >= 0, F.least(a, b) - step / 2), low: F.when(i >= 0, F.greatest(a, b) + step / 2)}
    ).drop("_m")


def fix_lines(df: DataFrame, old_top: str | None = None, old_low: str | None = None, mask: str = "mask",
              key: Sequence[str] = KEY, idx: str = "ping_index", ts: str = "ts_s") -> DataFrame:
    """Extend lines so that they cover what the mask removes.

    ``old_top``/``old_low`` are the earlier lines already sampled at the pings, or None.
    Output columns ``turbulence_new`` and ``bottom_new``.
    """
    d = lines_from_mask(df, mask)
    d = d.withColumn("_empty", ~F.exists(mask, lambda x: x))
    gaps = []
    for new, old, cover in (("turbulence_new", old_top, A.strict_max), ("bottom_new", old_low, A.strict_min)):
        if old is None:
            # Both the missing pings and the fully removed ones come from the others.
            d = d.withColumn(new, F.when(~F.col("_empty"), F.col(new)))
            gaps.append(new)
        else:
            covered = cover(old, F.coalesce(new, old))
            d = d.withColumn(new, F.when(F.col("_empty"), F.col(old)).otherwise(covered))
    d = d.drop("_empty")
    return fill_linear(d, key, ts, gaps, idx) if gaps else d


def lines_at_pings(pings: DataFrame, points: DataFrame, cols: Sequence[str] = LINES, key: Sequence[str] = KEY,
                   ts: str = "ts_s") -> DataFrame:
    """Lines tidied (undefined points dropped) and sampled at the ping times."""
    p = points.select(*key, ts, *[F.when(~is_undefined(c), F.col(c)).alias(c) for c in cols])
    return interpolate_onto(pings, p, key, ts, cols)


def offset_lines(df: DataFrame, turbulence: float = 0.0, bottom: float = 0.0, surface: float = 0.0) -> DataFrame:
    """Move lines into the water column: surface and turbulence deeper, bottom shallower."""
    return df.withColumns(
        {"turbulence": F.col("turbulence") + turbulence, "bottom": F.col("bottom") - bottom, "surface": F.col("surface") + surface}
    )


def nearfield_depth(distance: float) -> Column:
    """Depth where the near field of the sounder ends."""
    hi, lo = F.greatest("depth_start", "depth_stop"), F.least("depth_start", "depth_stop")
    return F.when(F.col("is_upfacing"), hi - distance).otherwise(lo + distance)


def clip_nearfield(df: DataFrame, distance: float = 1.7, clip: bool | None = None) -> DataFrame:
    """Keep the line nearest the sounder out of the near field.

    By default the bottom of upfacing recordings only; ``clip=True`` also the turbulence
    line of downfacing ones; ``clip=False`` none.
    """
    near = nearfield_depth(distance)
    up = F.col("is_upfacing")
    do_bottom = F.lit(clip is None or clip) & up
    do_turb = F.lit(bool(clip)) & ~up
    return df.withColumns(
        {
            "nearfield_depth": near,
            "bottom": F.when(do_bottom, A.strict_min("bottom", near)).otherwise(F.col("bottom")),
            "turbulence": F.when(do_turb, A.strict_max("turbulence", near)).otherwise(F.col("turbulence")),
        }
    )


def lines_during_passive(df: DataFrame, how: str = "interpolate-time", cols: Sequence[str] = LINES,
                         key: Sequence[str] = KEY, idx: str = "ping_index", ts: str = "ts_s") -> DataFrame:
    """What to do with line depths at passive pings.

    ``predict`` keeps them, ``redact`` drops the pings, ``undefined`` writes the marker,
    ``interpolate-time``/``interpolate-index`` fill from the other pings. A recording that
    is passive throughout keeps its values when interpolating.
    """
    p = F.coalesce(F.col("is_passive"), F.lit(False))
    if how == "predict":
        return df
    if how == "redact":
        return df.where(~p)
    if how == "undefined":
        return df.withColumns({c: F.when(p, F.lit(UNDEFINED_DEPTH)).otherwise(F.col(c)) for c in cols})
    if how in ("interpolate-time", "interpolate-index"):
        x = ts if how.endswith("time") else idx
        d = df.withColumns({f"_{c}": F.when(~p, F.col(c)) for c in cols})
        d = fill_linear(d, key, x, [f"_{c}" for c in cols], idx)
        return d.withColumns({c: F.coalesce(f"_{c}", c) for c in cols}).drop(*[f"_{c}" for c in cols])
    raise ValueError(f"unknown passive rule {how!r}")


def line_masks(df: DataFrame, sv: str = "sv", sfx: str = "") -> DataFrame:
    """Cells above the surface and turbulence lines, and below the bottom line."""
    d = A.depth_grid(sv)
    out = {
        f"mask_turbulence{sfx}": F.transform(d, lambda x: x < F.col(f"turbulence{sfx}")),
        f"mask_bottom{sfx}": F.transform(d, lambda x: x > F.col(f"bottom{sfx}")),
    }
    if not sfx:
        out["mask_surface"] = F.transform(d, lambda x: x < F.col("surface"))
    return df.withColumns(out)


def sane_labels(df: DataFrame) -> DataFrame:
    """Order the three lines; ``is_bad_labels`` marks pings where they were out of order."""
    d = df.withColumn("is_bad_labels", F.col("surface") >= F.col("bottom"))
    d = d.withColumn("surface", A.strict_min("surface", "turbulence"))
    return d.withColumn("bottom", A.strict_max("bottom", F.col("surface") + 0.02))


def default_lines(df: DataFrame, raise_errors: bool = True) -> DataFrame:
    """Facing-dependent stand-ins for absent line files.

    ``has_bottom``/``has_surface``/``has_turbulence``/``has_air`` tell which exist. Absent
    bottom: deepest cell when upfacing, error otherwise. Absent surface: 0 when
    downfacing, error otherwise. Exactly one of turbulence and air must exist.
    """
    up = F.col("is_upfacing")
    deepest = F.greatest("depth_start", "depth_stop")
    err = (
        F.when(F.col("has_turbulence") & F.col("has_air"), F.lit("both turbulence and air lines exist"))
        .when(~F.col("has_turbulence") & ~F.col("has_air"), F.lit("neither turbulence nor air line exists"))
        .when(~F.col("has_bottom") & ~up, F.lit("no bottom line for a downfacing recording"))
        .when(~F.col("has_surface") & up, F.lit("no surface line for an upfacing recording"))
    )
    turbulence = F.when(F.col("has_turbulence"), F.col("turbulence")).when(F.col("has_air"), F.col("air"))
    if raise_errors:
        # Part of a column that every user reads, so that no pruning drops the check.
        turbulence = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("double")).otherwise(turbulence)
    return df.withColumn("error", err).withColumns(
        {
            "bottom": F.when(F.col("has_bottom"), F.col("bottom")).when(up, deepest),
            "surface": F.when(F.col("has_surface"), F.col("surface")).when(~up, F.lit(0.0)),
            "turbulence": turbulence,
        }
    )


def relative_depths(df: DataFrame, cols: Sequence[str] = LINES) -> DataFrame:
    """Line depth as a share of the depth extent, in columns ``r_<line>``."""
    extent = F.abs(F.col("depth_stop") - F.col("depth_start"))
    return df.withColumns({f"r_{c}": F.col(c) / extent for c in cols})


def boundary_indices(df: DataFrame, tops: Sequence[str] = ("turbulence", "surface"), lows: Sequence[str] = ("bottom",),
                     sv: str = "sv") -> DataFrame:
    """Index of the cell at each line; depth must increase. Columns ``index_<line>``.

    Ties go to the smaller index for upper lines and to the larger for bottom lines.
    """
    n = F.size(sv)
    a = F.col("depth_start")
    g = A.depth_grid(sv)

    def count(c, strict):
        return F.size(F.filter(g, (lambda d: d < F.col(c)) if strict else (lambda d: d <= F.col(c))))

    def held(x):
        return F.greatest(F.lit(0), F.least(n - 1, x))

    out = {f"index_{c}": F.when(F.col(c).isNotNull() & a.isNotNull(), held(count(c, True))) for c in tops}
    out |= {f"index_{c}": F.when(F.col(c).isNotNull() & a.isNotNull(), held(count(c, False) - 1)) for c in lows}
    return df.withColumns(out)


def line_from_probability(p, side: str, depths) -> Column:
    """Line depth from probabilities along depth.

    ``side="above"``: deepest cell with p > 0.5 of being above the line (surface and
    turbulence). ``side="below"``: shallowest cell with p > 0.5 of being below (bottom).
    With no such cell the deepest depth is taken.
    """
    over = A.above(p, 0.5)
    pick = (lambda o: A.last_index(o)) if side == "above" else (lambda o: A.first_index(o))
    return F.coalesce(F.get(A.col(depths), A.let(over, pick)), F.element_at(A.col(depths), -1))


def optimal_limits(df: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Depth range around the water column per recording: ``crop_lo``, ``crop_hi``.

    Five steps above the highest surface (upfacing) and below the deepest bottom
    (downfacing). NULL limits where the range is empty, meaning no crop.
    """
    step = F.abs(F.col("depth_stop") - F.col("depth_start")) / (F.size("sv") - 1)
    lo_g, hi_g = F.least("depth_start", "depth_stop"), F.greatest("depth_start", "depth_stop")
    bottoms = [c for c in ("bottom", "bottom_original") if c in df.columns]
    deepest = F.greatest(*bottoms) if len(bottoms) > 1 else F.col(bottoms[0])
    g = df.groupBy(*key).agg(
        F.first("is_upfacing").alias("_up"), F.first(step).alias("_step"), F.min(lo_g).alias("_lo"), F.max(hi_g).alias("_hi"),
        F.min(F.when(F.col("surface") > lo_g, F.col("surface"))).alias("_s"), F.max(deepest).alias("_b"),
    )
    lo = F.when(F.col("_up"), F.coalesce("_s", "_lo")).otherwise(F.col("_lo")) - 5 * F.col("_step")
    hi = F.when(F.col("_up"), F.col("_hi")).otherwise(F.coalesce("_b", "_hi")) + 5 * F.col("_step")
    return g.select(*key, F.when(lo < hi, lo).alias("crop_lo"), F.when(lo < hi, hi).alias("crop_hi"))


def autocrop_limits(df: DataFrame, threshold: float = 0.35, min_depth: float | None = None, max_depth: float | None = None,
                    key: Sequence[str] = KEY) -> DataFrame:
    """Range of depth worth a second look, and whether it saves more than ``threshold``.

    Needs ``surface``, ``bottom``, ``is_passive``, ``is_upfacing`` and ``depth_step``, the
    step of the grid before resizing. Output ``crop_min``, ``crop_max``, ``do_crop``.
    """
    from .quantiles import quantiles  # noqa: PLC0415

    live = df.groupBy(*key).agg(F.bool_or(~F.col("is_passive")).alias("_any"), F.count(F.lit(1)).alias("_rows"))
    up = F.col("is_upfacing")
    d = with_facts(df, live, key, "_rows").where(~F.col("_any") | ~F.col("is_passive"))
    d = d.withColumn("_line", F.when(up, F.col("surface")).otherwise(F.col("bottom")))
    q = quantiles(d, key, "_line", [0.02275, 0.97725]).drop("_count")
    ext = d.groupBy(*key).agg(F.min("_line").alias("_lmin"), F.max("_line").alias("_lmax"))
    grid = df.groupBy(*key).agg(
        F.first("is_upfacing").alias("is_upfacing"), F.first("depth_step").alias("_step"),
        F.min(F.least("depth_start", "depth_stop")).alias("_lo"), F.max(F.greatest("depth_start", "depth_stop")).alias("_hi"),
    )
    j = grid.join(q, list(key)).join(ext, list(key))
    lo, hi = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    dev = (hi - lo) / 4
    margin = F.greatest(F.lit(2.0), 10 * F.abs("_step"))
    crop_min = F.when(up, F.greatest(lo - 2 * dev, F.col("_lmin")) - margin).otherwise(F.col("_lo"))
    crop_max = F.when(up, F.col("_hi")).otherwise(F.least(hi + 2 * dev, F.col("_lmax")) + margin)
    if min_depth is not None:
        crop_min = F.greatest(crop_min, F.lit(float(min_depth)))
    if max_depth is not None:
        crop_max = F.least(crop_max, F.lit(float(max_depth)))
    j = j.withColumns({"crop_min": crop_min, "crop_max": crop_max})
    height = F.col("_hi") - F.col("_lo")
    saved = (height - F.abs(F.col("crop_max") - F.col("crop_min"))) / height
    return j.select(*key, "is_upfacing", "crop_min", "crop_max", (F.lit(threshold < 1) & (saved > threshold)).alias("do_crop"))
