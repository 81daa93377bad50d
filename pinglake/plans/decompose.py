"""From a raw and a masked copy of recordings to lines, flags and patches that explain the mask."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import asof, grid, lines, masks, passive, patches, smooth
from ..session import cut

KEY = ["transect_id"]
PK = ["transect_id", "ping_index"]


def decompose(raw: DataFrame, masked: DataFrame, points: DataFrame, passive_flags: DataFrame | None = None) -> DataFrame:
    """Explain what the masked copy leaves out.

    ``raw`` and ``masked``: pings on one depth grid per recording. ``points``: the lines
    ``turbulence`` (or ``air``), ``bottom`` and ``surface`` on their own times; a line that a
    recording lacks is absent from its points. ``passive_flags``: known passive flags per
    ping (NULL: to be found). Undefined line points are skipped throughout.

    Output per ping: ``mask``, the three patch masks, new and original lines, the cleaned
    ``surface`` with ``is_surrogate`` and ``surface_settled``, ``is_passive``, ``is_removed``, facing; depth increases.
    """
    raw = raw.select(*PK, "ts_s", "depth_start", "depth_stop", "sv")
    msk = masked.select(*PK, "ts_s", "depth_start", "depth_stop", F.transform("sv", lambda x: x.isNotNull()).alias("mask"))
    names = [c for c in ("turbulence", "air", "bottom", "surface") if c in points.columns]
    has = points.groupBy(*KEY).agg(*[(F.count(c) > 0).alias(f"has_{c}") for c in names])
    for c in ("turbulence", "air", "bottom", "surface"):
        if c not in names:
            has = has.withColumn(f"has_{c}", F.lit(False))
    has = cut(has, "line-presence")

    def with_lines(pings: DataFrame) -> DataFrame:
        d = lines.lines_at_pings(pings, points, names).join(has, KEY)
        d = d.withColumn("is_upfacing", F.col("depth_stop") < F.col("depth_start"))
        if "air" not in names:
            d = d.withColumn("air", F.lit(None).cast("double"))
        return lines.default_lines(d).drop("air", "error", *[f"has_{c}" for c in ("turbulence", "air", "bottom", "surface")])

    # New lines on the masked copy's own pings.
    m = lines.fix_lines(with_lines(msk), "turbulence", "bottom")
    m = cut(m.select(*PK, "ts_s", "depth_start", "depth_stop", "mask", "turbulence_new", "bottom_new"), "masked")
    # Copies on the same grid are matched by index; others are resampled onto the raw grid.
    same = cut(asof.grids_match(raw, m, KEY, "ping_index", ["ts_s", "depth_start", "depth_stop"]).select(*KEY, "same_grid"), "grids")
    base = raw.join(same, KEY)
    direct = base.where("same_grid").join(m.select(*PK, "mask", "turbulence_new", "bottom_new"), PK)
    other = base.where("not same_grid").withColumns({"grid_start": F.col("depth_start"), "grid_stop": F.col("depth_stop"), "grid_n": F.size("sv")})
    mo = m.join(same.where("not same_grid").select(*KEY), KEY)
    moved = patches.mask_onto_grid(mo, other.drop("same_grid"))
    moved = asof.interpolate_onto(moved, mo, KEY, "ts_s", ["turbulence_new", "bottom_new"]).drop("grid_start", "grid_stop", "grid_n")
    d = direct.drop("same_grid").unionByName(moved)
    if passive_flags is not None:
        f = passive_flags.select(*PK, F.col("is_passive").alias("_known"))
        d = d.join(f, PK, "left")
    else:
        d = d.withColumn("_known", F.lit(None).cast("boolean"))
    d = cut(d, "joined")
    # The finder runs on the recordings without a known schedule only.
    open_ = d.where(F.col("_known").isNull()).select(*PK, "sv")
    found = passive.find_passive(open_)
    d = passive.flag_ranges(d, found, "_found")
    d = d.withColumn("is_passive", F.coalesce("_known", "_found")).drop("_known", "_found")
    d = masks.mask_when_untouched(cut(d, "flagged"))
    d = masks.removed_stretches(cut(d, "masked"))
    d = cut(d.withColumn("ping_index", F.col("ping_index").cast("long")), "removed")
    step = F.abs(F.col("depth_stop") - F.col("depth_start")) / (F.size("sv") - 1)
    d = with_lines(d).withColumns({"turbulence_original": F.col("turbulence") + step / 4, "bottom_original": F.col("bottom") - step / 4})
    d = d.withColumns({"turbulence": F.col("turbulence_new"), "bottom": F.col("bottom_new")}).drop("turbulence_new", "bottom_new", "is_upfacing")
    d = grid.face_down(d, arrays=("sv", "mask")).drop("facing_mismatch")
    d = cut(d, "lined")
    d = smooth.fix_surface(d).withColumnRenamed("settled", "surface_settled")
    d = masks.residual_patches(d)
    return d.withColumns({c: masks.drop_thin(c) for c in ("mask_patches", "mask_patches_original", "mask_patches_ntob")})


def evaluation_labels(df: DataFrame, max_pings: int | None = None, max_depth: float | None = None) -> DataFrame:
    """Labels of whole recordings as evaluation reads them.

    All pings (or the first ``max_pings``, if a caller asks for that), cells within ``max_depth`` (of the sounder when
    upfacing), line masks, and as patches the masked cells that nothing else explains.
    """
    d = df if max_pings is None else df.where(F.col("ping_index") < max_pings)
    arrays = ("sv", "mask")
    if max_depth is not None:
        top = F.greatest("depth_start", "depth_stop")
        lo = F.when(F.col("is_upfacing"), top - max_depth)
        hi = F.when(~F.col("is_upfacing"), F.lit(float(max_depth)))
        d = grid.crop_depth(d, lo, hi, arrays)
    d = lines.line_masks(d)
    gone = F.coalesce(F.col("is_passive"), F.lit(False)) | F.coalesce(F.col("is_removed"), F.lit(False))
    cells = F.zip_with("mask_turbulence", "mask_bottom", lambda t, b: t | b)
    return d.withColumn("mask_patches", F.zip_with("mask", cells, lambda m, c: ~m & ~c & ~gone))
