"""Cleaning labelled recordings for training and evaluation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import grid, lines, masks
from ..operators.asof import fill_linear

KEY = ("transect_id",)


def chain(df: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Apply user transforms in order; each maps a frame to a frame."""
    return reduce(lambda d, f: d.transform(f), steps, df)


def surrogate_off_during_passive(df: DataFrame) -> DataFrame:
    """A passive ping's surface is never counted as a surrogate."""
    return df.withColumn("is_surrogate", F.col("is_surrogate") & ~F.coalesce(F.col("is_passive"), F.lit(False)))


def clean_labels(df: DataFrame, remove_nearfield: bool = True, nearfield_distance: float = 1.7, nearfield_visible: float = 0.0,
                 offset_turbulence: float = 0.0, offset_bottom: float = 0.0, max_depth: float | None = None,
                 transforms: Sequence[Callable[[DataFrame], DataFrame]] = (), key: Sequence[str] = KEY,
                 idx: str = "ping_index", ts: str = "ts_s") -> DataFrame:
    """From a labelled recording to line masks, keep mask and boundary indices.

    Steps: depth made increasing, line order, near field, built-in offsets, undefined line
    points, depth crop, user transforms, masks and indices. All but the line filling
    are per ping. ``key`` may name windows.
    """
    arrays = ["sv", "mask_patches", "mask_patches_original", "mask_patches_ntob"]
    d = grid.face_down(df.withColumn("_up", F.col("is_upfacing")), arrays=arrays).withColumn("is_upfacing", F.col("_up")).drop("_up", "facing_mismatch")
    d = lines.sane_labels(d)
    if remove_nearfield:
        d = masks.remove_nearfield(d, nearfield_distance, nearfield_visible)
    if offset_turbulence or offset_bottom:
        d = masks.remove_line_offset(d, offset_turbulence, offset_bottom)
    all_lines = ["surface", "turbulence", "turbulence_original", "bottom", "bottom_original"]
    d = d.withColumns({c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)) for c in all_lines})
    d = fill_linear(d, key, ts, all_lines, idx)
    if max_depth is not None:
        d = grid.crop_depth(d, None, max_depth, arrays)
    d = chain(d, transforms)
    d = lines.line_masks(lines.line_masks(d), sfx="_original")
    d = surrogate_off_during_passive(d)
    d = masks.keep_mask(d)
    return lines.boundary_indices(d, ("turbulence", "turbulence_original", "surface"), ("bottom", "bottom_original"))


def training_columns(df: DataFrame) -> DataFrame:
    """Relative line depths, and signal and lines as clean 32-bit floats."""
    d = lines.relative_depths(df, ["surface", "turbulence", "bottom", "turbulence_original", "bottom_original"])
    return masks.finite_clean_array(d.withColumn("sv", A.sentinel_to_null("sv")))
