"""Cell masks of a ping: keep masks, left-over patches, near-field and offset corrections.

All of these look at one ping at a time and never shuffle, except where a whole recording
decides (``mask_when_untouched``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A

KEY = ("transect_id",)


def keep_mask(df: DataFrame, patches: str = "mask_patches", out: str = "mask") -> DataFrame:
    """Cells not passive, not removed, below turbulence, above bottom, in no patch."""
    gone = F.coalesce(F.col("is_passive"), F.lit(False)) | F.coalesce(F.col("is_removed"), F.lit(False))
    cells = F.zip_with("mask_turbulence", "mask_bottom", lambda t, b: t | b)
    return df.withColumn(out, F.zip_with(cells, patches, lambda c, p: ~gone & ~c & ~p))


def mask_when_untouched(df: DataFrame, mask: str = "mask", top: str = "turbulence_new", low: str = "bottom_new",
                        key: Sequence[str] = KEY) -> DataFrame:
    """Where a recording's mask removes nothing at all, build it from lines and passive flag."""
    untouched = df.groupBy(*key).agg(F.bool_and(F.forall(mask, lambda x: x)).alias("_untouched"))
    d = A.depth_grid(mask)
    built = F.transform(
        d, lambda x: ~F.coalesce(x < F.col(top), F.lit(False)) & ~F.coalesce(x > F.col(low), F.lit(False)) & ~F.col("is_passive")
    )
    return df.join(untouched, list(key)).withColumn(mask, F.when(F.col("_untouched"), built).otherwise(F.col(mask))).drop("_untouched")


def residual_patches(df: DataFrame, mask: str = "mask", top: str = "turbulence", low: str = "bottom",
                     sfx_old: str = "_original") -> DataFrame:
    """Masked cells that passive, removed stretches and lines do not explain.

    Three variants: merged (``mask_patches``), against the original lines
    (``mask_patches_original``), and new turbulence with old bottom (``mask_patches_ntob``).
    Cells on a line count as explained.
    """
    g = A.depth_grid(mask)
    gone = F.coalesce(F.col("is_passive"), F.lit(False)) | F.coalesce(F.col("is_removed"), F.lit(False))

    def left(t, b):
        under = F.transform(g, lambda x: ~F.coalesce(x <= F.col(t), F.lit(False)) & ~F.coalesce(x >= F.col(b), F.lit(False)))
        return F.zip_with(mask, under, lambda m, u: ~m & u & ~gone)

    return df.withColumns(
        {
            "mask_patches": left(top, low),
            "mask_patches_original": left(top + sfx_old, low + sfx_old),
            "mask_patches_ntob": left(top, low + sfx_old),
        }
    )


def drop_thin(mask) -> Column:
    """Clear cells whose neighbours two above and two below are both clear.

    Positions outside the grid count as set.
    """

    def kept(m):
        n = F.size(m)

        def at(i):
            return F.when((i < 0) | (i >= n), F.lit(True)).otherwise(F.get(m, i))

        return F.transform(m, lambda x, i: x & (at(i - 2) | at(i + 2)))

    return A.let(A.col(mask), kept)


def _fill(arr, lo, hi, value, when) -> Column:
    """Array with cells lo <= i < hi replaced by value where ``when`` holds."""
    args = F.struct(lo.alias("lo"), hi.alias("hi"), value.alias("value"), when.alias("when"))
    return A.let(args, lambda a: F.transform(arr, lambda x, i: F.when(a["when"] & (i >= a["lo"]) & (i < a["hi"]), a["value"]).otherwise(x)))


def _any_in(arr, lo, hi) -> Column:
    n = F.size(arr)
    lo = F.greatest(lo, F.lit(0))
    return F.exists(F.slice(arr, lo + 1, F.greatest(F.least(hi, n) - lo, F.lit(0))), lambda x: x)


def remove_nearfield(df: DataFrame, distance: float = 1.7, visible: float = 0.0, top_limit: float = 0.966) -> DataFrame:
    """Move near-field labels to the visible limit, patches with them. Depth must increase.

    Upfacing recordings move the bottom lines, downfacing ones the turbulence line.
    Adds ``was_nearfield`` and ``was_nearfield_original``.
    """
    up = F.col("is_upfacing")
    n = F.size("mask_patches")
    a, b = F.col("depth_start"), F.col("depth_stop")
    step = F.abs((b - a) / (n - 1))
    g = A.depth_grid("mask_patches")
    v_up, v_dn = F.greatest(a, b) - visible, F.lit(float(top_limit))
    t_up = F.greatest(a, b) - 2.5 * step - distance
    near = F.when(up, F.col("bottom") >= t_up).otherwise(F.col("turbulence") < distance + step)
    near_o = F.when(up, F.col("bottom_original") >= t_up).otherwise(F.lit(False))
    # Upfacing: [i, j) from the last cell above the threshold to the first beyond the
    # visible limit; a missing j means the slice stops one before the end.
    last_before = A.last_index(F.transform(g, lambda d: d < t_up))
    # A missing start (-1) addresses the last cell.
    i_up = F.when(last_before < 0, n - 1).otherwise(last_before)
    first_beyond = A.first_index(F.transform(g, lambda d: d > v_up))
    j_up = F.when(first_beyond < 0, n - 1).otherwise(first_beyond)
    i_dn = A.first_index(F.transform(g, lambda d: d > distance), 0)
    j_dn = A.last_index(F.transform(g, lambda d: d < v_dn))
    d = df.withColumns({"_iu": i_up, "_ju": j_up, "_id": i_dn, "_jd": j_dn, "was_nearfield": near, "was_nearfield_original": near_o})
    iu, ju, i, j = F.col("_iu"), F.col("_ju"), F.col("_id"), F.col("_jd")
    at_up, at_dn = F.get("mask_patches_original", iu), F.get("mask_patches_original", i)
    T = F.lit(True)

    def merged(c):
        return F.when(up, _fill(c, iu, ju, T, _any_in(c, iu, ju))).otherwise(_fill(c, j + 1, i, T, _any_in(c, j + 1, i + 1)))

    def ntob(c):
        return F.when(up, _fill(c, iu, n, at_up, T)).otherwise(_fill(c, j + 1, i, T, _any_in(c, j + 1, i + 1)))

    return d.withColumns(
        {
            "bottom": F.when(up & near, v_up).otherwise(F.col("bottom")),
            "bottom_original": F.when(up & near_o, v_up).otherwise(F.col("bottom_original")),
            "turbulence": F.when(~up & near, v_dn).otherwise(F.col("turbulence")),
            "mask_patches": merged("mask_patches"),
            "mask_patches_ntob": ntob("mask_patches_ntob"),
            "mask_patches_original": F.when(up, _fill("mask_patches_original", iu, n, at_up, T)).otherwise(
                _fill("mask_patches_original", F.lit(0), i, at_dn, T)
            ),
        }
    ).drop("_iu", "_ju", "_id", "_jd")


def remove_line_offset(df: DataFrame, turbulence: float = 0.0, bottom: float = 0.0) -> DataFrame:
    """Take built-in offsets out of the lines; patches that touched a line grow with it.

    Turbulence lines move up and bottom lines down, except rows changed by
    ``remove_nearfield`` on the sounder's own side. A ping's patches grow by the freed
    cells if one of them lies right above (turbulence) or below (bottom) a patch cell.
    """
    up = F.col("is_upfacing")
    near = F.coalesce(F.col("was_nearfield"), F.lit(False)) if "was_nearfield" in df.columns else F.lit(False)
    near_o = F.coalesce(F.col("was_nearfield_original"), F.lit(False)) if "was_nearfield_original" in df.columns else F.lit(False)
    g = A.depth_grid("mask_patches")
    d = df

    def grow(c, freed):
        return F.zip_with(c, freed, lambda p, f: p | f)

    def touches(freed, c, step):
        hits = lambda p: F.transform(freed, lambda f, i: f & F.coalesce(F.get(p, i + step), F.lit(False)))
        return F.exists(A.let(F.col(c), hits), lambda x: x)

    if turbulence:
        d = d.withColumns({"_t": F.col("turbulence"), "_to": F.col("turbulence_original")}).withColumns(
            {
                "turbulence": F.col("turbulence") - F.when(~near | up, turbulence).otherwise(0.0),
                "turbulence_original": F.col("turbulence_original") - F.when(~near_o | up, turbulence).otherwise(0.0),
            }
        )
        freed = F.transform(g, lambda x: (x < F.col("_t")) & ~(x < F.col("turbulence")))
        freed_o = F.transform(g, lambda x: (x < F.col("_to")) & ~(x < F.col("turbulence_original")))
        d = d.withColumns({"_f": freed, "_fo": freed_o})
        hit, hit_o = touches("_f", "mask_patches", 1), touches("_fo", "mask_patches_original", 1)
        d = d.withColumns(
            {
                "mask_patches": F.when(hit, grow("mask_patches", "_f")).otherwise(F.col("mask_patches")),
                "mask_patches_ntob": F.when(hit, grow("mask_patches_ntob", "_f")).otherwise(F.col("mask_patches_ntob")),
                "mask_patches_original": F.when(hit_o, grow("mask_patches_original", "_fo")).otherwise(F.col("mask_patches_original")),
            }
        ).drop("_f", "_fo", "_t", "_to")
    if bottom:
        d = d.withColumns({"_t": F.col("bottom"), "_to": F.col("bottom_original")}).withColumns(
            {
                "bottom": F.col("bottom") + F.when(~near | ~up, bottom).otherwise(0.0),
                "bottom_original": F.col("bottom_original") + F.when(~near_o | ~up, bottom).otherwise(0.0),
            }
        )
        freed = F.transform(g, lambda x: (x > F.col("_t")) & ~(x > F.col("bottom")))
        freed_o = F.transform(g, lambda x: (x > F.col("_to")) & ~(x > F.col("bottom_original")))
        d = d.withColumns({"_f": freed, "_fo": freed_o})
        hit, hit_o = touches("_f", "mask_patches", -1), touches("_fo", "mask_patches_original", -1)
        d = d.withColumns(
            {
                "mask_patches": F.when(hit, grow("mask_patches", "_f")).otherwise(F.col("mask_patches")),
                "mask_patches_ntob": F.when(hit_o, grow("mask_patches_ntob", "_fo")).otherwise(F.col("mask_patches_ntob")),
                "mask_patches_original": F.when(hit_o, grow("mask_patches_original", "_fo")).otherwise(F.col("mask_patches_original")),
            }
        ).drop("_f", "_fo", "_t", "_to")
    return d


def finite_clean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns as FLOAT with missing and infinite values as 0, plus counts in ``n_<col>``."""
    out = {}
    for c in cols:
        bad = F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
        out[c] = F.when(bad, F.lit(0.0)).otherwise(F.col(c)).cast("float")
        out[f"n_{c}"] = bad.cast("int")
    return df.withColumns(out)


def finite_clean_array(df: DataFrame, col: str = "sv") -> DataFrame:
    """The same for an array column."""
    def bad(x):
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    return df.withColumns(
        {
            col: F.transform(col, lambda x: F.when(bad(x), F.lit(0.0)).otherwise(x).cast("float")),
            f"n_{col}": F.size(F.filter(col, bad)),
        }
    )


def removed_stretches(df: DataFrame, mask: str = "mask", top: str = "turbulence_new", low: str = "bottom_new",
                      key: Sequence[str] = KEY, idx: str = "ping_index") -> DataFrame:
    """Add ``is_removed``: fully masked, non-passive stretches that crossing lines do not explain.

    A stretch is dropped if its lines never uncross, or if it has at least five pings and
    at most two uncrossed ones.
    """
    from .runs import numbered_runs  # noqa: PLC0415

    empty = ~F.exists(mask, lambda x: x) & ~F.coalesce(F.col("is_passive"), F.lit(False))
    on = df.where(empty).select(*key, idx, F.coalesce(F.col(top) < F.col(low), F.lit(False)).cast("int").alias("_open"))
    on = numbered_runs(on, key, idx)
    r = on.groupBy(*key, "run").agg(F.sum("_open").alias("_c"), F.count(F.lit(1)).alias("_n"))
    r = r.where((F.col("_c") > 0) & ~((F.col("_n") >= 5) & (F.col("_c") <= 2)))
    kept = on.join(r.select(*key, "run"), [*key, "run"]).select(*key, idx, F.lit(True).alias("is_removed"))
    return df.drop("is_removed").join(kept, [*key, idx], "left").withColumn("is_removed", F.coalesce("is_removed", F.lit(False)))
