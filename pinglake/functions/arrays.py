"""Column expressions over the depth axis of one ping. None of them shuffles.

Depth grids are evenly spaced, so a grid is three scalars (first depth, last depth, cell
count) and is never stored per ping. Missing samples are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value, fn) -> Column:
    """fn(value) with the value worked out once, however often fn uses it.

    An expression used inside a higher-order function is otherwise evaluated per element.
    """
    return F.element_at(F.transform(F.array(value), fn), 1)


def linspace(start, stop, n) -> Column:
    """n evenly spaced values from start to stop, both included."""
    a, b, n = col(start), col(stop), col(n) if isinstance(n, (str, Column)) else F.lit(n)
    step = F.when(n > 1, (b - a) / (n - 1)).otherwise(F.lit(0.0))
    return F.when(n < 1, F.expr("cast(array() as array<double>)")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)).cast("int") - 1), lambda i: a + i * step)
    )


def depth_grid(values="sv", start="depth_start", stop="depth_stop") -> Column:
    """Depth of every cell of an array column."""
    return linspace(start, stop, F.size(col(values)))


def sentinel_to_null(values, limit: float = 1e37) -> Column:
    """Export markers for missing samples (beyond +-1e37, or NaN) become NULL."""
    return F.transform(col(values), lambda x: F.when((F.abs(x) > limit) | F.isnan(x), None).otherwise(x))


def fill_missing(values, value: float = 0.0) -> Column:
    return F.transform(col(values), lambda x: F.when(x.isNull() | F.isnan(x), F.lit(float(value))).otherwise(x))


def clip(x, lo, hi) -> Column:
    return F.least(F.greatest(col(x), F.lit(lo)), F.lit(hi))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def keep_where(values, mask) -> Column:
    """Value where the mask is set, else NULL."""
    return F.zip_with(col(values), col(mask), lambda v, m: F.when(m, v))


def strict_min(*xs) -> Column:
    """Smallest argument; NULL when any argument is NULL."""
    xs = [col(x) for x in xs]
    out = F.least(*xs)
    for x in xs:
        out = F.when(x.isNotNull(), out)
    return out


def strict_max(*xs) -> Column:
    """Largest argument; NULL when any argument is NULL."""
    xs = [col(x) for x in xs]
    out = F.greatest(*xs)
    for x in xs:
        out = F.when(x.isNotNull(), out)
    return out


def array_sum(values) -> Column:
    return F.aggregate(col(values), F.lit(0.0), lambda a, x: a + x)


def array_median(values) -> Column:
    """Median of an array; NULL when empty or when any element is NULL."""

    def middle(s):
        n = F.size(s)
        mid = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
        # Sorting puts NULLs first.
        return F.when(F.get(s, F.lit(0)).isNotNull(), mid)

    return let(F.sort_array(col(values)), middle)


def log_avg_exp(values, temperature: float | None = None) -> Column:
    """log(mean(exp(x))), stabilised; with a temperature t, t*lae(x/t)."""
    t = F.lit(1.0 if temperature is None else float(temperature))

    def lae(x):
        return let(F.array_max(x), lambda m: t * (m + F.log(array_sum(F.transform(x, lambda v: F.exp(v - m))) / F.size(x))))

    return let(F.transform(col(values), lambda v: v / t), lae)


def array_mean(values) -> Column:
    return array_sum(values) / F.size(col(values))


def softmax(values) -> Column:
    def scaled(v):
        return let(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m)))

    def shares(e):
        return let(array_sum(e), lambda t: F.transform(e, lambda x: x / t))

    return let(col(values), lambda v: let(scaled(v), shares))


def cumsum(values) -> Column:
    """Running sum along an array, one pass."""
    start = F.struct(F.expr("cast(array() as array<double>)").alias("a"), F.lit(0.0).alias("s"))
    return F.aggregate(
        col(values),
        start,
        lambda acc, x: F.struct(F.array_append(acc["a"], acc["s"] + x).alias("a"), (acc["s"] + x).alias("s")),
        lambda acc: acc["a"],
    )


def p_below(boundary) -> Column:
    """Probability of being at or below the boundary, from boundary probabilities."""
    return F.transform(cumsum(boundary), lambda v: clip(v, 0.0, 1.0))


def p_above(boundary) -> Column:
    return F.transform(F.reverse(cumsum(F.reverse(col(boundary)))), lambda v: clip(v, 0.0, 1.0))


def first_index(flags, default: int = -1) -> Column:
    """0-based position of the first set flag."""
    p = F.array_position(col(flags), True).cast("int") - 1
    return p if default == -1 else let(p, lambda i: F.when(i >= 0, i).otherwise(F.lit(default)))


def last_index(flags, default: int = -1) -> Column:
    """0-based position of the last set flag."""
    place = F.struct(F.size(col(flags)).alias("n"), F.array_position(F.reverse(col(flags)), True).cast("int").alias("p"))
    return let(place, lambda s: F.when(s["p"] > 0, s["n"] - s["p"]).otherwise(F.lit(default)))


def above(values, threshold: float = 0.5) -> Column:
    return F.transform(col(values), lambda x: F.coalesce(x > threshold, F.lit(False)))


def set_runs(flags) -> Column:
    """Runs of set flags along an array: array of (first, last) positions, both included."""

    def runs(f):
        n = F.size(f)
        idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))
        on = F.filter(idx, lambda i: F.get(f, i) & ~F.coalesce(F.get(f, i - 1), F.lit(False)))
        off = F.filter(idx, lambda i: F.get(f, i) & ~F.coalesce(F.get(f, i + 1), F.lit(False)))
        return F.zip_with(on, off, lambda a, b: F.struct(a.alias("first"), b.alias("last")))

    return let(col(flags), runs)


def squash_short_runs(flags, max_gap) -> Column:
    """Clear runs of set flags of at most min(max_gap, n-1)-1 cells, end runs included."""
    f = col(flags)
    limit = F.least(col(max_gap) if isinstance(max_gap, Column) else F.lit(max_gap), F.size(f) - 1) - 1
    short = F.filter(set_runs(f), lambda r: (r["last"] - r["first"] + 1) <= limit)
    cleared = let(
        F.struct(f.alias("f"), short.alias("short")),
        lambda s: F.transform(s["f"], lambda x, i: x & ~F.exists(s["short"], lambda r: (i >= r["first"]) & (i <= r["last"]))),
    )
    return F.when(limit < 1, f).otherwise(cleared)


def resample_linear(values, n) -> Column:
    """Values resized to n cells, linear, pixel-centre map with the edge cell repeated."""
    n = n if isinstance(n, Column) else F.lit(n)

    def resized(v):
        m = F.size(v)

        def at(j):
            x = F.greatest(F.lit(0.0), F.least((j + 0.5) * m / n - 0.5, (m - 1).cast("double")))
            lo = F.least(F.floor(x).cast("int"), F.greatest(m - 2, F.lit(0)))
            a, b = F.get(v, lo), F.coalesce(F.get(v, lo + 1), F.get(v, lo))
            return a + (b - a) * (x - lo)

        return F.when(m == n, v).otherwise(F.transform(F.sequence(F.lit(0), n - 1), at))

    return let(col(values), resized)


def resample_nearest(values, n) -> Column:
    """Values resized to n cells, nearest cell under the pixel-centre map (halves go up)."""
    n = n if isinstance(n, Column) else F.lit(n)

    def resized(v):
        m = F.size(v)
        at = lambda j: F.get(v, F.least(m - 1, F.floor((j + 0.5) * m / n).cast("int")))
        return F.when(m == n, v).otherwise(F.transform(F.sequence(F.lit(0), n - 1), at))

    return let(col(values), resized)


def regrid_keep_missing(values, src_start, src_stop, dst_start, dst_stop, dst_n, threshold: float = 0.0) -> Column:
    """Linear interpolation of one evenly spaced grid onto another, keeping gaps.

    Present samples only are interpolated. A target is NULL when it lies outside the
    present samples, when fewer than two are present, or when the interpolated 0/1
    missing indicator on the full source grid exceeds ``threshold``. Source values must
    be in increasing order of depth.
    """
    return let(
        F.struct(col(values).alias("v"), col(src_start).alias("a"), col(src_stop).alias("b")),
        lambda s: _regridded(s["v"], s["a"], s["b"], linspace(dst_start, dst_stop, dst_n), threshold),
    )


def _regridded(v: Column, a: Column, b: Column, target: Column, threshold: float) -> Column:
    n = F.size(v)
    step = (b - a) / F.greatest(n - 1, F.lit(1))
    idx = F.sequence(F.lit(0), n - 1)
    # For every position: nearest present position at or before it, and at or after it.
    prev = F.aggregate(
        idx,
        F.struct(F.expr("cast(array() as array<int>)").alias("a"), F.lit(-1).alias("c")),
        lambda acc, i: F.struct(
            F.array_append(acc["a"], F.when(F.get(v, i).isNotNull(), i).otherwise(acc["c"])).alias("a"),
            F.when(F.get(v, i).isNotNull(), i).otherwise(acc["c"]).alias("c"),
        ),
        lambda acc: acc["a"],
    )
    nxt = F.reverse(
        F.aggregate(
            F.reverse(idx),
            F.struct(F.expr("cast(array() as array<int>)").alias("a"), n.alias("c")),
            lambda acc, i: F.struct(
                F.array_append(acc["a"], F.when(F.get(v, i).isNotNull(), i).otherwise(acc["c"])).alias("a"),
                F.when(F.get(v, i).isNotNull(), i).otherwise(acc["c"]).alias("c"),
            ),
            lambda acc: acc["a"],
        )
    )
    carried = F.array(F.struct(prev.alias("p"), nxt.alias("q")))

    def value(pq, w):
        x, lo, hi = w["x"], w["lo"], w["hi"]
        influence = w["mlo"] + (w["mhi"] - w["mlo"]) * (x - lo)
        inside = (x >= 0) & (x <= n - 1) & (influence <= threshold)

        def between(z):
            y0, y1 = F.get(v, z["p"]), F.get(v, z["q"])
            y = F.when(z["p"] == z["q"], y0).otherwise(y0 + (y1 - y0) * (x - z["p"]) / (z["q"] - z["p"]))
            return F.when((z["p"] >= 0) & (z["q"] < n), y)

        return F.when(inside, let(F.struct(F.get(pq["p"], lo).alias("p"), F.get(pq["q"], hi).alias("q")), between))

    def one(pq, d):
        # Positions within 1e-9 of a source cell count as on it.
        raw = F.when(step == 0, F.lit(0.0)).otherwise((d - a) / step)
        snapped = lambda r: F.when(F.abs(r - F.rint(r)) < 1e-9, F.rint(r)).otherwise(r)

        def cells(x):
            lo, hi = F.floor(x).cast("int"), F.ceil(x).cast("int")
            return F.struct(
                x.alias("x"), lo.alias("lo"), hi.alias("hi"),
                F.get(v, lo).isNull().cast("double").alias("mlo"), F.get(v, hi).isNull().cast("double").alias("mhi"),
            )

        return let(raw, lambda r: let(snapped(r), lambda x: let(cells(x), lambda w: value(pq, w))))

    present = F.size(F.filter(v, lambda x: x.isNotNull()))
    mapped = F.element_at(F.transform(carried, lambda pq: F.transform(target, lambda d: one(pq, d))), 1)
    return F.when(present >= 2, mapped).otherwise(F.transform(target, lambda d: F.lit(None).cast("double")))
