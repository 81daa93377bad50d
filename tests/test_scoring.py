"""Scores, holes and smoothing: only what is asked for is worked out, in groups of a bounded size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pinglake.operators import grid, probs, smooth
from pinglake.plans import scoring


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def model():
    def load():
        def f(signals):
            return {"logits": np.stack([(signals + c).astype("float32") for c in range(len(probs.CHANNELS))], axis=1)}

        return f

    return load


def survey(spark, n=40, cells=6):
    rng = np.random.default_rng(3)
    rows = [(t, i, 100.0 * t + i, 0.5, 3.0, rng.normal(size=cells).tolist()) for t in (1, 2) for i in range(n)]
    return spark.createDataFrame(rows, "transect_id long, ping_index long, ts_s double, depth_start double, depth_stop double, sv array<double>")


def test_only_the_columns_asked_for_are_stored(spark, rows):
    d = survey(spark)
    whole = scoring.score_to_lines(d, model(), autocrop=1, height=None)
    some = scoring.score_to_lines(d, model(), autocrop=1, height=None, columns=("surface", "p_patch"))
    assert some.columns == [*scoring.PING, "surface", "p_patch"]
    assert rows(some) == rows(whole.select(some.columns)) and some.count() == 80
    cropped = scoring.score_to_lines(d, model(), autocrop=0.9, height=None, columns=("turbulence",))
    assert {"turbulence", "surface", "bottom", "is_passive"} <= set(cropped.columns)


def filled(v, margin=4):
    """The rule in NumPy, for pings of one length."""
    n, m = v.shape
    na = np.isnan(v)
    inner = na.copy()
    inner[[0, -1]] = False
    by_ping, by_depth = inner.sum(1), inner.sum(0)
    if not (by_ping >= 2).any() and not (by_depth >= 2).any():
        return v
    span = lambda c: np.flatnonzero(c >= 2) if (c >= 2).any() else np.flatnonzero(c)
    x0, x1 = max(0, span(by_ping)[0] - margin), min(n - 1, span(by_ping)[-1] + margin)
    y0, y1 = max(0, span(by_depth)[0] + 1 - margin), min(m - 1, span(by_depth)[-1] + 1 + margin)
    box, out = v[x0 : x1 + 1, y0 : y1 + 1], v.copy()

    def along(a):
        at = np.arange(len(a))
        ok = ~np.isnan(a)
        return np.interp(at, at[ok], a[ok], left=np.nan, right=np.nan) if ok.sum() else a

    depth = np.array([along(r) if (~np.isnan(r)).sum() >= 2 else np.full(len(r), np.nan) for r in box])
    both = np.array([np.apply_along_axis(along, 0, box), depth])
    count = (~np.isnan(both)).sum(0)
    mean = np.where(count > 0, np.nansum(both, 0) / np.maximum(count, 1), np.nan)
    out[x0 : x1 + 1, y0 : y1 + 1] = np.where(np.isnan(box), mean, box)
    return out


@pytest.mark.parametrize("block", [3, 1000])
def test_holes_are_filled_from_the_cells_around_them(spark, block):
    rng = np.random.default_rng(5)
    recs = {t: rng.normal(size=(25, 14)) for t in (1, 2, 3)}
    for t, v in recs.items():
        v[rng.random(v.shape) < 0.12] = np.nan
        v[8:13, 5:8] = np.nan  # long in time, wide in depth
        v[:2, 3] = np.nan
    recs[4] = rng.normal(size=(5, 14))
    data = [(t, i, [None if np.isnan(x) else float(x) for x in r]) for t, v in recs.items() for i, r in enumerate(v)]
    d = spark.createDataFrame(data[::-1], "transect_id long, ping_index long, sv array<double>").repartition(3)
    f = grid.fill_holes(d, rows=block)
    # No row per cell: what is exploded are the cells in and next to holes.
    assert "posexplode" not in plan(f) and "collect_list" in plan(f)
    got = {(r.transect_id, r.ping_index): r.sv for r in f.collect()}
    for t, v in recs.items():
        mine = np.array([[np.nan if x is None else x for x in got[(t, i)]] for i in range(len(v))])
        assert np.allclose(mine, filled(v), equal_nan=True)


def test_pings_on_the_grid_stay_as_they_are(spark):
    data = [(1, i, 10.0, 1.0, [1.0, None, 3.0, float(i)]) for i in range(5)] + [(1, 5, 1.0, 10.0, [1.0, 2.0, 3.0, 4.0]), (1, 6, 10.0, 1.0, [None, None, 3.0, None])]
    d = spark.createDataFrame(data, "transect_id long, ping_index long, depth_start double, depth_stop double, sv array<double>")
    got = {r.ping_index: r.sv for r in grid.regrid(d).collect()}
    assert got == {i: [1.0, None, 3.0, float(i)] for i in range(5)} | {5: [4.0, 3.0, 2.0, 1.0], 6: [None] * 4}


@pytest.mark.parametrize("block", [4, None])
@pytest.mark.parametrize("mode", ["edge", "symmetric"])
def test_channels_are_smoothed_along_both_axes(spark, block, mode):
    """In blocks of a few hundred pings, without a list of neighbours per ping; a missing cell clears what it reaches."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(30, 3, 5))
    data = [(1, i, i % 2 == 0, [[float(x) for x in ch] for ch in r]) for i, r in enumerate(v)]
    data[7][3][1][2] = None
    d = spark.createDataFrame(data[::-1], "transect_id long, ping_index long, flag boolean, logits array<array<double>>").repartition(3)
    s = smooth.gaussian_arrays(d, "logits", 1.0, 0.5, mode=mode, rows=block)
    assert "collect_list" not in plan(s) and "Window" not in plan(s)
    v[7, 1, 2] = np.nan
    wd, wt = smooth.gaussian_weights(0.5), smooth.gaussian_weights(1.0)
    p = np.pad(v, ((0, 0), (0, 0), (len(wd) // 2,) * 2), mode="edge")
    v = sum(w * p[:, :, k : k + 5] for k, w in enumerate(wd))
    p = np.pad(v, ((len(wt) // 2,) * 2, (0, 0), (0, 0)), mode=mode)
    want = sum(w * p[k : k + 30] for k, w in enumerate(wt))
    rows = {r.ping_index: r for r in s.collect()}
    got = np.array([[[np.nan if x is None else x for x in ch] for ch in rows[i].logits] for i in range(30)])
    assert np.allclose(got, want, equal_nan=True, rtol=1e-12) and np.isnan(got).any()
    assert all(rows[i].flag == (i % 2 == 0) for i in range(30)) and s.columns == ["transect_id", "ping_index", "flag", "logits"]


def test_arrays_of_different_length_are_smoothed_cell_by_cell(spark):
    data = [(1, 0, [1.0, 2.0]), (1, 1, [3.0]), (1, 2, None), (2, 0, [5.0, 6.0, 7.0])]
    d = spark.createDataFrame(data, "transect_id long, ping_index long, v array<double>")
    got = {(r.transect_id, r.ping_index): r.v for r in smooth.gaussian_time(d, "v", 0.2, is_array=True, mode="edge").collect()}
    w = smooth.gaussian_weights(0.2)
    assert got[(1, 0)] == [pytest.approx(w[0] + w[1] + 3 * w[2]), None] and got[(1, 1)] == [None]
    assert got[(1, 2)] is None and got[(2, 0)] == pytest.approx([5.0, 6.0, 7.0])
