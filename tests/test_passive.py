"""The distributed finders against a plain reading of the rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pinglake.operators import passive, smooth

SCHEMA = "transect_id long, ping_index long, sv array<double>"


def med(a):
    return float(np.median(a))


def read_stretches(x, starts, ends, thr, before, after):
    """Greedy reading, one candidate after the other."""
    n = len(x)
    out = []
    starts, ends = sorted(starts), sorted(ends)
    if not starts and not ends:
        return []
    if ends and (not starts or ends[0] < starts[0]):
        out.append([0, ends[0]])
        starts = [s for s in starts if s > ends[0]]
    while starts:
        s = starts[0]
        base = x[max(0, s - before)]
        e = next((i for i in range(s, n) if med(base - x[i]) < thr), n)
        starts = [c for c in starts if c > e]
        a = s
        if e < n:
            base = x[min(n - 1, e + after)]
            q = next((i for i in range(e - 1, -1, -1) if med(base - x[i]) < thr), None)
            a = 0 if q is None else min(s, q + 1)
        if out and a <= out[-1][1]:
            out[-1][1] = e
        else:
            out.append([a, e])
    return [tuple(o) for o in out]


def steps(x):
    return [med(b - a) for a, b in zip(x[:-1], x[1:])]


def v1(x, thr):
    md = steps(x)
    return read_stretches(x, [i + 1 for i, m in enumerate(md) if m < -thr], [i + 1 for i, m in enumerate(md) if m > thr], thr, 1, 0)


def cluster(idx, val):
    out, cur = [], []
    for i in idx:
        if cur and i > cur[-1] + 3:
            out.append(min(cur, key=lambda k: (val[k], k)))
            cur = []
        cur.append(i)
    if cur:
        out.append(min(cur, key=lambda k: (val[k], k)))
    return out


def v2(x, init, inner):
    w = np.array(smooth.gaussian_weights(1.0))
    n = len(x)
    k = np.arange(-4, n + 4) % (2 * n)
    pad = x[np.where(k < n, k, 2 * n - 1 - k)]
    sm = np.stack([(pad[i : i + 9] * w[:, None]).sum(0) for i in range(n)])
    md = steps(sm)
    s = cluster([i for i, m in enumerate(md) if m < -init], md)
    e = cluster([i for i, m in enumerate(md) if m > init], [-m for m in md])
    return read_stretches(x, [i + 1 for i in s], [i + 1 for i in e], inner, 2, 1)


def recordings(seed):
    """Quiet stretches of many lengths, at the ends, back to back, with drifting levels."""
    rng = np.random.default_rng(seed)
    recs = {}
    for t in range(14):
        n = int(rng.integers(5, 90))
        level = np.zeros(n)
        i = 0
        while i < n:
            m = int(rng.integers(1, 14))
            level[i : i + m] = rng.choice([0, -60, -30, -90, 20])
            i += m
        recs[t] = -50 + level[:, None] + rng.normal(scale=4, size=(n, 5))
    recs[90] = np.full((1, 5), -50.0)
    recs[91] = np.full((6, 5), -50.0)
    recs[92] = -50 + np.array([0, 0, -60, -60, -60, -60])[:, None] + np.zeros((6, 5))
    recs[93] = -50 + np.array([-60, -60, 0, 0, 0, 0])[:, None] + np.zeros((6, 5))
    return recs


def frame(spark, recs):
    data = [(t, i, [float(v) for v in row]) for t, x in recs.items() for i, row in enumerate(x)]
    np.random.default_rng(1).shuffle(data)
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.transect_id, []).append((r.start, r.end))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("seed,window,block", [(0, 4, 5), (1, 1024, 65536), (2, 2, 3)])
def test_find_passive(spark, seed, window, block):
    recs = recordings(seed)
    got = found(passive.find_passive(frame(spark, recs), window=window, rows=block))
    for t, x in recs.items():
        assert got.get(t, []) == v1(x, 25.0), t


@pytest.mark.parametrize("seed,window", [(3, 4), (4, 1024)])
def test_find_passive_v2(spark, seed, window):
    recs = recordings(seed)
    got = found(passive.find_passive_v2(frame(spark, recs), window=window, rows=6))
    for t, x in recs.items():
        assert got.get(t, []) == v2(x, 12.0, 35.0), t


def test_deviation(spark):
    recs = {k: v for k, v in recordings(6).items() if len(v) > 4}
    got = found(passive.find_passive(frame(spark, recs), threshold=None, deviation=0.8, window=8))
    for t, x in recs.items():
        md = steps(x)
        thr = (np.percentile(md, 75) - np.percentile(md, 25)) * 0.8
        assert got.get(t, []) == v1(x, thr), t


def test_threshold_and_deviation_exclude_each_other(spark):
    df = frame(spark, {1: np.zeros((4, 3))})
    for kw in ({"threshold": 25.0, "deviation": 1.0}, {"threshold": None, "deviation": None}):
        with pytest.raises(ValueError):
            passive.find_passive(df, **kw)
    with pytest.raises(ValueError):
        passive.find_passive_v2(df, threshold_inner=1.0, deviation=1.0)


def test_missing_sample_blocks_the_step(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 1, [None, 5.0]), (1, 2, [3.0, 9.0])], SCHEMA)
    got = {r.ping_index: r.step for r in passive.median_step(passive.near_samples(df)).collect()}
    assert got == {0: None, 1: None, 2: None}


@pytest.mark.parametrize(
    "path,i,want",
    [
        ("a/MinasPassage/march2018/x", 59, ("schedule", True)),
        ("a/MinasPassage/march2018/x", 60, ("schedule", False)),
        ("a/MinasPassage/December2017/x", 0, ("none", False)),
        ("a/MinasPassage/september2018/x", 299, ("schedule", False)),
        ("a/MinasPassage/september2018/x", 300, ("schedule", True)),
        ("a/MinasPassage/september2018/D20181026-T142217_D20181026-T195218", 300, ("find", None)),
        ("GrandPassage/phase1/x", 219, ("schedule", True)),
        ("GrandPassage/phase1/x", 220, ("schedule", False)),
        ("GrandPassage/phase2/WBAT_2B_20200130_UTC080017_ebblow", 0, ("schedule", True)),
        ("GrandPassage/phase2/other", 0, ("find", None)),
        ("mobile/x", 0, ("find", None)),
    ],
)
def test_schedule(spark, path, i, want):
    r = passive.schedule_flags(spark.createDataFrame([(path, i)], "path string, ping_index long")).collect()[0]
    assert (r.schedule, r.is_passive) == want


def test_falls_that_never_return_cost_little(spark, monkeypatch):
    """Starts covered by a stretch without end are looked at once, not to the end of the recording."""
    looked = []
    look = passive._look

    def counted(todo, *args):
        out = look(todo, *args)
        looked.append(out.agg(F.sum(F.col("_hi") - F.col("_lo") + 1)).first()[0])
        return out

    monkeypatch.setattr(passive, "_look", counted)
    n, falls = 4000, 100
    level = np.repeat(-30.0 * np.arange(falls), n // falls)
    df = frame(spark, {1: np.repeat(level[:, None], 3, axis=1)})
    assert found(passive.find_passive(df, window=16)) == {1: [(n // falls, n)]}
    # A round reads each ping about once; every start on its own would read half the recording.
    assert sum(x or 0 for x in looked) <= len(looked) * n < falls * n / 4


@pytest.mark.parametrize("block,reach", [(7, 9), (64, 60), (65536, 300)])
def test_choice_among_overlapping_starts(spark, block, reach):
    rng = np.random.default_rng(reach)
    data, want = [], set()
    for t in range(6):
        s = np.flatnonzero(rng.random(600) < rng.choice([0.1, 0.5, 1.0]))
        e = s + rng.integers(0, reach, len(s))
        if t == 4:
            e = np.maximum(e, 300)  # half of all starts end in one place
        data += [(t, int(a), int(b)) for a, b in zip(s, e)]
        last = -1
        for a, b in zip(s, e):
            if a > last:
                want.add((t, int(a), int(b)))
                last = b
    got = passive._choose(spark.createDataFrame(data, "transect_id long, s long, e long").repartition(3), ("transect_id",), block)
    assert {tuple(r) for r in got.collect()} == want


def test_choice_needs_no_group(spark):
    """200,000 overlapping starts in one recording: few rounds, no Python, no task with the recording."""
    starts = spark.range(200_000).select(F.lit(1).cast("long").alias("transect_id"), F.col("id").alias("s"), (F.col("id") + F.pmod(F.xxhash64("id"), F.lit(40))).alias("e"))
    rows = starts.orderBy("s").collect()
    last, n = -1, 0
    for r in rows:
        if r.s > last:
            n, last = n + 1, r.e
    got = passive._choose(starts, ("transect_id",), 4096)
    assert got.count() == n
    assert "Python" not in got._jdf.queryExecution().toString() and "Pandas" not in got._jdf.queryExecution().toString()
