"""Ordered operators give the same answer however small the blocks are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pinglake.operators import asof, runs
from pinglake.operators.blocks import BLOCK, HEAVY, dense_index, index_block, scan, shift, value_block, with_facts
from pinglake.operators.quantiles import quantiles

KEY = ["transect_id"]


def hot(spark, n=100, seed=0):
    """One recording with most rows, a few small ones, unsorted."""
    rng = np.random.default_rng(seed)
    out = []
    for t, m in ((1, n), (2, 1), (3, 2), (4, 7)):
        x = np.round(rng.normal(size=m), 2)
        for i in range(m):
            out.append((t, i, 1000.0 * t + i + (50.0 if i > m // 2 else 0.0), float(x[i]), bool(rng.random() < 0.4)))
    rng.shuffle(out)
    return out, spark.createDataFrame([tuple(r) for r in out], "transect_id long, ping_index long, ts_s double, v double, f boolean").repartition(3)


def by_key(data):
    d = {}
    for r in data:
        d.setdefault(int(r[0]), []).append(r)
    return {k: sorted(v, key=lambda r: int(r[1])) for k, v in d.items()}


@pytest.mark.parametrize("block", [3, 1000])
def test_shift(spark, block):
    data, df = hot(spark)
    got = {(r.transect_id, r.ping_index): (r.a, r.b) for r in shift(df, KEY, {"a": ("v", 2), "b": ("v", -1)}, rows=block).collect()}
    for t, rs in by_key(data).items():
        for i, _ in enumerate(rs):
            a = float(rs[i - 2][3]) if i >= 2 else None
            b = float(rs[i + 1][3]) if i + 1 < len(rs) else None
            assert got[(t, i)] == (a, b)


@pytest.mark.parametrize("block", [3, 1000])
def test_scan_kinds(spark, block):
    data, df = hot(spark)
    d = df.withColumn("p", F.when(F.col("f"), F.col("v")))
    s = scan(d, KEY, ["ping_index"], {"s": ("sum", "ping_index"), "m": ("max", "p"), "l": ("last", "p"), "n": ("next", "p")}, rows=block)
    got = {(r.transect_id, r.ping_index): (r.s, r.m, r.l, r.n) for r in s.collect()}
    for t, rs in by_key(data).items():
        p = [float(r[3]) if r[4] else None for r in rs]
        for i in range(len(rs)):
            past = [x for x in p[: i + 1] if x is not None]
            ahead = [x for x in p[i:] if x is not None]
            want = (sum(range(i + 1)), max(past) if past else None, past[-1] if past else None, ahead[0] if ahead else None)
            assert got[(t, i)] == want


@pytest.mark.parametrize("block", [4, 1000])
def test_dense_index_orders_by_value(spark, block):
    data, df = hot(spark)
    d = dense_index(df.drop("ping_index"), KEY, ["v", "ts_s"], "i", block, "n").collect()
    for t, rs in by_key(data).items():
        want = sorted((float(r[3]), float(r[2])) for r in rs)
        got = sorted((r.i, r.v, r.ts_s, r.n) for r in d if r.transect_id == t)
        assert [(g[1], g[2]) for g in got] == want
        assert [g[0] for g in got] == list(range(len(rs)))
        assert {g[3] for g in got} == {len(rs)}


@pytest.mark.parametrize("block", [9, 1000])
@pytest.mark.parametrize("ties", [False, True])
def test_quantiles_match_linear_percentile(spark, block, ties):
    data, df = hot(spark)
    d = df.withColumn("v", F.when(F.lit(ties), F.lit(1.5)).otherwise(F.col("v")))
    probs = [0, 0.02275, 0.25, 0.5, 0.975, 1]
    got = {r.transect_id: r.q for r in quantiles(d, KEY, "v", probs, rows=block).collect()}
    for t, rs in by_key(data).items():
        x = [1.5 if ties else float(r[3]) for r in rs]
        assert np.allclose(got[t], np.percentile(x, [p * 100 for p in probs]))


def test_quantiles_skip_missing_and_outliers(spark):
    x = [None, 1.0, 2.0, 1e9, 3.0, None]
    df = spark.createDataFrame([(1, v) for v in x], "transect_id long, v double")
    r = quantiles(df, KEY, "v", [0.5, 1.0], rows=2).collect()[0]
    assert r.q == [2.5, 1e9] and r._count == 4


# Positions of set cells as (first, last), ends included.
VECTORS = [
    (20, [(3, 5), (8, 9), (11, 14)]),
    (20, [(0, 5), (8, 9), (11, 14)]),
    (20, [(3, 5), (8, 9), (11, 19)]),
    (6, [(0, 5)]),
    (6, []),
    (0, []),
]


@pytest.mark.parametrize("n,want", VECTORS)
@pytest.mark.parametrize("block", [4])
def test_on_and_offsets(spark, n, want, block):
    on = {i for a, b in want for i in range(a, b + 1)}
    df = spark.createDataFrame([(1, i, i in on) for i in range(n)], "transect_id long, ping_index long, f boolean")
    got = sorted((r.first, r.last) for r in runs.flag_runs(df, "f", rows=block).collect())
    assert got == want
    ex = sorted((r.start, r.end) for r in runs.exclusive_runs(df, "f", rows=block).collect())
    assert ex == [(a, b + 1) for a, b in want]


def squash(m, gap):
    """Stepwise rule: windows of i clear their middle when all of them are clear, from wide to narrow."""
    m = list(m)
    n = len(m)
    out = m[:]
    limit = min(gap, n - 1) - 1
    i = 0
    while i < n:
        if m[i]:
            j = i
            while j < n and m[j]:
                j += 1
            if j - i <= limit:
                out[i:j] = [False] * (j - i)
            i = j
        else:
            i += 1
    return out


@pytest.mark.parametrize("gap", [1, 4, 50])
def test_squash_gaps(spark, gap):
    data, df = hot(spark, 40, 3)
    got = {(r.transect_id, r.ping_index): r.f for r in runs.squash_gaps(df, "f", gap, rows=5).collect()}
    for t, rs in by_key(data).items():
        want = squash([bool(r[4]) for r in rs], gap)
        assert [got[(t, i)] for i in range(len(rs))] == want


@pytest.mark.parametrize("block", [3, 1000])
def test_interpolation_matches_two_sided_rule(spark, block):
    data, df = hot(spark)
    rng = np.random.default_rng(5)
    pts = [(t, float(x), float(y)) for t in (1, 2, 4) for x, y in zip(np.unique(rng.uniform(1000 * t - 5, 1000 * t + 170, 30)), rng.normal(size=30))]
    pts.append((3, 3000.0, 2.0))
    p = spark.createDataFrame(pts, "transect_id long, ts_s double, y double")
    got = {(r.transect_id, r.ping_index): r.y for r in asof.interpolate_onto(df.select(*KEY, "ping_index", "ts_s"), p, KEY, "ts_s", ["y"], block).collect()}
    for t, rs in by_key(data).items():
        xy = sorted((x, y) for k, x, y in pts if k == t)
        want = np.interp([float(r[2]) for r in rs], [x for x, _ in xy], [y for _, y in xy])
        assert np.allclose([got[(t, i)] for i in range(len(rs))], want)


@pytest.mark.parametrize("closed", [True, False])
def test_interval_flags(spark, closed):
    data, df = hot(spark)
    iv = [(1, 1003.0, 1003.0), (1, 1005.0, 1020.0), (1, 1010.0, 1012.0), (1, 1090.0, 1500.0), (4, 3000.0, 4002.0), (9, 0.0, 1.0)]
    d = spark.createDataFrame(iv, "transect_id long, a double, b double")
    got = {(r.transect_id, r.ping_index): r.hit for r in asof.flag_in_intervals(df, d, KEY, "ts_s", "a", "b", "hit", closed, rows=4).collect()}
    for t, rs in by_key(data).items():
        for i, r in enumerate(rs):
            x = float(r[2])
            want = any(k == t and a <= x and (x <= b if closed else x < b) for k, a, b in iv)
            assert got[(t, i)] == want, (t, i)


def test_fill_linear_keeps_all_missing(spark):
    df = spark.createDataFrame([(1, i, float(i), None) for i in range(3)] + [(2, 0, 0.0, 1.0), (2, 1, 1.0, None), (2, 2, 2.0, 3.0)],
                               "transect_id long, ping_index long, ts_s double, y double")
    got = {(r.transect_id, r.ping_index): r.y for r in asof.fill_linear(df, KEY, "ts_s", ["y"], rows=2).collect()}
    assert got == {(1, 0): None, (1, 1): None, (1, 2): None, (2, 0): 1.0, (2, 1): 2.0, (2, 2): 3.0}


def test_empty_input(spark):
    df = spark.createDataFrame([], "transect_id long, ping_index long, ts_s double, v double, f boolean")
    assert shift(df, KEY, {"a": ("v", 1)}).count() == 0
    assert quantiles(df, KEY, "v", [0.5]).count() == 0
    assert runs.flag_runs(df, "f").count() == 0
    assert index_block(df).count() == 0


@pytest.mark.parametrize("n,rows,far", [(20_000, 1_000, (10_000, 86_400.0)), (10_000, 100, (0, -1.6e9))])
def test_far_values_do_not_fill_a_block(spark, n, rows, far):
    """A gap of a day, or one time stamp at zero: no block takes over twice the rows wanted."""
    at, by = far
    x = F.col("id").cast("double")
    x = F.when(F.col("id") >= at, x + by).otherwise(x) if by > 0 else F.when(F.col("id") == at, by).otherwise(x)
    df = spark.range(n).select(F.lit(1).alias("transect_id"), x.alias("x"))
    sizes = [r["count"] for r in value_block(df, KEY, "x", rows).groupBy(BLOCK).count().collect()]
    assert sum(sizes) == n and max(sizes) <= 2 * rows


def test_one_time_stamp_for_all_rows_fits_in_blocks(spark):
    """Equal values fill several blocks when a second column orders them."""
    n = 6000
    x = F.when(F.col("id") < 1500, F.col("id") * 0.5).when(F.col("id") < 5500, 1000.0).otherwise(F.col("id") * 1.0)
    df = spark.range(n).select(F.lit(1).alias("transect_id"), x.alias("x"), F.pmod(F.col("id") * 7919, F.lit(n)).alias("y")).union(spark.range(40).selectExpr("2", "7.0", "id"))
    for rows in (100, 20, 1000, 100_000):
        got = dense_index(df.repartition(3), KEY, ["x", "y"], "i", rows).collect()
        want = {}
        for r in sorted((r.transect_id, r.x, r.y) for r in got):
            want.setdefault(r[0], []).append(r)
        assert all(want[r.transect_id][r.i] == (r.transect_id, r.x, r.y) for r in got) and len(got) == n + 40
        sizes = [r["count"] for r in value_block(df, KEY, "x", rows, "y").groupBy("transect_id", BLOCK).count().collect()]
        assert max(sizes) <= 3 * rows + n // 128


def test_facts_of_heavy_recordings_are_not_joined_by_key(spark):
    rows = [(1, i, [float(i)]) for i in range(3000)] + [(100 + i, i, None) for i in range(2 * HEAVY)] + [(None, 5, None)]
    df = spark.createDataFrame(rows, "transect_id long, i long, sv array<double>").repartition(4)
    facts = df.groupBy("transect_id").agg(F.count("*").alias("n"), F.sum("i").alias("s"), F.max("i").alias("m")).where("transect_id <> 105")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = with_facts(df, facts, KEY, "n")
        got = {(r.transect_id, r.i): (r.s, r.m, r.sv) for r in d.collect()}
        plan = d._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    s = sum(range(3000))
    assert got == {(t, i): ((s, 2999, v) if t == 1 else (None, None, v) if t in (105, None) else (i, i, v)) for t, i, v in rows}
    # Rows themselves move by (recording, slot) only; by recording alone move partial sums.
    final = plan.split("Initial Plan")[0]
    assert "BroadcastHashJoin" in final and "_slot" in final
    for line in final.splitlines():
        assert not ("hashpartitioning(transect_id" in line and "_slot" not in line and "sv" in line)
