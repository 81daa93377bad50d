import numpy as np
import pytest
from pyspark.sql import functions as F

from pinglake.functions import arrays as A
from pinglake.operators import grid, lines, masks, sampling


def one(spark, expr, **cols):
    names = list(cols)
    types = {"l": "array<boolean>", "v": "array<double>", "x": "double"}
    df = spark.createDataFrame([tuple(cols[n] for n in names)], ", ".join(f"{n} {types[n[0]]}" for n in names)) if names else spark.range(1)
    return df.select(expr.alias("r")).collect()[0].r


@pytest.mark.parametrize("l,first,last", [([False, True, True], 1, 2), ([], -1, -1), ([False], -1, -1), ([True], 0, 0)])
def test_first_and_last(spark, l, first, last):
    assert one(spark, F.struct(A.first_index("l"), A.last_index("l")), l=l) == (first, last)


def test_squash_along_depth(spark):
    l = [True, False, True, True, False, True, True, True, False, True]
    assert one(spark, A.squash_short_runs("l", 3), l=l) == [False] * 5 + [True] * 3 + [False, False]
    assert one(spark, A.squash_short_runs("l", 1), l=l) == l
    assert one(spark, A.squash_short_runs("l", -4), l=l) == l


def test_medians_and_missing(spark):
    assert one(spark, A.array_median("v"), v=[3.0, 1.0, 2.0, 10.0]) == 2.5
    assert one(spark, A.array_median("v"), v=[3.0, None, 2.0]) is None
    assert one(spark, A.array_median("v"), v=[]) is None
    assert one(spark, A.sentinel_to_null("v"), v=[1.0, 9.9e37, -9.9e37, float("nan")]) == [1.0, None, None, None]
    assert one(spark, A.strict_min("x1", "x2"), x1=1.0, x2=None) is None
    assert one(spark, A.strict_max("x1", "x2"), x1=1.0, x2=3.0) == 3.0


@pytest.mark.parametrize("n", [1, 2, 5])
def test_linspace(spark, n):
    assert one(spark, A.linspace(F.lit(2.0), F.lit(4.0), n)) == list(np.linspace(2, 4, n))


def test_regrid_keeps_gaps(spark):
    v = [0.0, 1.0, None, 3.0, 4.0]
    f = lambda a, b, n, thr: one(spark, A.regrid_keep_missing("v", F.lit(0.0), F.lit(4.0), F.lit(a), F.lit(b), F.lit(n), thr), v=v)
    assert f(0.0, 4.0, 5, 0.0) == [0.0, 1.0, None, 3.0, 4.0]
    assert f(0.0, 4.0, 9, 0.0) == [0.0, 0.5, 1.0, None, None, None, 3.0, 3.5, 4.0]
    assert f(0.0, 4.0, 9, 0.5) == [0.0, 0.5, 1.0, 1.5, None, 2.5, 3.0, 3.5, 4.0]
    assert f(-1.0, 5.0, 7, 1.0) == [None, 0.0, 1.0, 2.0, 3.0, 4.0, None]
    assert one(spark, A.regrid_keep_missing("v", F.lit(0.0), F.lit(2.0), F.lit(0.0), F.lit(2.0), F.lit(3), 1.0), v=[None, 1.0, None]) == [None, None, None]


def test_regrid_recordings(spark):
    d = [(1, 0, [1.0, 2.0, 3.0], 0.0, 2.0), (1, 1, [3.0, 2.0, 1.0], 2.0, 0.0), (1, 2, [1.0, 2.0, 3.0, 4.0], 0.0, 3.0), (1, 3, [1.0, 2.0, 3.0], 0.0, 2.0)]
    df = spark.createDataFrame(d, "transect_id long, ping_index long, sv array<double>, depth_start double, depth_stop double")
    got = {r.ping_index: (r.sv, r.depth_start, r.depth_stop) for r in grid.regrid(df).collect()}
    assert got == {0: ([1.0, 2.0, 3.0], 0.0, 2.0), 1: ([1.0, 2.0, 3.0], 0.0, 2.0), 2: ([1.0, 2.0, 3.0], 0.0, 2.0), 3: ([1.0, 2.0, 3.0], 0.0, 2.0)}
    assert {r.ping_index: len(r.sv) for r in grid.regrid(df, "max").collect()} == {0: 4, 1: 4, 2: 4, 3: 4}
    assert grid.regrid(df, skip=1).count() == 3


def test_drop_thin(spark):
    l = [False, False, True, False, False, True, True, True, False, True]
    assert one(spark, masks.drop_thin("l"), l=l) == [False, False, False, False, False, True, False, True, False, True]


def test_line_from_probability(spark):
    d = F.array(*[F.lit(float(x)) for x in (1, 2, 3)])
    assert one(spark, lines.line_from_probability("v", "above", d), v=[0.9, 0.6, 0.1]) == 2.0
    assert one(spark, lines.line_from_probability("v", "below", d), v=[0.1, 0.6, 0.9]) == 2.0
    assert one(spark, lines.line_from_probability("v", "above", d), v=[0.1, 0.1, 0.1]) == 3.0
    assert one(spark, lines.line_from_probability("v", "below", d), v=[0.1, 0.1, 0.1]) == 3.0


def test_softmax_and_sums(spark):
    x = np.array([0.0, 3.0, -2.0, 800.0, 799.0])
    p = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    assert np.allclose(one(spark, A.softmax("v"), v=x.tolist()), p)
    assert np.allclose(one(spark, A.p_below(A.softmax("v")), v=x.tolist()), np.cumsum(p))
    assert np.allclose(one(spark, A.p_above(A.softmax("v")), v=x.tolist()), np.cumsum(p[::-1])[::-1])
    assert np.isclose(one(spark, A.log_avg_exp("v"), v=x.tolist()), 800 + np.log(np.exp(x - 800).mean()))


def test_facing_rules(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 2.0], 9.0, 1.0)], "transect_id long, ping_index long, sv array<double>, depth_start double, depth_stop double")
    r = grid.face_down(df).collect()[0]
    assert (r.sv, r.depth_start, r.is_upfacing, r.facing_mismatch) == ([2.0, 1.0], 1.0, True, False)
    r = grid.face_down(df, "downward").collect()[0]
    assert (r.sv, r.is_upfacing, r.facing_mismatch) == ([1.0, 2.0], False, True)
    with pytest.raises(ValueError):
        grid.face_down(df, "sideways")


def test_default_lines_raise(spark):
    row = (1, 0.0, 9.0, False, True, True, False, False, 5.0, 1.0, 2.0, 0.0)
    df = spark.createDataFrame([row], "transect_id long, depth_start double, depth_stop double, has_bottom boolean, has_surface boolean, has_turbulence boolean, is_upfacing boolean, has_air boolean, bottom double, surface double, turbulence double, air double")
    assert lines.default_lines(df.withColumn("is_upfacing", F.lit(True))).collect()[0].bottom == 9.0
    with pytest.raises(Exception, match="no bottom line"):
        lines.default_lines(df).select("turbulence").collect()


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(1000)
    a = {r.id: r.part for r in sampling.split(df.repartition(7), ["id"], 3).collect()}
    b = {r.id: r.part for r in sampling.split(df.coalesce(1), ["id"], 3).collect()}
    assert a == b
    assert [sum(v == k for v in a.values()) for k in ("train", "test", "validate")] == [800, 100, 100]
    u = [r.u for r in df.select(sampling.uniform(1, ["id"]).alias("u")).collect()]
    assert 0.45 < np.mean(u) < 0.55 and min(u) >= 0 and max(u) < 1


def test_interleave_keeps_proportions(spark):
    df = spark.createDataFrame([("a", i) for i in range(60)] + [("b", i) for i in range(20)], "ds string, i long")
    got = [r.ds for r in sampling.interleave(df, "ds", ["ds", "i"], 1).orderBy("position").collect()]
    for n in range(1, 81):
        assert abs(got[:n].count("b") - n / 4) <= 1
