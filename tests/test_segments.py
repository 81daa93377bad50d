import numpy as np
import pytest
from pyspark.sql import functions as F

from pinglake.operators import segments


def recording(spark, gaps, n=50):
    """Pings a second apart with 1,000 s gaps before the given pings."""
    t, out = 0.0, []
    for i in range(n):
        t += 1000.0 if i in gaps else 1.0
        out.append((1, i, t))
    return spark.createDataFrame(out[::-1], "transect_id long, ping_index long, ts_s double")


def test_split_and_number(spark, rows):
    d = segments.split_gaps(recording(spark, {20}), rows=7)
    assert rows(d.groupBy("segment_id").agg(F.min("ping_index"), F.max("ping_index"))) == [(0, 0, 19), (1, 20, 49)]


def test_parts_are_near_equal_and_rounded_half_even(spark, rows):
    d = segments.cut_long(segments.split_gaps(recording(spark, {21})), 10)
    got = rows(d.select("part_id", "part_start", "part_end").distinct())
    edges = list(np.round(np.linspace(0, 21, 4)).astype(int)) + list(np.round(np.linspace(21, 50, 4)).astype(int))[1:]
    assert got == [(i, a, b) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))]


@pytest.mark.parametrize("pad_on,want", [("max", {(0, 4), (4, 4), (4, 0)}), ("none", {(0, 0)}), ("thr", {(0, 0), (0, 4), (4, 0)}), ("all", {(0, 4), (4, 4), (4, 0)})])
def test_padding(spark, pad_on, want):
    d = segments.pad_overlap(segments.cut_long(segments.split_gaps(recording(spark, {25})), 10), 4, pad_on)
    got = {(r.pad_start, r.pad_end) for r in d.select("pad_start", "pad_end").distinct().collect()}
    assert got == want or (pad_on == "max" and got <= want)
    for r in d.groupBy("part_id", "part_start", "part_end", "pad_start", "pad_end").agg(F.min("ping_index").alias("a"), F.max("ping_index").alias("z"), F.count("*").alias("n")).collect():
        assert (r.a, r.z) == (r.part_start - r.pad_start, r.part_end + r.pad_end - 1)
        assert r.n == r.z - r.a + 1
    back = segments.join_parts(d)
    assert sorted(r.ping_index for r in back.collect()) == list(range(50))


def test_unknown_padding_is_refused(spark):
    with pytest.raises(ValueError):
        segments.pad_overlap(segments.cut_long(segments.split_gaps(recording(spark, set())), 10), 4, "some")


def test_parts_on_different_grids_are_refused(spark):
    d = spark.createDataFrame([(1, 0, False, 0.0, 1.0), (1, 1, False, 0.0, 2.0)], "transect_id long, ping_index long, is_pad boolean, depth_start double, depth_stop double")
    with pytest.raises(Exception, match="depth grids"):
        segments.join_parts(d).collect()


@pytest.mark.parametrize("mode,numpy_mode", [("reflect", "reflect"), ("edge", "edge"), ("symmetric", "symmetric"), ("constant", "constant")])
@pytest.mark.parametrize("n,pad", [(5, 14), (2, 5)])
def test_pad_in_time(spark, mode, numpy_mode, n, pad):
    df = spark.createDataFrame([(1, i, float(i + 1)) for i in range(n)], "transect_id long, ping_index long, v double")
    got = [r.v if r.v is not None else 0.0 for r in segments.pad_in_time(df, pad, mode).orderBy("ping_index").collect()]
    assert got == list(np.pad(np.arange(1.0, n + 1), pad, mode=numpy_mode))


@pytest.mark.parametrize("previous,want", [("diff", (5, 5)), ("add", (7, 5)), ("noop", (2, 5))])
def test_earlier_padding(spark, previous, want):
    df = spark.createDataFrame([(1, i, 2, 0) for i in range(9)], "transect_id long, ping_index long, pad_start long, pad_end long")
    d = segments.pad_in_time(df, 5, "edge", previous)
    assert {(r.pad_start, r.pad_end) for r in d.collect()} == {want}
    assert d.count() == 9 + (want[0] - 2) + want[1]


def test_windows_and_ranges(spark):
    n = spark.createDataFrame([(1, 20), (2, 5)], "transect_id long, n_pings long")
    w = segments.windows(n, 8).orderBy("transect_id", "window").collect()
    assert [(r.transect_id, r.center, r.i1, r.i2) for r in w] == [(1, 3, -1, 7), (1, 10, 6, 14), (1, 17, 13, 21), (2, 2, -2, 6)]
    p = spark.createDataFrame([(1, i, float(i)) for i in range(20)], "transect_id long, ping_index long, v double")
    r = spark.createDataFrame([(1, -2, 3), (1, 18, 22)], "transect_id long, i1 long, i2 long")
    got = [(x.i1, x.out_index, x.v) for x in segments.read_ranges(p, r, "edge").orderBy("i1", "out_index").collect()]
    assert [g[2] for g in got] == [0, 0, 0, 1, 2, 18, 19, 19, 19]


def test_range_outside_is_refused(spark):
    p = spark.createDataFrame([(1, i) for i in range(5)], "transect_id long, ping_index long")
    r = spark.createDataFrame([(1, 9, 12)], "transect_id long, i1 long, i2 long")
    with pytest.raises(Exception, match="outside"):
        segments.read_ranges(p, r).collect()
