from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from pinglake.operators import patches


def frame(spark, masks):
    data = [(t, i, 100.0 * t + i, 0.0, float(m.shape[1] - 1), [bool(x) for x in row]) for t, m in masks.items() for i, row in enumerate(m)]
    return spark.createDataFrame(data, "transect_id long, ping_index long, ts_s double, depth_start double, depth_stop double, mask_patches array<boolean>").repartition(3)


def filled(m):
    """Set what the border cannot reach."""
    h, w = m.shape
    seen = np.zeros_like(m)
    q = deque((i, j) for i in range(h) for j in range(w) if (i in (0, h - 1) or j in (0, w - 1)) and not m[i, j])
    for p in q:
        seen[p] = True
    while q:
        i, j = q.popleft()
        for a, b in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
            if 0 <= a < h and 0 <= b < w and not m[a, b] and not seen[a, b]:
                seen[a, b] = True
                q.append((a, b))
    return ~seen


def areas(m):
    """Cells per 4-connected area."""
    h, w = m.shape
    lab = np.zeros(m.shape, int)
    n = 0
    for i in range(h):
        for j in range(w):
            if m[i, j] and not lab[i, j]:
                n += 1
                q = deque([(i, j)])
                lab[i, j] = n
                while q:
                    a, b = q.popleft()
                    for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                        if 0 <= c < h and 0 <= d < w and m[c, d] and not lab[c, d]:
                            lab[c, d] = n
                            q.append((c, d))
    return lab


def random_masks(seed):
    rng = np.random.default_rng(seed)
    return {t: rng.random((int(rng.integers(3, 40)), 12)) < p for t, p in enumerate((0.3, 0.5, 0.62, 0.7, 0.8, 0.55))}


@pytest.mark.parametrize("chunk", [2, 5])
def test_fill_across_chunks(spark, chunk):
    masks = random_masks(chunk)
    snake = np.ones((20, 12), bool)
    snake[2:18, 3] = False
    snake[17, 3:8] = False
    snake[5:18, 7] = False
    masks[50] = snake
    masks[51] = snake.copy()
    masks[51][0:3, 3] = False
    got = {(r.transect_id, r.ping_index): r.mask_patches for r in patches.fill_enclosed(frame(spark, masks), "mask_patches", chunk=chunk).collect()}
    for t, m in masks.items():
        want = filled(m)
        assert [got[(t, i)] for i in range(len(m))] == want.tolist(), t


@pytest.mark.parametrize("n,bound", [(4096, 15)])
def test_a_corridor_over_many_chunks_takes_few_rounds(spark, monkeypatch, n, bound):
    """A chain of labels from the border, and one that is closed off: rounds grow with the logarithm."""
    rounds = []
    kept = patches.cut
    monkeypatch.setattr(patches, "cut", lambda df, name="x": (rounds.append(name), kept(df, name))[1])
    at = lambda c: F.struct(c.cast("long").alias("c"), F.lit(1).alias("l"))
    i = F.col("id")
    half = spark.range(n - 1).select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("transect_id")).select("transect_id", at(i).alias("u"), at(i + 1).alias("v"))
    edges = half.unionByName(half.select("transect_id", F.col("v").alias("u"), F.col("u").alias("v"))).cache()
    border = spark.range(1).select(F.lit(1).alias("transect_id"), at(F.lit(n - 1)).alias("u"))
    got = patches._roots(edges, ["transect_id"], border)
    r = got.groupBy("transect_id", F.col("r.c").alias("c")).count().orderBy("transect_id").collect()
    assert [tuple(x) for x in r] == [(1, -1, n), (2, 0, n)]
    assert len(rounds) - 1 <= bound, len(rounds)


@pytest.mark.parametrize("chunk", [3])
def test_components_across_chunks(spark, chunk):
    masks = random_masks(9)
    got = {}
    for r in patches.components(frame(spark, masks), "mask_patches", chunk=chunk).collect():
        got[(r.transect_id, r.ping_index)] = r.patch
    for t, m in masks.items():
        lab = areas(m)
        names = {}
        for i in range(len(m)):
            for j in range(m.shape[1]):
                p = got[(t, i)][j]
                assert (p is not None) == bool(m[i, j])
                if p is not None:
                    names.setdefault(int(lab[i, j]), set()).add((p.c, p.l))
        assert all(len(v) == 1 for v in names.values())
        assert len(set.union(*names.values())) == len(names)


def test_contours(spark):
    m = np.zeros((12, 10), bool)
    m[2:5, 2:5] = True
    m[3, 3] = False  # enclosed
    m[7, 7] = True
    m[8, 8] = True  # touches only at a corner: its own contour
    m[11, 0:2] = True  # open at the corner of the recording
    for chunk in (4,):
        c = patches.patch_contours(frame(spark, {1: m}), chunk=chunk).orderBy("first", "area").collect()
        assert [(r.first, r.area) for r in c] == [(2, 8.5), (7, 0.5), (8, 0.5), (11, 0.25)]
        big = c[0]
        assert (big.ts_start, big.ts_end, big.top, big.low) == (101.5, 104.5, 1.5, 4.5)
        assert big.points[0] == big.points[-1] and big.notes.startswith("Removed patch\nArea in pixels: 8.5")
        assert [r.number for r in sorted(c, key=lambda r: r.first)] == [1, 2, 3, 4]


def followed(pieces):
    """Contours by walking along the pieces: open ones from their free start, closed ones from their smallest point."""
    nxt, out = dict(pieces), []
    ends = set(nxt.values())
    for s in sorted(p for p in nxt if p not in ends):
        out.append([s])
        while out[-1][-1] in nxt:
            out[-1].append(nxt.pop(out[-1][-1]))
    while nxt:
        out.append([min(nxt)])
        while out[-1][-1] in nxt:
            out[-1].append(nxt.pop(out[-1][-1]))
    return out


def area_of(line):
    x, y = np.array(line, float).T
    return abs(np.sum(x * np.roll(y, -1) - y * np.roll(x, -1))) / 2


@pytest.mark.parametrize("seed,block", [(3, 4), (4, 65536)])
def test_contour_points_in_order(spark, seed, block):
    masks = random_masks(seed)
    df = frame(spark, masks)
    full = patches.components(patches.fill_enclosed(df, "mask_patches", chunk=5), "mask_patches", chunk=5)
    walked = {}
    for r in patches.contour_pieces(full, "mask_patches").collect():
        walked.setdefault(r.transect_id, {})[(r.x0, r.y0)] = (r.x1, r.y1)
    regions, points = patches.contours(df, chunk=5, rows=block)
    got = {}
    for r in points.orderBy("transect_id", "number", "seq").collect():
        got.setdefault(r.transect_id, {}).setdefault(r.number, []).append((r.ts_s - 100 * r.transect_id, r.depth))
    told = {(r.transect_id, r.number): r for r in regions.collect()}
    for t, pieces in walked.items():
        want = sorted(followed(pieces))
        assert [got[t][k] for k in sorted(got[t])] == want
        for k, line in zip(sorted(got[t]), want):
            r = told[(t, k)]
            assert r.n_points == len(line) and abs(r.area - area_of(line)) < 1e-9 and abs(r.area_ts - area_of(line)) < 1e-6
            assert (r.top, r.low) == (min(y for _, y in line), max(y for _, y in line))
    assert len(told) == sum(len(x) for x in got.values())
    listed = patches.patch_contours(df, chunk=5, rows=block).collect()
    assert {(r.transect_id, r.number): [(p.ts_s - 100 * r.transect_id, p.depth) for p in r.points] for r in listed} == {(t, k): v for t, x in got.items() for k, v in x.items()}


def test_a_long_contour_is_linked_as_rows(spark):
    """A ring of 30,000 pieces and an open line of 20,000: no group, no Python."""
    n, m = 30_000, 20_000
    ring = spark.range(n).select(F.lit(1).alias("transect_id"), (F.pmod(F.col("id") * 7919, F.lit(n)) + 10).alias("at"), (F.pmod((F.col("id") + 1) * 7919, F.lit(n)) + 10).alias("to"))
    line = spark.range(m).select(F.lit(2).alias("transect_id"), (F.lit(m) - F.col("id")).alias("at"), (F.lit(m) - F.col("id") - 1).alias("to"))
    got = patches.linked(ring.unionByName(line))
    assert "Python" not in got._jdf.queryExecution().toString() and "Pandas" not in got._jdf.queryExecution().toString()
    r = got.groupBy("transect_id", "contour").agg(F.count("*").alias("n"), F.min("pos").alias("a"), F.max("pos").alias("b"), F.countDistinct("pos").alias("d")).orderBy("transect_id").collect()
    assert [tuple(x) for x in r] == [(1, 10, n, 0, n - 1, n), (2, m, m, 0, m - 1, m)]
    assert got.where("transect_id = 1 AND pmod(pos * 7919, 30000) + 10 <> at").isEmpty() and got.where("transect_id = 2 AND at <> 20000 - pos").isEmpty()


def test_small_patches_are_dropped(spark):
    m = np.zeros((8, 8), bool)
    m[2, 2] = True
    m[4:7, 4:7] = True
    df = frame(spark, {1: m})
    assert [r.area for r in patches.patch_contours(df, min_area=0.5).orderBy("first").collect()] == [0.5, 8.5]
    assert [r.area for r in patches.patch_contours(df, min_area=0.6).collect()] == [8.5]
    assert patches.patch_contours(df, min_area=-1).count() == 0


def test_polygon_area(spark):
    pts = [(1, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (4, 0), (4, 3), (0, 3)])]
    pts += [(2, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (0, 3), (4, 3), (4, 0), (0, 0)])]
    d = spark.createDataFrame(pts, "id long, i long, x double, y double")
    assert {r.id: r.area for r in patches.polygon_area(d, ["id"], "i", "x", "y").collect()} == {1: 12.0, 2: 12.0}


def test_sparse_vertices_need_edges(spark):
    m = np.zeros((10, 8), bool)
    df = frame(spark, {1: m}).withColumn("sv", F.transform("mask_patches", lambda x: F.lit(0.0))).drop("mask_patches")
    r = spark.createDataFrame([(1, 1, [(102.0, 1.0), (102.0, 5.0), (106.0, 5.0), (106.0, 1.0), (102.0, 1.0)])],
                              "transect_id long, number long, points array<struct<ts_s:double,depth:double>>")
    n = lambda d: sum(sum(x.mask_patches) for x in d.collect())
    assert n(patches.patches_to_cells(df, r)) == 4
    assert n(patches.patches_to_cells(df, r, draw_edges=True)) == 25
