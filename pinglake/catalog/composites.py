"""Patches and whole flows."""

import numpy as np
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import patches, probs
from ..plans import decompose, evaluate, job, scoring
from ..session import cut, scratch
from ..sources import pings
from .registry import query

PK = ["transect_id", "ping_index"]
KEY = ["transect_id"]


def _holes(t):
    """Masks with frames around clear cells: blocks of 12 pings by 10 cells, framed two cells thick, some of them open."""
    k, v = F.col("ping_index"), F.col("transect_id")
    frame = lambda j: (k % 12).between(2, 9) & j.between(20, 29) & ~((k % 12).between(4, 7) & j.between(22, 27))
    gap = lambda j: (v % 3 == 0) & (k % 12 == 5) & (j < 23)
    return t.echo.withColumn("m", F.transform("sv", lambda _, j: frame(j) & ~gap(j)))


# A framed block of clear cells is enclosed if all of it lies inside the recording and no
# gap opens it.
_HOLES = """,
n AS (SELECT transect_id, max(ping_index) AS last FROM echo GROUP BY 1),
m AS (SELECT s.transect_id, ping_index AS k, j, n.last, (ping_index % 12 BETWEEN 2 AND 9 AND j BETWEEN 20 AND 29 AND NOT (ping_index % 12 BETWEEN 4 AND 7 AND j BETWEEN 22 AND 27))
             AND NOT (s.transect_id % 3 = 0 AND ping_index % 12 = 5 AND j < 23) AS m FROM samp s JOIN n USING (transect_id)),
f AS (SELECT *, m OR (transect_id % 3 <> 0 AND k % 12 BETWEEN 4 AND 7 AND j BETWEEN 22 AND 27 AND (k - k % 12) + 8 <= last) AS filled FROM m)"""


def _stand_in_model():
    """A model without weights, to run the flows: channel c is the signal times 1 - c/20."""

    def f(signals):
        return {"logits": np.stack([signals * (1 - c / 20) for c in range(len(probs.CHANNELS))], axis=1)}

    return f


@query("u4_fill_enclosed", "samp", _HOLES + " SELECT transect_id, k AS ping_index, CAST(j AS INT) AS j, filled FROM f")
def _(t):
    d = patches.fill_enclosed(_holes(t), "m", chunk=16)
    return d.select(*PK, F.posexplode("m").alias("j", "filled"))


def _blocks(t):
    """The same frames without gaps."""
    k = F.col("ping_index")
    frame = lambda j: (k % 12).between(2, 9) & j.between(20, 29) & ~((k % 12).between(4, 7) & j.between(22, 27))
    return t.echo.withColumn("mask_patches", F.transform("sv", lambda _, j: frame(j)))


# A whole block is one closed contour: 8 by 10 cells, from the corner nearest the start along
# rising depth. A block that the recording's end cuts is open there, and so is what it framed,
# which is followed the other way round. ``pt``: points in cells; ``td``: their time and depth.
_CONTOURS = """,
n AS (SELECT transect_id, max(ping_index) AS last, min(ts_s) AS t0 FROM echo GROUP BY 1),
b AS (SELECT transect_id, last, b, least(b + 9, last) AS e, b + 9 < last AS whole FROM (SELECT transect_id, last, unnest(range(0, last // 12 + 1)) * 12 AS b FROM n) WHERE b + 2 <= last),
o AS (SELECT * FROM b WHERE last BETWEEN b + 4 AND b + 7),
side AS (SELECT unnest(range(20, 30)) AS y),
pt AS (
  SELECT transect_id, b + 2 AS first, CASE WHEN whole THEN y - 20 ELSE e - b - 1 + y - 20 END AS seq, b + 1.5::DOUBLE AS x, y::DOUBLE AS y FROM b, side
  UNION ALL SELECT transect_id, b + 2, CASE WHEN whole THEN 10 + k ELSE e - b + 9 + k END, b + 2 + k, 29.5 FROM (SELECT *, unnest(range(0, e - b - 1)) AS k FROM b)
  UNION ALL SELECT transect_id, b + 2, 18 + 29 - y, b + 9.5, y FROM b, side WHERE whole
  UNION ALL SELECT transect_id, b + 2, CASE WHEN whole THEN 28 + 7 - k ELSE e - b - 2 - k END, b + 2 + k, 19.5 FROM (SELECT *, unnest(range(0, e - b - 1)) AS k FROM b)
  UNION ALL SELECT transect_id, b + 2, 36, b + 1.5, 20 FROM b WHERE whole
  UNION ALL SELECT transect_id, b + 4, last - b - 4 - k, b + 4 + k, 27.5 FROM (SELECT *, unnest(range(0, last - b - 3)) AS k FROM o)
  UNION ALL SELECT transect_id, b + 4, last - b - 3 + 27 - y, b + 3.5, y FROM o, side WHERE y BETWEEN 22 AND 27
  UNION ALL SELECT transect_id, b + 4, last - b + 3 + k, b + 4 + k, 21.5 FROM (SELECT *, unnest(range(0, last - b - 3)) AS k FROM o)
),
nr AS (SELECT transect_id, first, row_number() OVER (PARTITION BY transect_id ORDER BY x, y) AS number FROM pt WHERE seq = 0),
td AS (SELECT pt.transect_id, number, pt.first, seq, x, y, (p.ts_s + q.ts_s) / 2 AS ts_s, p.depth_start + y * (p.depth_stop - p.depth_start) / 63 AS depth
       FROM pt JOIN nr ON nr.transect_id = pt.transect_id AND nr.first = pt.first JOIN echo p ON p.transect_id = pt.transect_id AND p.ping_index = floor(x) JOIN echo q ON q.transect_id = pt.transect_id AND q.ping_index = ceil(x))"""


@query("u5_contour_points", "echo", _CONTOURS + """
SELECT transect_id, number, CAST(seq AS BIGINT) AS seq, round(ts_s, 4) AS ts_s, round(depth, 6) AS depth FROM td""")
def _(t):
    _, points = patches.contours(_blocks(t), chunk=16)
    return points.select("transect_id", "number", "seq", F.round("ts_s", 4).alias("ts_s"), F.round("depth", 6).alias("depth"))


@query("u5_patch_contours", "echo", _CONTOURS + """,
f AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(ts_s) OVER w AS nt, lead(depth) OVER w AS nd, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy, first_value(ts_s) OVER w AS ft, first_value(depth) OVER w AS fd
      FROM td WINDOW w AS (PARTITION BY transect_id, number ORDER BY seq))
SELECT transect_id, number, CAST(any_value(first) AS BIGINT) AS first, round(abs(sum(y * (coalesce(nx, fx) - x) - x * (coalesce(ny, fy) - y))) / 2, 6) AS area,
  round(abs(sum((depth - fd) * (coalesce(nt, ft) - ts_s) - (ts_s - ft) * (coalesce(nd, fd) - depth))) / 2, 3) AS area_ts, CAST(count(*) AS INT) AS n_points,
  round(min(ts_s), 4) AS ts_start, round(max(ts_s), 4) AS ts_end, round(min(depth), 6) AS top, round(max(depth), 6) AS low,
  'Removed patch ' || number AS region_name, ['Removed patch', 'Area in pixels: ' || round(abs(sum(y * (coalesce(nx, fx) - x) - x * (coalesce(ny, fy) - y))) / 2, 6)::DOUBLE] AS notes
FROM f GROUP BY transect_id, number""")
def _(t):
    c, _ = patches.contours(_blocks(t), chunk=16)
    r = lambda x, n: F.round(x, n).alias(x)
    notes = F.slice(F.split("notes", "\n"), 1, 2).alias("notes")
    return c.select("transect_id", "number", "first", r("area", 6), r("area_ts", 3), "n_points", r("ts_start", 4), r("ts_end", 4), r("top", 6), r("low", 6), "region_name", notes)


@query("u6_patches_to_cells", "samp", """
SELECT transect_id, ping_index, CAST(j AS INT) AS j, ping_index % 12 BETWEEN 2 AND 9 AND j BETWEEN 20 AND 29 AS patch FROM samp""")
def _(t):
    flat = _blocks(t).withColumns({"depth_start": F.lit(0.25), "depth_stop": F.lit(31.75)})
    # One region per block: the centres of its corner cells.
    c = flat.where(F.exists("mask_patches", lambda x: x)).withColumn("b", F.floor(F.col("ping_index") / 12))
    box = c.groupBy("transect_id", F.col("b").cast("long").alias("number")).agg(F.min("ts_s").alias("a"), F.max("ts_s").alias("z"))
    pt = lambda x, d: F.struct(F.col(x).alias("ts_s"), F.lit(d).alias("depth"))
    top, low = 0.25 + 20 * 0.5, 0.25 + 29 * 0.5
    r = box.select("transect_id", "number", F.array(pt("a", top), pt("a", low), pt("z", low), pt("z", top), pt("a", top)).alias("points"))
    d = patches.patches_to_cells(flat, r, draw_edges=True, chunk=16)
    return d.select(*PK, F.posexplode("mask_patches").alias("j", "patch"))


# Normalised, turned downwards, cut at gaps and after 1,280 pings with 32 pings of context, holes
# filled within each part (the rule of w22_fill_holes), then halved to 32 cells.
_SCORED = """,
sc AS (SELECT transect_id, avg(v) AS c, stddev_pop(v) AS s FROM samp GROUP BY 1),
nm AS (SELECT transect_id, ping_index, CASE WHEN is_upfacing THEN 63 - j ELSE j END AS j, (v - c) / s AS v FROM samp JOIN sc USING (transect_id)),
steps AS (SELECT transect_id, ping_index, ts_s - lag(ts_s) OVER (PARTITION BY transect_id ORDER BY ping_index) AS dt FROM echo),
base AS (SELECT transect_id, quantile_cont(dt, 0.975) AS q FROM steps GROUP BY 1),
seg AS (SELECT t.transect_id, ping_index, sum(CASE WHEN dt > q * 20 THEN 1 ELSE 0 END) OVER (PARTITION BY t.transect_id ORDER BY ping_index) AS segment_id FROM steps t JOIN base USING (transect_id)),
sb AS (SELECT transect_id, segment_id, min(ping_index) AS a, max(ping_index) + 1 AS z FROM seg GROUP BY 1, 2),
sn AS (SELECT *, unnest(range(0, n)) AS i FROM (SELECT *, CAST(ceil((z - a) / 1280.0::DOUBLE) AS BIGINT) AS n FROM sb)),
pb AS (SELECT transect_id, i, n, CAST(round_even(a + (z - a) * i / n::DOUBLE, 0) AS BIGINT) AS a, CAST(round_even(a + (z - a) * (i + 1) / n::DOUBLE, 0) AS BIGINT) AS z FROM sn),
pt AS (SELECT *, row_number() OVER (PARTITION BY transect_id ORDER BY a) AS part, max(z) OVER (PARTITION BY transect_id) AS total FROM pb),
pw AS (SELECT *, CASE WHEN i > 0 THEN greatest(0, a - 32) ELSE a END AS i0, CASE WHEN i < n - 1 THEN least(total, z + 32) ELSE z END - 1 AS i1 FROM pt),
h AS (SELECT nm.transect_id, part, a, z, i0, i1, ping_index AS k, j, v, v IS NULL AS na FROM nm JOIN pw ON pw.transect_id = nm.transect_id AND ping_index BETWEEN i0 AND i1),
bp AS (SELECT transect_id, part, k, count(*) AS c FROM h WHERE na AND k > i0 AND k < i1 GROUP BY ALL),
bd AS (SELECT transect_id, part, j, count(*) AS c FROM h WHERE na AND k > i0 AND k < i1 GROUP BY ALL),
ex AS (SELECT transect_id, part, min(CASE WHEN c >= 2 THEN k END) AS xm, max(CASE WHEN c >= 2 THEN k END) AS xn, min(k) AS xa, max(k) AS xb FROM bp GROUP BY ALL),
ey AS (SELECT transect_id, part, min(CASE WHEN c >= 2 THEN j END) AS ym, max(CASE WHEN c >= 2 THEN j END) AS yn, min(j) AS ya, max(j) AS yb FROM bd GROUP BY ALL),
bx AS (SELECT transect_id, part, k, j, v FROM h JOIN ex USING (transect_id, part) JOIN ey USING (transect_id, part)
       WHERE (xm IS NOT NULL OR ym IS NOT NULL) AND k BETWEEN greatest(i0, coalesce(xm, xa) - 4) AND least(i1, coalesce(xn, xb) + 4)
         AND j BETWEEN greatest(0, coalesce(ym, ya) - 3) AND least(63, coalesce(yn, yb) + 5)),
nb AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN k END) OVER (t ROWS UNBOUNDED PRECEDING) AS ka, min(CASE WHEN v IS NOT NULL THEN k END) OVER (t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS kb,
              max(CASE WHEN v IS NOT NULL THEN j END) OVER (d ROWS UNBOUNDED PRECEDING) AS ja, min(CASE WHEN v IS NOT NULL THEN j END) OVER (d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS jb
       FROM bx WINDOW t AS (PARTITION BY transect_id, part, j ORDER BY k), d AS (PARTITION BY transect_id, part, k ORDER BY j)),
fl AS (SELECT n.transect_id, n.part, n.k, n.j, p.v + (q.v - p.v) * (n.k - ka) / (kb - ka) AS ft, r.v + (u.v - r.v) * (n.j - ja) / (jb - ja) AS fd FROM nb n
       LEFT JOIN bx p ON (p.transect_id, p.part, p.k, p.j) = (n.transect_id, n.part, ka, n.j) LEFT JOIN bx q ON (q.transect_id, q.part, q.k, q.j) = (n.transect_id, n.part, kb, n.j)
       LEFT JOIN bx r ON (r.transect_id, r.part, r.k, r.j) = (n.transect_id, n.part, n.k, ja) LEFT JOIN bx u ON (u.transect_id, u.part, u.k, u.j) = (n.transect_id, n.part, n.k, jb) WHERE n.v IS NULL),
full_ AS (SELECT transect_id, k, j, coalesce(v, CASE WHEN ft IS NOT NULL AND fd IS NOT NULL THEN (ft + fd) / 2 ELSE coalesce(ft, fd) END, 0) AS v
          FROM h LEFT JOIN fl USING (transect_id, part, k, j) WHERE k >= a AND k < z),
half AS (SELECT transect_id, k AS ping_index, j // 2 AS j, avg(v) AS v FROM full_ GROUP BY ALL)"""


@query("u1_score_segments", "samp", _SCORED + """,
s AS (SELECT transect_id, ping_index, sum(v) AS total, sum(v * (j + 1)) AS moment FROM half GROUP BY 1, 2)
SELECT transect_id, ping_index, is_upfacing, 0.5::DOUBLE AS depth_step, round(total, 5) AS total_0, round(total * 0.75, 5) AS total_5, round(moment, 4) AS moment_0, round(moment * 0.75, 4) AS moment_5
FROM s JOIN echo USING (transect_id, ping_index)""")
def _(t):
    d = scoring.score(t.echo, _stand_in_model, {"logits": "array<array<double>>"}, height=32)
    row = lambda c: F.get("logits", F.lit(c))
    totals = [F.round(A.array_sum(row(c)), 5).alias(f"total_{c}") for c in (0, 5)]
    # Weighted by depth, so that the order of the cells shows.
    moments = [F.round(A.array_sum(F.transform(row(c), lambda x, j: x * (j + 1))), 4).alias(f"moment_{c}") for c in (0, 5)]
    return d.select(*PK, "is_upfacing", F.round("depth_step", 6).alias("depth_step"), *totals, *moments)


@query("u9_lines")
def _(t):
    s = scoring.score_to_lines(t.echo, _stand_in_model, height=32, columns=(*scoring.NAMES, "is_passive"))
    pts = scoring.line_points(s)
    return pts.select("transect_id", "line", F.round("ts_s", 3).alias("ts_s"), F.round("depth", 6).alias("depth"), "status")


@query("u9_regions")
def _(t):
    s = scoring.score_to_lines(t.echo, _stand_in_model, height=32, autocrop=1, columns=(*scoring.NAMES, *scoring.region_columns()))
    _, rect, con = scoring.lines_and_regions(s, min_patch_area=4, min_passive=0, min_removed=0)
    cols = ["transect_id", "kind", "number", "ts_start", "ts_end", "top", "low"]
    return rect.select(*cols).unionByName(con.select(*cols))


@query(
    "u9_whole_job", "echo",
    """ SELECT transect_id, kind, count(*) AS n_pings, count(*) + CASE WHEN count(*) > 1 THEN 2 ELSE 0 END + 2 AS n_rows, 'process' AS first_run, 'skip' AS second_run
FROM echo CROSS JOIN (SELECT unnest(['turbulence', 'bottom', 'surface']) AS kind) GROUP BY 1, 2""",
)
def _(t):
    # One export per recording, found, read, regridded, smoothed, scored and written; then once more, which must find nothing to do.
    folder, out = scratch(t.spark, "survey"), scratch(t.spark, "job")
    rows = pings.render_pings(t.echo).repartition("transect_id").sortWithinPartitions("transect_id", "seq")
    rows.select("transect_id", "value").write.option("lineSep", "\r\n").partitionBy("transect_id").text(folder)
    options = {"extensions": ("txt",), "autocrop": 1, "smoothing": (1.0, 1.0), "score_options": {"height": 32}, "region_options": {"min_patch_area": 4}}
    recording = F.regexp_extract("path", r"transect_id=(\d+)", 1).cast("long").alias("transect_id")
    first = cut(job.run_job(t.spark, folder, out, _stand_in_model, **options).select(recording, "n_pings", F.col("action").alias("first_run")), "report")
    second = job.run_job(t.spark, folder, out, _stand_in_model, mode="skip", **options).select(recording, F.col("action").alias("second_run"))
    text = t.spark.read.option("recursiveFileLookup", "true").text(f"{out}/outputs").select("value", F.col("_metadata.file_path").alias("file"))
    name = F.try_url_decode(F.try_url_decode("file"))
    written = text.select(F.regexp_extract(name, r"transect_id=(\d+)", 1).cast("long").alias("transect_id"), F.regexp_extract(name, r"\.(\w+)\.evl/", 1).alias("kind"))
    written = written.where("kind <> ''").groupBy("transect_id", "kind").agg(F.count("*").alias("n_rows"))
    return written.join(first, "transect_id").join(second, "transect_id")


def _decomposed(t):
    raw = t.echo.drop("embedding")
    msk = t.masked.withColumn("sv", F.transform("mask", lambda k: F.when(k, F.lit(-60.0))))
    return decompose.decompose(raw, msk, t.line_points)


@query("u7_decompose")
def _(t):
    d = _decomposed(t)
    n = lambda c: F.size(F.filter(c, lambda x: x)).alias(f"n_{c}")
    return d.select(
        *PK, "is_passive", "is_removed", "is_upfacing", "is_surrogate", *[F.round(c, 6).alias(c) for c in ("surface", "turbulence", "bottom", "turbulence_original", "bottom_original")],
        n("mask"), n("mask_patches"), n("mask_patches_original"), n("mask_patches_ntob"),
    )


@query("u10_evaluate")
def _(t):
    d = cut(_decomposed(t), "decomposed")
    s = evaluate.evaluate(d, _stand_in_model, max_depth=25)
    return s.select("transect_id", "is_upfacing", "channel", "n", *[F.round(c, 7).alias(c) for c in ("accuracy", "precision", "recall", "f1", "jaccard")])


@query("regions_to_masks", "series", """,
o AS (SELECT *, ping_index - row_number() OVER (PARTITION BY transect_id ORDER BY ping_index) AS g FROM series WHERE is_passive)
SELECT transect_id, ping_index, is_passive, is_removed FROM series""")
def _(t):
    from ..operators import runs

    s = t.series.withColumn("sv", F.array("signal"))
    r = runs.flag_regions(s, "is_passive", "passive").unionByName(runs.flag_regions(s, "is_removed", "removed"))
    return patches.regions_to_masks(s, r).select(*PK, "is_passive", "is_removed")


