"""Grids, normalisation, scalar functions, statistics over recordings."""

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text
from ..operators import grid, segments, stats
from .registry import query

PK = ["transect_id", "ping_index"]
KEY = ["transect_id"]


def _ragged(t):
    """Pings that lose up to two samples at the end while keeping their declared extent."""
    return t.echo.withColumn("sv", F.slice("sv", F.lit(1), F.lit(64) - (F.col("vec_id") % 3).cast("int")))


# Length 64-vec_id%3; the grid takes the usual length and the usual extent (all share one).
_S2 = """,
rg AS (SELECT transect_id, ping_index, is_upfacing, CAST(64 - vec_id % 3 AS BIGINT) AS len, j, v FROM samp WHERE j < 64 - vec_id % 3),
ct AS (SELECT transect_id, len, count(DISTINCT ping_index) AS c FROM rg GROUP BY 1, 2),
us AS (SELECT transect_id, len AS n FROM ct QUALIFY row_number() OVER (PARTITION BY transect_id ORDER BY c DESC, len) = 1),
-- positions counted from the shallow end
up AS (SELECT transect_id, ping_index, len, is_upfacing, CASE WHEN is_upfacing THEN len - 1 - j ELSE j END AS p, v FROM rg),
nb AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN p END) OVER (PARTITION BY transect_id, ping_index ORDER BY p) AS p0,
              min(CASE WHEN v IS NOT NULL THEN p END) OVER (PARTITION BY transect_id, ping_index ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p1 FROM up),
tg AS (SELECT u.transect_id, u.n, e.ping_index, e.is_upfacing, unnest(range(0, u.n)) AS i FROM us u JOIN echo e USING (transect_id)),
tx AS (SELECT tg.*, 64 - e.vec_id % 3 AS len, (CASE WHEN tg.is_upfacing THEN tg.n - 1 - i ELSE i END) * (64 - e.vec_id % 3 - 1) / (tg.n - 1)::DOUBLE AS x0 FROM tg JOIN echo e USING (transect_id, ping_index)),
ty AS (SELECT *, CASE WHEN abs(x0 - round(x0)) < 1e-9 THEN round(x0) ELSE x0 END AS x FROM tx),
tz AS (SELECT ty.transect_id, ty.ping_index, ty.i, ty.x, ty.n, a.p0, b.p1, (a.v IS NULL)::INT + ((b.v IS NULL)::INT - (a.v IS NULL)::INT) * (ty.x - floor(ty.x)) AS miss
       FROM ty JOIN nb a ON a.transect_id = ty.transect_id AND a.ping_index = ty.ping_index AND a.p = floor(ty.x)
               JOIN nb b ON b.transect_id = ty.transect_id AND b.ping_index = ty.ping_index AND b.p = ceil(ty.x)),
rs AS (SELECT tz.transect_id, tz.ping_index, tz.i, CASE WHEN miss <= 0.3 AND tz.p0 IS NOT NULL AND tz.p1 IS NOT NULL THEN CASE WHEN tz.p0 = tz.p1 THEN c.v ELSE c.v + (d.v - c.v) * (x - tz.p0) / (tz.p1 - tz.p0) END END AS y
       FROM tz LEFT JOIN nb c ON c.transect_id = tz.transect_id AND c.ping_index = tz.ping_index AND c.p = tz.p0
               LEFT JOIN nb d ON d.transect_id = tz.transect_id AND d.ping_index = tz.ping_index AND d.p = tz.p1)"""


@query("s2_regrid_mode", "samp", _S2 + " SELECT transect_id, ping_index, CAST(i AS INT) AS j, round(y, 6) AS v FROM rs")
def _(t):
    d = grid.regrid(_ragged(t), "mode")
    return d.select(*PK, F.posexplode("sv").alias("j", "v")).withColumn("v", F.round("v", 6))


_LEN = ", l AS (SELECT transect_id, ping_index, CAST(64 - (vec_id * 5) % 7 AS INT) AS len FROM echo)"
for _how, _expr in (
    ("init", "arg_min(len, ping_index)"),
    ("min", "min(len)"),
    ("max", "max(len)"),
    ("mode", "(SELECT x.len FROM (SELECT len, count(*) c FROM l y WHERE y.transect_id = l.transect_id GROUP BY len) x ORDER BY c DESC, len LIMIT 1)"),
):

    @query(f"s2_row_length_{_how}", "echo", _LEN + f" SELECT transect_id, CAST({_expr} AS INT) AS n_depth FROM l GROUP BY transect_id")
    def _(t, how=_how):
        d = t.echo.withColumn("sv", F.slice("sv", F.lit(1), F.lit(64) - ((F.col("vec_id") * 5) % 7).cast("int")))
        return grid.row_length(d, how).select("transect_id", F.col("n_depth").cast("int").alias("n_depth"))


@query(
    "s2_row_length_median", "echo",
    _LEN + """,
m AS (SELECT transect_id, quantile_cont(len, 0.5) AS m1, list(DISTINCT len) AS seen, max(ping_index) AS last FROM l GROUP BY 1),
r AS (SELECT transect_id, quantile_cont(len, 0.5) AS m2 FROM l JOIN m USING (transect_id) WHERE ping_index < last GROUP BY 1)
SELECT transect_id, CAST(CASE WHEN list_contains(seen, m1) THEN m1 WHEN list_contains(seen, round_even(m1, 0)) THEN round_even(m1, 0) ELSE m2 END AS INT) AS n_depth FROM m JOIN r USING (transect_id)""",
)
def _(t):
    d = t.echo.withColumn("sv", F.slice("sv", F.lit(1), F.lit(64) - ((F.col("vec_id") * 5) % 7).cast("int")))
    return grid.row_length(d, "median")


@query("p1_missing_markers", "samp", " SELECT transect_id, ping_index, CAST(j AS INT) AS j, round(v, 6) AS v FROM samp")
def _(t):
    marked = t.echo.withColumn("sv", F.transform("sv", lambda x: F.coalesce(x, F.lit(-9.9e37))))
    return marked.select(*PK, F.posexplode(A.sentinel_to_null("sv")).alias("j", "v")).withColumn("v", F.round("v", 6))


@query(
    "p2_face_down", "samp",
    " SELECT transect_id, ping_index, is_upfacing, CAST(CASE WHEN is_upfacing THEN 63 - j ELSE j END AS INT) AS j, round(v, 6) AS v, FALSE AS facing_mismatch FROM samp",
)
def _(t):
    d = grid.face_down(t.echo)
    return d.select(*PK, "is_upfacing", "facing_mismatch", F.posexplode("sv").alias("j", "v")).withColumn("v", F.round("v", 6))


@query(
    "p2_face_down_forced_up", "echo",
    " SELECT transect_id, ping_index, TRUE AS is_upfacing, NOT is_upfacing AS facing_mismatch, CASE WHEN is_upfacing THEN 0.25 ELSE 31.75 END::DOUBLE AS depth_start FROM echo",
)
def _(t):
    return grid.face_down(t.echo, "upward").select(*PK, "is_upfacing", "facing_mismatch", "depth_start")


@query("p3_crop_depth", "samp", " SELECT transect_id, ping_index, round(depth, 6) AS depth, round(v, 6) AS v FROM samp WHERE depth BETWEEN 5 AND 20.25")
def _(t):
    d = grid.crop_depth(t.echo, 5, 20.25)
    z = F.explode(F.arrays_zip("sv", A.depth_grid("sv").alias("depth")))
    return d.withColumn("_z", z).select(*PK, F.round("_z.depth", 6).alias("depth"), F.round("_z.sv", 6).alias("v"))


@query("p4_masked_signal", "samp", " SELECT transect_id, ping_index, CAST(j AS INT) AS j, round(CASE WHEN keep THEN v END, 6) AS v FROM cell")
def _(t):
    return t.masked.select(*PK, F.posexplode(A.keep_where("sv", "mask")).alias("j", "v")).withColumn("v", F.round("v", 6))


@query("p5_replace_missing", "samp", " SELECT transect_id, ping_index, round(sum(coalesce(v, -99.0)), 5) AS total FROM samp GROUP BY 1, 2")
def _(t):
    return t.echo.select(*PK, F.round(A.array_sum(A.fill_missing("sv", -99.0)), 5).alias("total"))


_C = {"mean": "avg(v)", "median": "quantile_cont(v, 0.5)", "pc10": "quantile_cont(v, 0.1)"}
_D = {
    "stdev": "stddev_pop(v)",
    "mad": None,
    "iqr": "(quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.35",
    "idr": "(quantile_cont(v, 0.9) - quantile_cont(v, 0.1)) / 2.56",
    "i7r": "(quantile_cont(v, 0.93) - quantile_cont(v, 0.07)) / 3.0",
}
for _c, _ce in _C.items():
    for _d, _de in _D.items():
        if _de is None:
            _pre = """,
med AS (SELECT transect_id, quantile_cont(v, 0.5) AS m FROM samp GROUP BY 1),
mad AS (SELECT transect_id, quantile_cont(abs(v - m), 0.5) * 1.4826 AS s FROM samp JOIN med USING (transect_id) GROUP BY 1)"""
            _st = f", st AS (SELECT transect_id, {_ce} AS c, any_value(s) AS s FROM samp JOIN mad USING (transect_id) GROUP BY 1)"
        else:
            _pre, _st = "", f", st AS (SELECT transect_id, {_ce} AS c, {_de} AS s FROM samp GROUP BY 1)"

        @query(
            f"a2_normalise_{_c}_{_d}", "samp",
            _pre + _st + " SELECT transect_id, ping_index, CAST(j AS INT) AS j, round((v - c) / s, 6) AS v FROM samp JOIN st USING (transect_id)",
        )
        def _(t, c=_c, d=_d):
            return grid.normalise(t.echo, c, d).select(*PK, F.posexplode("sv").alias("j", "v")).withColumn("v", F.round("v", 6))


@query("n1_linspace", "samp", " SELECT transect_id, ping_index, CAST(j AS INT) AS j, round(depth, 9) AS depth FROM samp")
def _(t):
    return t.echo.select(*PK, F.posexplode(A.depth_grid("sv")).alias("j", "depth")).withColumn("depth", F.round("depth", 9))


@query("n2_sigmoid", "samp", " SELECT transect_id, ping_index, count(*) FILTER (WHERE 1 / (1 + exp(-logit)) > 0.5) AS n_over, round(sum(1 / (1 + exp(-logit))), 6) AS total FROM samp GROUP BY 1, 2")
def _(t):
    p = F.transform("logit", A.sigmoid)
    return t.logits.select(*PK, F.size(F.filter(p, lambda x: x > 0.5)).cast("long").alias("n_over"), F.round(A.array_sum(p), 6).alias("total"))


@query("n3_clip", "series", " SELECT transect_id, ping_index, least(greatest(signal, 5.0::DOUBLE), 20.0::DOUBLE) AS signal FROM series")
def _(t):
    return t.series.select(*PK, A.clip("signal", 5.0, 20.0).alias("signal"))


@query(
    "n5_interp_keep_missing", "samp",
    """,
nb AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN j END) OVER (PARTITION BY transect_id, ping_index ORDER BY j) AS p0,
              min(CASE WHEN v IS NOT NULL THEN j END) OVER (PARTITION BY transect_id, ping_index ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p1 FROM samp),
tg AS (SELECT transect_id, ping_index, i, i * 63 / 40.0::DOUBLE AS x FROM echo, (SELECT unnest(range(0, 41)) AS i)),
tz AS (SELECT t.*, a.p0, b.p1, (a.v IS NULL)::INT + ((b.v IS NULL)::INT - (a.v IS NULL)::INT) * (x - floor(x)) AS miss
       FROM tg t JOIN nb a ON a.transect_id = t.transect_id AND a.ping_index = t.ping_index AND a.j = floor(x) JOIN nb b ON b.transect_id = t.transect_id AND b.ping_index = t.ping_index AND b.j = ceil(x))
SELECT z.transect_id, z.ping_index, CAST(i AS INT) AS j, round(CASE WHEN miss <= 0.0 AND z.p0 IS NOT NULL AND z.p1 IS NOT NULL THEN CASE WHEN z.p0 = z.p1 THEN c.v ELSE c.v + (d.v - c.v) * (x - z.p0) / (z.p1 - z.p0) END END, 6) AS v
FROM tz z LEFT JOIN nb c ON c.transect_id = z.transect_id AND c.ping_index = z.ping_index AND c.j = z.p0 LEFT JOIN nb d ON d.transect_id = z.transect_id AND d.ping_index = z.ping_index AND d.j = z.p1""",
)
def _(t):
    # In cells, so that a position does not depend on the direction of depth.
    y = A.regrid_keep_missing("sv", F.lit(0.0), F.lit(63.0), F.lit(0.0), F.lit(63.0), F.lit(41), 0.0)
    return t.echo.select(*PK, F.posexplode(y).alias("j", "v")).withColumn("v", F.round("v", 6))


for _m in (32, 100):

    @query(
        f"n6_resize_{_m}", "samp",
        f""",
tg AS (SELECT transect_id, ping_index, i, greatest(0.0::DOUBLE, least(63.0::DOUBLE, (i + 0.5::DOUBLE) * 64 / {_m} - 0.5::DOUBLE)) AS x FROM echo, (SELECT unnest(range(0, {_m})) AS i))
SELECT t.transect_id, t.ping_index, CAST(i AS INT) AS j, round(a.logit + (b.logit - a.logit) * (x - least(floor(x), 62)), 6) AS v
FROM tg t JOIN samp a ON a.transect_id = t.transect_id AND a.ping_index = t.ping_index AND a.j = least(floor(x), 62)
JOIN samp b ON b.transect_id = t.transect_id AND b.ping_index = t.ping_index AND b.j = least(floor(x), 62) + 1""",
    )
    def _(t, m=_m):
        return grid.resize(t.logits, m, 1, ["logit"]).select(*PK, F.posexplode("logit").alias("j", "v")).withColumn("v", F.round("v", 6))


@query(
    "n6_resize_nearest", "samp",
    """,
tg AS (SELECT transect_id, ping_index, i, least(63, floor((i + 0.5::DOUBLE) * 64 / 24)) AS s FROM echo, (SELECT unnest(range(0, 24)) AS i))
SELECT t.transect_id, t.ping_index, CAST(i AS INT) AS j, round(logit, 6) AS v FROM tg t JOIN samp a ON a.transect_id = t.transect_id AND a.ping_index = t.ping_index AND a.j = s""",
)
def _(t):
    return grid.resize(t.logits, 24, 0, ["logit"]).select(*PK, F.posexplode("logit").alias("j", "v")).withColumn("v", F.round("v", 6))


_W22 = """,
h AS (SELECT *, v IS NULL AS na, max(ping_index) OVER (PARTITION BY transect_id) AS i1 FROM samp),
bp AS (SELECT transect_id, ping_index, count(*) AS c FROM h WHERE na AND ping_index BETWEEN 1 AND i1 - 1 GROUP BY 1, 2),
bd AS (SELECT transect_id, j, count(*) AS c FROM h WHERE na AND ping_index BETWEEN 1 AND i1 - 1 GROUP BY 1, 2),
ex AS (SELECT transect_id, min(CASE WHEN c >= 2 THEN ping_index END) AS xm, max(CASE WHEN c >= 2 THEN ping_index END) AS xn, min(ping_index) AS xa, max(ping_index) AS xb FROM bp GROUP BY 1),
ey AS (SELECT transect_id, min(CASE WHEN c >= 2 THEN j END) AS ym, max(CASE WHEN c >= 2 THEN j END) AS yn, min(j) AS ya, max(j) AS yb FROM bd GROUP BY 1),
bx AS (SELECT h.transect_id, h.ping_index, h.j, h.v FROM h JOIN ex USING (transect_id) JOIN ey USING (transect_id)
       WHERE (xm IS NOT NULL OR ym IS NOT NULL) AND ping_index BETWEEN greatest(0, coalesce(xm, xa) - 4) AND least(i1, coalesce(xn, xb) + 4)
         AND j BETWEEN greatest(0, coalesce(ym, ya) + 1 - 4) AND least(63, coalesce(yn, yb) + 1 + 4)),
nb AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN ping_index END) OVER (PARTITION BY transect_id, j ORDER BY ping_index) AS a,
              min(CASE WHEN v IS NOT NULL THEN ping_index END) OVER (PARTITION BY transect_id, j ORDER BY ping_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b,
              max(CASE WHEN v IS NOT NULL THEN j END) OVER (PARTITION BY transect_id, ping_index ORDER BY j) AS c,
              min(CASE WHEN v IS NOT NULL THEN j END) OVER (PARTITION BY transect_id, ping_index ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS d FROM bx),
fl AS (SELECT n.transect_id, n.ping_index, n.j, p.v + (q.v - p.v) * (n.ping_index - a) / (b - a) AS ft, r.v + (s.v - r.v) * (n.j - c) / (d - c) AS fd FROM nb n
       LEFT JOIN bx p ON p.transect_id = n.transect_id AND p.j = n.j AND p.ping_index = a LEFT JOIN bx q ON q.transect_id = n.transect_id AND q.j = n.j AND q.ping_index = b
       LEFT JOIN bx r ON r.transect_id = n.transect_id AND r.ping_index = n.ping_index AND r.j = c LEFT JOIN bx s ON s.transect_id = n.transect_id AND s.ping_index = n.ping_index AND s.j = d
       WHERE n.v IS NULL)
SELECT transect_id, ping_index, CAST(j AS INT) AS j, round(coalesce(v, CASE WHEN ft IS NOT NULL AND fd IS NOT NULL THEN (ft + fd) / 2 ELSE coalesce(ft, fd) END), 6) AS v
FROM samp LEFT JOIN fl USING (transect_id, ping_index, j)"""


@query("w22_fill_holes", "samp", _W22)
def _(t):
    return grid.fill_holes(t.echo).select(*PK, F.posexplode("sv").alias("j", "v")).withColumn("v", F.round("v", 6))


@query(
    "a1_mode", "series",
    """, c AS (SELECT transect_id, CAST(signal / 10 AS INT) AS bin, count(*) AS n FROM series GROUP BY 1, 2)
SELECT transect_id, bin AS mode_bin FROM c QUALIFY row_number() OVER (PARTITION BY transect_id ORDER BY n DESC, bin) = 1""",
)
def _(t):
    d = t.series.withColumn("bin", F.bround(F.col("signal") / 10).cast("int"))
    return grid.grouped_mode(d, KEY, "bin", "mode_bin")


_SEGS = """,
steps AS (SELECT *, ts_s - lag(ts_s) OVER (PARTITION BY transect_id ORDER BY ping_index) AS dt FROM echo),
base AS (SELECT transect_id, quantile_cont(dt, 0.975) AS q FROM steps GROUP BY 1),
seg AS (SELECT s.transect_id, ping_index, CAST(sum(CASE WHEN dt > q * 20 THEN 1 ELSE 0 END) OVER (PARTITION BY s.transect_id ORDER BY ping_index) AS BIGINT) AS segment_id
        FROM steps s JOIN base USING (transect_id)),
fp AS (SELECT *, row_number() OVER (PARTITION BY transect_id, segment_id ORDER BY ping_index) AS rn, count(*) OVER (PARTITION BY transect_id, segment_id) AS cnt FROM seg),
c AS (SELECT s.transect_id, segment_id, v FROM samp s JOIN fp USING (transect_id, ping_index) WHERE rn > 1 AND cnt > 2 AND depth <= 25)"""
_QS = stats.PERCENTILES
_A15 = _SEGS + """,
s1 AS (SELECT transect_id, segment_id, avg(v) AS mean, stddev_pop(v) AS stdev, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.25) AS p25, {qs} FROM c GROUP BY 1, 2),
s2 AS (SELECT transect_id, segment_id, quantile_cont(abs(v - median), 0.5) AS mad, sqrt(avg((v - p25) ** 2)) AS std25 FROM c JOIN s1 USING (transect_id, segment_id) GROUP BY 1, 2)"""
_A15 = _A15.format(qs=", ".join(f"quantile_cont(v, {q / 100}) AS q{i}" for i, q in enumerate(_QS)))


@query(
    "a15_segment_statistics", "samp",
    _A15 + " SELECT transect_id, segment_id, round(mean, 6) AS mean, round(stdev, 6) AS stdev, round(median, 6) AS median, round(mad, 6) AS mad, round(std25, 6) AS std25, "
    + ", ".join(f"round(q{i}, 6) AS q{i}" for i in range(len(_QS))) + " FROM s1 JOIN s2 USING (transect_id, segment_id)",
)
def _(t):
    s = stats.segment_statistics(segments.split_gaps(t.echo), max_depth=25)
    return s.select(
        "transect_id", "segment_id", *[F.round(c, 6).alias(c) for c in ("mean", "stdev", "median", "mad", "std25")],
        *[F.round(F.get("percentiles", F.lit(i)), 6).alias(f"q{i}") for i in range(len(_QS))],
    )


_EST = {"mean": "mean", "median": "median", "stdev": "stdev", "mad": "mad", "iqr": f"q{_QS.index(75)} - q{_QS.index(25)}",
        "idr": f"q{_QS.index(90)} - q{_QS.index(10)}", "i7r": f"q{_QS.index(93)} - q{_QS.index(7)}", "std25": "std25"}


@query(
    "a15_dataset_statistics", "samp",
    _A15 + ", e AS (" + " UNION ALL ".join(f"SELECT '{k}' AS name, {v} AS x FROM s1 JOIN s2 USING (transect_id, segment_id)" for k, v in _EST.items()) + """)
SELECT name, round(avg(x), 6) AS mean, round(min(x), 6) AS low, round(max(x), 6) AS high, round(stddev_samp(x) / sqrt(count(x)), 6) AS sem,
       round(stddev_samp(x) / sqrt(count(x)) / abs(avg(x)) * 100, 6) AS pc_error FROM e GROUP BY 1
UNION ALL SELECT 'variance', round(avg(vr), 6), round(min(vr), 6), round(max(vr), 6), round(stddev_samp(vr) / sqrt(count(vr)), 6), round(stddev_samp(vr) / sqrt(count(vr)) / abs(avg(vr)) * 100, 6)
FROM (SELECT transect_id, segment_id, avg((v - (SELECT avg(mean) FROM s1)) ** 2) AS vr FROM c GROUP BY 1, 2)""",
)
def _(t):
    r = stats.dataset_statistics(segments.split_gaps(t.echo), max_depth=25)
    return r.select("name", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high", "sem", "pc_error")])


@query(
    "a18_echo_integration", "samp",
    """,
z AS (SELECT *, min(ts_s) OVER (PARTITION BY transect_id) AS t0, bottom - depth AS h FROM samp)
SELECT transect_id, CAST(floor((ts_s - t0) / 6) AS BIGINT) AS time_bin, CAST(floor(h / 1.0) AS BIGINT) AS depth_bin, count(v) AS n_samples, round(min(v), 6) AS sv_min, round(max(v), 6) AS sv_max,
       round(10 * log10(avg(pow(10, v / 10))), 6) AS sv_mean
FROM z WHERE depth > turbulence AND depth < bottom AND NOT is_passive AND ping_index % 23 NOT IN (5, 6, 7) AND v IS NOT NULL GROUP BY 1, 2, 3""",
)
def _(t):
    d = t.masked.withColumn("is_bad", F.col("is_passive") | (F.col("ping_index") % 23).isin(5, 6, 7))
    r = stats.echo_integration(d, minutes=0.1, metres=1.0, reference="bottom", above="turbulence", below="bottom", bad="is_bad")
    return r.select("transect_id", "time_bin", "depth_bin", "n_samples", *[F.round(c, 6).alias(c) for c in ("sv_min", "sv_max", "sv_mean")])


@query(
    "a21_percentile_scan", "samp",
    """,
w AS (SELECT transect_id, ping_index, v FROM samp WHERE j >= 34),
p AS (SELECT transect_id, unnest(range(0, 100)) AS pc, unnest(quantile_cont(v, [x / 100.0 for x in range(0, 100)])) AS cut FROM w GROUP BY 1),
m AS (SELECT transect_id, ping_index, max(v) AS top FROM w GROUP BY 1, 2)
SELECT p.transect_id, CAST(pc AS INT) AS pc, round(cut, 6) AS cut, count(*) FILTER (WHERE top IS NULL OR NOT top > cut) AS n_pings FROM p JOIN m USING (transect_id) GROUP BY ALL""",
)
def _(t):
    r = stats.percentile_scan(t.echo, first_cell=34)
    return r.select("transect_id", "pc", F.round("cut", 6).alias("cut"), "n_pings")


@query(
    "s7_datetime_text", "series",
    """,
u AS (SELECT transect_id, ping_index, CAST(round_even(ts_s * 1e4, 0) AS BIGINT) AS t FROM series)
SELECT transect_id, ping_index, strftime(make_timestamp(CAST(t // 10000 AS BIGINT) * 1000000), '%Y%m%d %H%M%S') || lpad(CAST(t % 10000 AS VARCHAR), 4, '0') AS stamp, round(t / 1e4, 4) AS back FROM u""",
)
def _(t):
    s = text.stamp("ts_s")
    return t.series.select(*PK, s.alias("stamp"), F.round(text.parse_stamp(s), 4).alias("back"))


@query(
    "s8_ping_time", "series",
    " SELECT transect_id, ping_index, round(floor(ts_s) + floor(1000 * (ping_index % 1000 + 0.25::DOUBLE)) / 1e6, 6) AS ts_s FROM series",
)
def _(t):
    d = t.series.select(*PK, F.timestamp_seconds(F.floor("ts_s")).alias("_t"), ((F.col("ping_index") % 1000) + 0.25).alias("ms"))
    d = d.withColumns({"d": F.date_format("_t", "yyyy-MM-dd"), "h": F.date_format("_t", "HH:mm:ss")})
    return d.select(*PK, F.round(text.ping_time("d", "h", "ms"), 6).alias("ts_s"))
