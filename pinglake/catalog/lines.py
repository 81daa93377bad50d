"""Joins of lines and regions to pings, line operators, masks and label cleaning."""

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import asof, grid, lines, masks, passive
from ..plans import dataset
from .registry import query

PK = ["transect_id", "ping_index"]
KEY = ["transect_id"]


def interp_sql(targets: str, points: str, y: str, x: str = "ts_s", out: str = "y", extra: str = "") -> str:
    """SQL of a two-sided as-of interpolation: neighbours by window over the union."""
    return f"""
u AS (SELECT transect_id, {x} AS x, NULL::DOUBLE AS py, ping_index, TRUE AS t FROM {targets}
      UNION ALL SELECT transect_id, {x}, {y}::DOUBLE, NULL, FALSE FROM {points} WHERE {y} IS NOT NULL),
nb AS (SELECT *, max(CASE WHEN py IS NOT NULL THEN x END) OVER lo AS x0, min(CASE WHEN py IS NOT NULL THEN x END) OVER hi AS x1,
              arg_max(py, CASE WHEN py IS NOT NULL THEN x END) FILTER (WHERE py IS NOT NULL) OVER lo AS y0,
              arg_min(py, CASE WHEN py IS NOT NULL THEN x END) FILTER (WHERE py IS NOT NULL) OVER hi AS y1 FROM u
       WINDOW lo AS (PARTITION BY transect_id ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
              hi AS (PARTITION BY transect_id ORDER BY x RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
interp AS (SELECT transect_id, ping_index, CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 WHEN x1 <= x0 THEN y0
                       ELSE y0 + (y1 - y0) / (x1 - x0) * (x - x0) END AS {out} FROM nb WHERE t)"""


@query("j1_line_onto_pings", "points", "," + interp_sql("echo", "points", "turbulence") + " SELECT transect_id, ping_index, round(y, 6) AS depth FROM interp")
def _(t):
    d = asof.interpolate_onto(t.echo.select(*PK, "ts_s"), t.line_points, KEY, "ts_s", ["turbulence"])
    return d.select(*PK, F.round("turbulence", 6).alias("depth"))


@query(
    "j1_orders_onto_events",
    "series",
    ", order_lines AS (SELECT o_custkey AS transect_id, epoch_us(o_orderdate) / 1e6 AS ts_s, min(o_totalprice / 10000) AS depth FROM orders GROUP BY ALL),"
    + interp_sql("series", "order_lines", "depth")
    + " SELECT transect_id, ping_index, round(y, 6) AS depth FROM interp",
)
def _(t):
    d = asof.interpolate_onto(t.series.select(*PK, "ts_s"), t.order_lines, KEY, "ts_s", ["depth"])
    return d.select(*PK, F.round("depth", 6).alias("depth"))


@query(
    "j2_time_regions",
    "series",
    """,
r AS (SELECT transect_id, ts_s AS a, ts_s + 30000.0::DOUBLE AS b FROM series WHERE is_removed)
SELECT transect_id, ping_index, EXISTS (SELECT 1 FROM r WHERE r.transect_id = s.transect_id AND s.ts_s BETWEEN r.a AND r.b) AS inside FROM series s""",
)
def _(t):
    r = t.series.where("is_removed").select("transect_id", F.col("ts_s").alias("a"), (F.col("ts_s") + 30000.0).alias("b"))
    return asof.flag_in_intervals(t.series, r, KEY, "ts_s", "a", "b", "inside").select(*PK, "inside")


@query(
    "j3_nearest_cell",
    "points",
    """,
p AS (SELECT transect_id, ping_index AS pt, ts_s + 0.75::DOUBLE AS x FROM points),
n AS (SELECT transect_id, max(ping_index) + 1 AS n FROM echo GROUP BY 1)
SELECT p.transect_id, pt, coalesce(min(e.ping_index), any_value(n.n)) AS cell
FROM p JOIN n USING (transect_id) LEFT JOIN echo e ON e.transect_id = p.transect_id AND e.ts_s + 0.5::DOUBLE >= p.x GROUP BY ALL""",
)
def _(t):
    p = t.line_points.select("transect_id", F.col("ping_index").alias("pt"), (F.col("ts_s") + 0.75).alias("x"))
    g = t.echo.select(*PK, "ts_s", F.lit(0.5).alias("half"))
    return asof.nearest_cell(p, g, KEY, "x", "ts_s", "ping_index", "cell", "half").select("transect_id", "pt", "cell")


@query(
    "j4_index_ranges",
    "echo",
    """,
r AS (SELECT transect_id, ping_index AS a, ping_index + vec_id % 5 AS b FROM echo WHERE ping_index % 10 = 3)
SELECT transect_id, ping_index, EXISTS (SELECT 1 FROM r WHERE r.transect_id = s.transect_id AND s.ping_index >= a AND s.ping_index < b) AS inside FROM echo s""",
)
def _(t):
    r = t.echo.where("ping_index % 10 = 3").select("transect_id", F.col("ping_index").alias("start"), (F.col("ping_index") + F.col("vec_id") % 5).alias("end"))
    return passive.flag_ranges(t.echo.select(*PK), r, "inside")


_PATH = """CASE transect_id % 6 WHEN 0 THEN 'MinasPassage/march2018/x' WHEN 1 THEN 'MinasPassage/December2017/x'
  WHEN 2 THEN 'MinasPassage/september2018/x' WHEN 3 THEN 'GrandPassage/phase1/x'
  WHEN 4 THEN 'GrandPassage/phase2/WBAT_2B_20200128_UTC180017_ebblow' ELSE 'mobile/x' END"""


@query(
    "j5_passive_schedule",
    "series",
    """,
k AS (SELECT *, transect_id % 6 AS m FROM series)
SELECT transect_id, ping_index, CASE m WHEN 1 THEN 'none' WHEN 5 THEN 'find' ELSE 'schedule' END AS schedule,
       CASE m WHEN 0 THEN ping_index % 360 < 60 WHEN 1 THEN FALSE WHEN 2 THEN ping_index >= 300 AND (ping_index - 300) % 360 < 60
              WHEN 3 THEN (ping_index + 200) % 3420 < 420 WHEN 4 THEN (ping_index + 200) % 3420 < 420 END AS is_passive FROM k""",
)
def _(t):
    d = t.series.select(*PK).withColumn("path", F.expr(_PATH))
    return passive.schedule_flags(d).select(*PK, "schedule", "is_passive")


@query(
    "j8_grids_match",
    "echo",
    """,
b AS (SELECT transect_id, ping_index, ts_s + CASE WHEN transect_id % 3 = 0 AND ping_index = 7 THEN 1e6 ELSE 0 END AS ts_s
      FROM echo WHERE NOT (transect_id = 4 AND ping_index > 20))
SELECT coalesce(a.transect_id, b.transect_id) AS transect_id, count(a.ping_index) AS n_left, count(b.ping_index) AS n_right,
       bool_and(a.ping_index IS NOT NULL AND b.ping_index IS NOT NULL AND coalesce(abs(a.ts_s - b.ts_s) <= 1e-8 + 1e-5 * abs(b.ts_s), FALSE)) AS same_grid
FROM echo a FULL JOIN b ON a.transect_id = b.transect_id AND a.ping_index = b.ping_index GROUP BY 1""",
)
def _(t):
    b = t.echo.withColumn("ts_s", F.col("ts_s") + F.when((F.col("transect_id") % 3 == 0) & (F.col("ping_index") == 7), 1e6).otherwise(0.0))
    b = b.where("not (transect_id = 4 and ping_index > 20)")
    return asof.grids_match(t.echo, b, KEY, "ping_index", ["ts_s"])


@query(
    "j9_mask_resample",
    "samp",
    """,
m AS (SELECT s.transect_id, s.ping_index, s.j, turbulence < depth AND depth < bottom AS keep FROM samp s WHERE ping_index % 2 = 0),
tm AS (SELECT transect_id, ping_index, ts_s FROM echo WHERE ping_index % 2 = 0),
tg AS (SELECT e.transect_id, e.ping_index, e.ts_s, max(tm.ping_index) AS lo FROM echo e JOIN tm ON tm.transect_id = e.transect_id AND tm.ts_s <= e.ts_s GROUP BY ALL),
hi AS (SELECT e.transect_id, e.ping_index, min(tm.ping_index) AS hi FROM echo e JOIN tm ON tm.transect_id = e.transect_id AND tm.ts_s >= e.ts_s GROUP BY ALL),
w AS (SELECT tg.*, coalesce(hi.hi, tg.lo) AS hi FROM tg LEFT JOIN hi USING (transect_id, ping_index)),
f AS (SELECT w.transect_id, w.ping_index, CASE WHEN a.ts_s = b.ts_s THEN 0 ELSE (w.ts_s - a.ts_s) / (b.ts_s - a.ts_s) END AS t, w.lo, w.hi
      FROM w JOIN tm a ON a.transect_id = w.transect_id AND a.ping_index = w.lo JOIN tm b ON b.transect_id = w.transect_id AND b.ping_index = w.hi),
v AS (SELECT f.transect_id, f.ping_index, a.j, a.keep::INT + (b.keep::INT - a.keep::INT) * f.t AS p
      FROM f JOIN m a ON a.transect_id = f.transect_id AND a.ping_index = f.lo JOIN m b ON b.transect_id = f.transect_id AND b.ping_index = f.hi AND b.j = a.j),
g AS (SELECT transect_id, ping_index, o.i, o.i * 63.0::DOUBLE / 31 AS x, floor(o.i * 63.0::DOUBLE / 31) AS l FROM echo, (SELECT unnest(range(0, 32)) AS i) o)
SELECT g.transect_id, g.ping_index, CAST(g.i AS INT) AS j, a.p + (b.p - a.p) * (g.x - g.l) > 0.5 AS keep
FROM g JOIN v a ON a.transect_id = g.transect_id AND a.ping_index = g.ping_index AND a.j = g.l
       JOIN v b ON b.transect_id = g.transect_id AND b.ping_index = g.ping_index AND b.j = least(g.l + 1, 63)""",
)
def _(t):
    m = t.lined.where("ping_index % 2 = 0").withColumn(
        "mask", F.zip_with(A.depth_grid("sv"), "sv", lambda d, _: (d > F.col("turbulence")) & (d < F.col("bottom")))
    )
    target = t.echo.select(*PK, "ts_s", F.col("depth_start").alias("grid_start"), F.col("depth_stop").alias("grid_stop"), F.lit(32).alias("grid_n"))
    d = masks_onto_grid(m, target)
    return d.select(*PK, F.posexplode("mask").alias("j", "keep"))


def masks_onto_grid(m, target):
    from ..operators.patches import mask_onto_grid

    return mask_onto_grid(m, target)


@query(
    "j10_tidy_lines",
    "points",
    "," + interp_sql("echo", "points", "surface")
    + " SELECT i.transect_id, i.ping_index, round(CASE WHEN e.is_passive THEN NULL ELSE y END, 6) AS surface FROM interp i JOIN echo e USING (transect_id, ping_index)",
)
def _(t):
    pts = t.line_points.withColumn("surface", F.coalesce("surface", F.lit(lines.UNDEFINED_DEPTH)))
    p = t.masked.select(*PK, "ts_s", "is_passive")
    d = lines.lines_at_pings(p, pts, ["surface"])
    return d.select(*PK, F.round(F.when(~F.col("is_passive"), F.col("surface")), 6).alias("surface"))


# --- lines ---

_A7 = """,
ck AS (SELECT *, sum(CASE WHEN keep THEN 0 ELSE 1 END) OVER (PARTITION BY transect_id, ping_index ORDER BY j) AS g FROM cell),
rl AS (SELECT transect_id, ping_index, g, count(*) AS len FROM ck WHERE keep GROUP BY ALL),
sq AS (SELECT ck.*, keep AND (is_upfacing OR len > 1) AS k2 FROM ck LEFT JOIN rl ON rl.transect_id = ck.transect_id AND rl.ping_index = ck.ping_index AND rl.g = ck.g AND ck.keep),
ml AS (SELECT transect_id, ping_index, any_value(ts_s) AS ts_s, any_value(turbulence) AS turbulence, any_value(bottom) AS bottom, any_value(is_passive) AS is_passive,
       bool_or(keep) AS any_keep, min(CASE WHEN k2 THEN depth END) - any_value(depth_stop - depth_start) / 63.0::DOUBLE / 2 AS top,
       max(CASE WHEN k2 THEN depth END) + any_value(depth_stop - depth_start) / 63.0::DOUBLE / 2 AS low FROM sq GROUP BY 1, 2)"""


@query("a7_lines_from_mask", "samp", _A7 + " SELECT transect_id, ping_index, round(top, 6) AS turbulence_new, round(low, 6) AS bottom_new FROM ml")
def _(t):
    d = lines.lines_from_mask(t.masked)
    return d.select(*PK, F.round("turbulence_new", 6).alias("turbulence_new"), F.round("bottom_new", 6).alias("bottom_new"))


_A8 = _A7 + """,
fx AS (SELECT transect_id, ping_index, is_passive, any_keep, CASE WHEN NOT any_keep THEN turbulence ELSE greatest(turbulence, coalesce(top, turbulence)) END AS turbulence_new,
              CASE WHEN NOT any_keep THEN bottom ELSE least(bottom, coalesce(low, bottom)) END AS bottom_new FROM ml)"""


@query("a8_fix_lines", "samp", _A8 + " SELECT transect_id, ping_index, round(turbulence_new, 6) AS turbulence_new, round(bottom_new, 6) AS bottom_new FROM fx")
def _(t):
    d = lines.fix_lines(t.masked, "turbulence", "bottom")
    return d.select(*PK, F.round("turbulence_new", 6).alias("turbulence_new"), F.round("bottom_new", 6).alias("bottom_new"))


@query(
    "a8_fix_lines_without_old",
    "samp",
    _A7 + ", src AS (SELECT transect_id, ping_index, ts_s, CASE WHEN any_keep THEN top END AS top FROM ml)," + interp_sql("src", "src", "top")
    + " SELECT transect_id, ping_index, round(y, 6) AS turbulence_new FROM interp",
)
def _(t):
    return lines.fix_lines(t.masked).select(*PK, F.round("turbulence_new", 6).alias("turbulence_new"))


@query(
    "a9_removed_stretches",
    "samp",
    _A8 + """,
em AS (SELECT *, ping_index - row_number() OVER (PARTITION BY transect_id ORDER BY ping_index) AS g FROM fx WHERE NOT any_keep AND NOT is_passive),
rr AS (SELECT transect_id, g, sum((turbulence_new < bottom_new)::INT) AS c, count(*) AS n FROM em GROUP BY 1, 2)
SELECT fx.transect_id, fx.ping_index, coalesce(rr.c > 0 AND NOT (rr.n >= 5 AND rr.c <= 2), FALSE) AS is_removed
FROM fx LEFT JOIN em ON em.transect_id = fx.transect_id AND em.ping_index = fx.ping_index LEFT JOIN rr ON rr.transect_id = em.transect_id AND rr.g = em.g""",
)
def _(t):
    return masks.removed_stretches(lines.fix_lines(t.masked, "turbulence", "bottom")).select(*PK, "is_removed")


@query("p6_offset_lines", "echo", " SELECT transect_id, ping_index, round(turbulence + 1.5, 6) AS turbulence, round(bottom - 0.5, 6) AS bottom, round(surface + 0.25, 6) AS surface FROM echo")
def _(t):
    d = lines.offset_lines(t.lined, turbulence=1.5, bottom=0.5, surface=0.25)
    return d.select(*PK, *[F.round(c, 6).alias(c) for c in ("turbulence", "bottom", "surface")])


@query(
    "p7_clip_nearfield",
    "echo",
    """ SELECT transect_id, ping_index, CASE WHEN is_upfacing THEN 31.75 - 5.7 ELSE 0.25 + 5.7 END::DOUBLE AS nearfield_depth,
  CASE WHEN is_upfacing THEN least(bottom, 31.75::DOUBLE - 5.7::DOUBLE) ELSE bottom END AS bottom,
  CASE WHEN is_upfacing THEN turbulence ELSE greatest(turbulence, 0.25::DOUBLE + 5.7::DOUBLE) END AS turbulence FROM echo""",
)
def _(t):
    return lines.clip_nearfield(t.lined, 5.7, True).select(*PK, F.round("nearfield_depth", 9).alias("nearfield_depth"), "bottom", "turbulence")


for _how in ("predict", "redact", "undefined", "interpolate_time", "interpolate_index"):
    _x = "ping_index" if _how.endswith("index") else "ts_s"
    if _how.startswith("interp"):
        _sql = (
            ", live AS (SELECT transect_id, ping_index, ts_s, CASE WHEN NOT is_passive THEN signal END AS y FROM series),"
            + interp_sql("series", "live", "y", _x, "z")
            + " SELECT s.transect_id, s.ping_index, round(coalesce(CASE WHEN NOT is_passive THEN signal ELSE z END, signal), 6) AS depth FROM series s JOIN interp USING (transect_id, ping_index)"
        )
    else:
        _sql = {
            "predict": " SELECT transect_id, ping_index, signal AS depth FROM series",
            "redact": " SELECT transect_id, ping_index, signal AS depth FROM series WHERE NOT is_passive",
            "undefined": " SELECT transect_id, ping_index, CASE WHEN is_passive THEN -10000.99::DOUBLE ELSE signal END AS depth FROM series",
        }[_how]

    @query(f"p8_passive_{_how}", "series", _sql)
    def _(t, how=_how.replace("_", "-")):
        d = lines.lines_during_passive(t.series.withColumnRenamed("signal", "depth"), how, ["depth"])
        return d.select(*PK, F.round("depth", 6).alias("depth"))


@query(
    "p9_line_masks",
    "samp",
    " SELECT transect_id, ping_index, count(*) FILTER (WHERE depth < turbulence) AS n_turbulence, count(*) FILTER (WHERE depth > bottom) AS n_bottom, count(*) FILTER (WHERE depth < surface) AS n_surface FROM samp GROUP BY 1, 2",
)
def _(t):
    d = lines.line_masks(t.lined)
    n = lambda c: F.size(F.filter(c, lambda x: x)).cast("long")
    return d.select(*PK, n("mask_turbulence").alias("n_turbulence"), n("mask_bottom").alias("n_bottom"), n("mask_surface").alias("n_surface"))


_PATCH = ", pc AS (SELECT *, ping_index BETWEEN 16 AND 19 AND j BETWEEN 20 AND 26 AS patch, ping_index % 23 IN (5, 6, 7) AS is_removed FROM cell)"


def _with_patches(d):
    k = F.col("ping_index")
    p = F.transform("sv", lambda _, j: k.between(16, 19) & j.between(20, 26))
    return d.withColumns({"mask_patches": p, "is_removed": (k % 23).isin(5, 6, 7)})


@query(
    "p10_keep_mask",
    "samp",
    _PATCH + " SELECT transect_id, ping_index, CAST(j AS INT) AS j, NOT (is_passive OR is_removed OR depth < turbulence OR depth > bottom OR patch) AS keep FROM pc",
)
def _(t):
    d = masks.keep_mask(lines.line_masks(_with_patches(t.masked)))
    return d.select(*PK, F.posexplode("mask").alias("j", "keep"))


@query(
    "p11_mask_when_untouched",
    "samp",
    """,
u AS (SELECT *, CASE WHEN transect_id % 2 = 0 THEN TRUE ELSE keep END AS m FROM cell),
a AS (SELECT transect_id, bool_and(m) AS untouched FROM u GROUP BY 1)
SELECT transect_id, ping_index, CAST(j AS INT) AS j, CASE WHEN untouched THEN NOT (depth < turbulence) AND NOT (depth > bottom) AND NOT is_passive ELSE m END AS keep FROM u JOIN a USING (transect_id)""",
)
def _(t):
    d = t.masked.withColumn("mask", F.transform("mask", lambda x: (F.col("transect_id") % 2 == 0) | x))
    d = masks.mask_when_untouched(d, top="turbulence", low="bottom")
    return d.select(*PK, F.posexplode("mask").alias("j", "keep"))


_RES = """,
rp AS (SELECT *, NOT keep AND NOT is_passive AND ping_index % 23 NOT IN (5, 6, 7) AS left_over,
              turbulence + 1.0 AS tn, bottom - 1.0 AS bn FROM cell),
pt AS (SELECT *, left_over AND NOT depth <= tn AND NOT depth >= bn AS merged, left_over AND NOT depth <= turbulence AND NOT depth >= bottom AS original,
              left_over AND NOT depth <= tn AND NOT depth >= bottom AS ntob FROM rp)"""


def _residual(t):
    d = _with_patches(t.masked).withColumns({"turbulence_original": F.col("turbulence"), "bottom_original": F.col("bottom")})
    d = d.withColumns({"turbulence": F.col("turbulence") + 1.0, "bottom": F.col("bottom") - 1.0})
    return masks.residual_patches(d)


@query("p12_residual_patches", "samp", _RES + " SELECT transect_id, ping_index, CAST(j AS INT) AS j, merged, original, ntob FROM pt")
def _(t):
    d = _residual(t).withColumn("_z", F.explode(F.arrays_zip("mask_patches", "mask_patches_original", "mask_patches_ntob", F.sequence(F.lit(0), F.size("sv") - 1).alias("j"))))
    return d.select(*PK, F.col("_z.j").alias("j"), F.col("_z.mask_patches").alias("merged"), F.col("_z.mask_patches_original").alias("original"), F.col("_z.mask_patches_ntob").alias("ntob"))


@query(
    "p13_drop_thin",
    "samp",
    """,
z AS (SELECT *, (vec_id * 7 + j * 13) % 5 < 2 AS p FROM samp)
SELECT transect_id, ping_index, CAST(j AS INT) AS j, p AND (lag(p, 2, TRUE) OVER w OR lead(p, 2, TRUE) OVER w) AS patch FROM z WINDOW w AS (PARTITION BY transect_id, ping_index ORDER BY j)""",
)
def _(t):
    d = t.echo.withColumn("m", F.transform("sv", lambda _, j: (F.col("vec_id") * 7 + j * 13) % 5 < 2))
    return d.select(*PK, F.posexplode(masks.drop_thin("m")).alias("j", "patch"))


@query(
    "p14_sane_labels",
    "echo",
    """,
b AS (SELECT transect_id, ping_index, surface + CASE WHEN vec_id % 3 = 0 THEN 30 ELSE 0 END AS s, turbulence, bottom FROM echo)
SELECT transect_id, ping_index, s >= bottom AS is_bad_labels, round(least(s, turbulence), 6) AS surface, round(greatest(bottom, least(s, turbulence) + 0.02), 6) AS bottom FROM b""",
)
def _(t):
    d = t.lined.withColumn("surface", F.col("surface") + F.when(F.col("vec_id") % 3 == 0, 30).otherwise(0))
    return lines.sane_labels(d).select(*PK, "is_bad_labels", F.round("surface", 6).alias("surface"), F.round("bottom", 6).alias("bottom"))


# Labels for near-field and offset cleaning, on grids with increasing depth.
_LAB = """,
lab AS (SELECT transect_id, ping_index, is_upfacing, jj AS j, 0.25::DOUBLE + jj * 0.5::DOUBLE AS depth, 1.5::DOUBLE + (vec_id % 4) * 0.5::DOUBLE AS t, 27.0::DOUBLE + (vec_id % 9) * 0.5::DOUBLE AS b,
               (vec_id + jj) % 7 = 0 AS p, (vec_id + jj) % 5 = 0 AS po, (vec_id + jj) % 6 = 0 AS pn
        FROM echo, (SELECT unnest(range(0, 64)) AS jj))"""


def _labels(t):
    v = F.col("vec_id")
    d = t.echo.withColumns(
        {
            "depth_start": F.lit(0.25), "depth_stop": F.lit(31.75), "surface": F.lit(0.5),
            "turbulence": 1.5 + (v % 4) * 0.5, "turbulence_original": 1.5 + (v % 4) * 0.5,
            "bottom": 27.0 + (v % 9) * 0.5, "bottom_original": 27.0 + (v % 9) * 0.5,
            "mask_patches": F.transform("sv", lambda _, j: (v + j) % 7 == 0),
            "mask_patches_original": F.transform("sv", lambda _, j: (v + j) % 5 == 0),
            "mask_patches_ntob": F.transform("sv", lambda _, j: (v + j) % 6 == 0),
        }
    )
    return d


# Upfacing: visible limit 31.75, threshold 31.75-1.25-1.7=28.8, cells [57, 63) (none lies
# beyond the limit). Downfacing: limit 0.966, distance 1.7, cells j+1=2 up to i=3.
_P15 = _LAB + """,
ag AS (SELECT transect_id, ping_index, bool_or(p AND j >= 57 AND j < 63) AS up_any, bool_or(po AND j = 57) AS up_at, bool_or(po AND j = 3) AS dn_at,
              bool_or(p AND j BETWEEN 2 AND 3) AS dn_any, bool_or(pn AND j BETWEEN 2 AND 3) AS dn_any_n FROM lab GROUP BY 1, 2),
nf AS (SELECT lab.*, CASE WHEN is_upfacing THEN b >= 28.8::DOUBLE ELSE t < 2.2::DOUBLE END AS near,
       CASE WHEN is_upfacing AND b >= 28.8::DOUBLE THEN 31.75::DOUBLE ELSE b END AS b2, CASE WHEN NOT is_upfacing AND t < 2.2::DOUBLE THEN 0.966::DOUBLE ELSE t END AS t2,
       CASE WHEN is_upfacing THEN p OR (up_any AND j >= 57 AND j < 63) ELSE p OR (dn_any AND j >= 2 AND j < 3) END AS p2,
       CASE WHEN is_upfacing THEN CASE WHEN j >= 57 THEN up_at ELSE po END ELSE CASE WHEN j < 3 THEN dn_at ELSE po END END AS po2,
       CASE WHEN is_upfacing THEN CASE WHEN j >= 57 THEN up_at ELSE pn END ELSE pn OR (dn_any_n AND j >= 2 AND j < 3) END AS pn2
       FROM lab JOIN ag USING (transect_id, ping_index))"""


def _cells_out(d):
    z = F.explode(F.arrays_zip("mask_patches", "mask_patches_original", "mask_patches_ntob", F.sequence(F.lit(0), F.size("sv") - 1).alias("j")))
    d = d.withColumn("_z", z)
    return d.select(
        *PK, F.col("_z.j").alias("j"), F.round("turbulence", 6).alias("turbulence"), F.round("bottom", 6).alias("bottom"),
        F.col("_z.mask_patches").alias("merged"), F.col("_z.mask_patches_original").alias("original"), F.col("_z.mask_patches_ntob").alias("ntob"),
    )


@query(
    "p15_remove_nearfield", "echo",
    _P15 + " SELECT transect_id, ping_index, CAST(j AS INT) AS j, round(t2, 6) AS turbulence, round(b2, 6) AS bottom, p2 AS merged, po2 AS original, pn2 AS ntob FROM nf",
)
def _(t):
    return _cells_out(masks.remove_nearfield(_labels(t)))


# Offsets 1.0 each. The original lines equal the lines before cleaning; the original bottom
# follows the near-field rule of upfacing recordings, the original turbulence never does.
_P16 = _P15 + """,
of AS (SELECT *, t2 - CASE WHEN NOT near OR is_upfacing THEN 1.0 ELSE 0.0 END::DOUBLE AS t3, t - 1.0::DOUBLE AS to3,
              b2 + CASE WHEN NOT near OR NOT is_upfacing THEN 1.0 ELSE 0.0 END::DOUBLE AS b3,
              b2 + CASE WHEN NOT (is_upfacing AND near) THEN 1.0 ELSE 0.0 END::DOUBLE AS bo3 FROM nf),
f1 AS (SELECT *, depth < t2 AND NOT depth < t3 AS ft, depth < t AND NOT depth < to3 AS fto, lead(p2) OVER w AS pnx, lead(po2) OVER w AS ponx FROM of WINDOW w AS (PARTITION BY transect_id, ping_index ORDER BY j)),
g1 AS (SELECT *, bool_or(ft AND coalesce(pnx, FALSE)) OVER q AS hit, bool_or(fto AND coalesce(ponx, FALSE)) OVER q AS hito FROM f1 WINDOW q AS (PARTITION BY transect_id, ping_index)),
h1 AS (SELECT *, p2 OR (hit AND ft) AS p3, pn2 OR (hit AND ft) AS pn3, po2 OR (hito AND fto) AS po3, depth > b2 AND NOT depth > b3 AS fb, depth > b2 AND NOT depth > bo3 AS fbo FROM g1),
f2 AS (SELECT *, lag(p3) OVER w AS ppv, lag(po3) OVER w AS popv FROM h1 WINDOW w AS (PARTITION BY transect_id, ping_index ORDER BY j)),
g2 AS (SELECT *, bool_or(fb AND coalesce(ppv, FALSE)) OVER q AS hit2, bool_or(fbo AND coalesce(popv, FALSE)) OVER q AS hit2o FROM f2 WINDOW q AS (PARTITION BY transect_id, ping_index))
SELECT transect_id, ping_index, CAST(j AS INT) AS j, round(t3, 6) AS turbulence, round(b3, 6) AS bottom, p3 OR (hit2 AND fb) AS merged, po3 OR (hit2o AND fbo) AS original, pn3 OR (hit2o AND fbo) AS ntob FROM g2"""


@query("p16_remove_line_offset", "echo", _P16)
def _(t):
    return _cells_out(masks.remove_line_offset(masks.remove_nearfield(_labels(t)), 1.0, 1.0))


@query(
    "p17_optimal_crop",
    "samp",
    """,
lim AS (SELECT transect_id, CASE WHEN any_value(is_upfacing) THEN min(CASE WHEN surface > 0.25 THEN surface END) ELSE 0.25 END - 2.5::DOUBLE AS lo,
               CASE WHEN any_value(is_upfacing) THEN 31.75 ELSE max(bottom) END + 2.5::DOUBLE AS hi FROM echo GROUP BY 1)
SELECT transect_id, ping_index, count(*) AS n_cells, round(min(depth), 6) AS top, round(max(depth), 6) AS low, round(sum(v), 6) AS total
FROM samp JOIN lim USING (transect_id) WHERE lo >= hi OR depth BETWEEN lo AND hi GROUP BY 1, 2""",
)
def _(t):
    d = t.lined.join(lines.optimal_limits(t.lined), "transect_id")
    d = grid.crop_depth(d, F.col("crop_lo"), F.col("crop_hi"))
    return d.select(
        *PK, F.size("sv").cast("long").alias("n_cells"), F.round(F.least("depth_start", "depth_stop"), 6).alias("top"),
        F.round(F.greatest("depth_start", "depth_stop"), 6).alias("low"), F.round(A.array_sum(F.filter("sv", lambda x: x.isNotNull())), 6).alias("total"),
    )


@query("p18_relative_depths", "echo", " SELECT transect_id, ping_index, round(surface / 31.5, 9) AS r_surface, round(turbulence / 31.5, 9) AS r_turbulence, round(bottom / 31.5, 9) AS r_bottom FROM echo")
def _(t):
    return lines.relative_depths(t.lined).select(*PK, *[F.round(f"r_{c}", 9).alias(f"r_{c}") for c in lines.LINES])


@query("p19_finite_clean", "samp", " SELECT transect_id, ping_index, CAST(count(*) FILTER (WHERE v IS NULL) AS INT) AS n_sv, round(sum(coalesce(v, 0)::FLOAT::DOUBLE), 3) AS total FROM samp GROUP BY 1, 2")
def _(t):
    d = masks.finite_clean_array(t.echo)
    return d.select(*PK, "n_sv", F.round(F.aggregate("sv", F.lit(0.0), lambda a, x: a + x.cast("double")), 3).alias("total"))


@query("p20_surrogate_off", "series", " SELECT transect_id, ping_index, is_removed AND NOT is_passive AS is_surrogate FROM series")
def _(t):
    return dataset.surrogate_off_during_passive(t.series.withColumn("is_surrogate", F.col("is_removed"))).select(*PK, "is_surrogate")


@query(
    "p23_default_lines",
    "echo",
    """,
h AS (SELECT *, transect_id % 3 <> 0 AS hb, transect_id % 4 <> 1 AS hs, transect_id % 5 <> 2 AS ht, transect_id % 5 = 2 AS ha FROM echo)
SELECT transect_id, ping_index, CASE WHEN hb THEN bottom WHEN is_upfacing THEN 31.75::DOUBLE END AS bottom, round(CASE WHEN hs THEN surface WHEN NOT is_upfacing THEN 0.0::DOUBLE END, 6) AS surface,
       CASE WHEN ht THEN turbulence ELSE turbulence + 1 END AS turbulence,
       CASE WHEN NOT hb AND NOT is_upfacing THEN 'no bottom line for a downfacing recording' WHEN NOT hs AND is_upfacing THEN 'no surface line for an upfacing recording' END AS error FROM h""",
)
def _(t):
    i = F.col("transect_id")
    d = t.lined.withColumns({"has_bottom": i % 3 != 0, "has_surface": i % 4 != 1, "has_turbulence": i % 5 != 2, "has_air": i % 5 == 2, "air": F.col("turbulence") + 1})
    return lines.default_lines(d, raise_errors=False).select(*PK, "bottom", F.round("surface", 6).alias("surface"), "turbulence", "error")


@query(
    "w20_boundary_index",
    "samp",
    """,
x AS (SELECT transect_id, ping_index, surface, turbulence, bottom, unnest(range(0, 64)) * 0.5::DOUBLE + 0.25::DOUBLE AS depth FROM echo)
SELECT transect_id, ping_index, CAST(least(63, count(*) FILTER (WHERE depth < turbulence)) AS INT) AS index_turbulence,
       CAST(least(63, count(*) FILTER (WHERE depth < surface)) AS INT) AS index_surface, CAST(greatest(0, count(*) FILTER (WHERE depth <= bottom) - 1) AS INT) AS index_bottom FROM x GROUP BY 1, 2""",
)
def _(t):
    d = lines.boundary_indices(grid.face_down(t.lined))
    return d.select(*PK, "index_turbulence", "index_surface", "index_bottom")


@query(
    "a12_autocrop",
    "echo",
    """,
l AS (SELECT *, bool_or(NOT is_passive) OVER (PARTITION BY transect_id) AS live FROM echo),
q AS (SELECT transect_id, any_value(is_upfacing) AS is_upfacing, quantile_cont(CASE WHEN is_upfacing THEN surface ELSE bottom END, 0.02275) AS lo,
             quantile_cont(CASE WHEN is_upfacing THEN surface ELSE bottom END, 0.97725) AS hi, min(surface) AS smin, max(bottom) AS bmax FROM l WHERE NOT live OR NOT is_passive GROUP BY 1),
c AS (SELECT transect_id, is_upfacing, CASE WHEN is_upfacing THEN greatest(lo - (hi - lo) / 2, smin) - 5.0::DOUBLE ELSE 0.25 END AS crop_min,
             CASE WHEN is_upfacing THEN 31.75 ELSE least(hi + (hi - lo) / 2, bmax) + 5.0::DOUBLE END AS crop_max FROM q)
SELECT transect_id, is_upfacing, round(crop_min, 6) AS crop_min, round(crop_max, 6) AS crop_max, (31.5 - abs(crop_max - crop_min)) / 31.5 > 0.05 AS do_crop FROM c""",
)
def _(t):
    d = t.masked.withColumn("depth_step", F.lit(0.5))
    r = lines.autocrop_limits(d, 0.05)
    return r.select("transect_id", "is_upfacing", F.round("crop_min", 6).alias("crop_min"), F.round("crop_max", 6).alias("crop_max"), "do_crop")


@query(
    "u8_clean_labels",
    "echo",
    _LAB + """,
w AS (SELECT transect_id, ping_index, is_upfacing, j, depth, t, b, p FROM lab),
s1 AS (SELECT *, CASE WHEN is_upfacing AND b >= 28.8::DOUBLE THEN 31.75::DOUBLE ELSE b END AS b2, CASE WHEN NOT is_upfacing AND t < 2.2::DOUBLE THEN 0.966::DOUBLE ELSE t END AS t2,
              bool_or(p AND j >= 57 AND j < 63) OVER q AS ua, bool_or(p AND j BETWEEN 2 AND 3) OVER q AS da FROM w WINDOW q AS (PARTITION BY transect_id, ping_index)),
s2 AS (SELECT *, CASE WHEN is_upfacing THEN p OR (ua AND j >= 57 AND j < 63) ELSE p OR (da AND j >= 2 AND j < 3) END AS p2 FROM s1)
SELECT transect_id, ping_index, count(*) FILTER (WHERE NOT (depth < t2) AND NOT (depth > b2) AND NOT p2 AND NOT (ping_index % 17 BETWEEN 11 AND 14) AND ping_index % 23 NOT IN (5, 6, 7)) AS n_keep,
       CAST(least(63, count(*) FILTER (WHERE depth < any_t2)) AS INT) AS index_turbulence, CAST(greatest(0, count(*) FILTER (WHERE depth <= any_b2) - 1) AS INT) AS index_bottom
FROM (SELECT *, t2 AS any_t2, b2 AS any_b2 FROM s2) GROUP BY 1, 2""",
)
def _(t):
    k = F.col("ping_index")
    d = _labels(t).withColumns({"is_passive": (k % 17).between(11, 14), "is_removed": (k % 23).isin(5, 6, 7), "is_surrogate": F.lit(False)})
    d = dataset.clean_labels(d)
    return d.select(*PK, F.size(F.filter("mask", lambda x: x)).cast("long").alias("n_keep"), "index_turbulence", "index_bottom")


@query(
    "u3_transform_chain",
    "samp",
    """,
st AS (SELECT transect_id, avg(v) AS c, stddev_pop(v) AS s FROM samp GROUP BY 1)
SELECT transect_id, ping_index, round(sum(coalesce((v - c) / s, 0)), 5) AS total FROM samp JOIN st USING (transect_id) GROUP BY 1, 2""",
)
def _(t):
    d = dataset.chain(t.echo, [lambda x: grid.normalise(x), lambda x: x.withColumn("sv", A.fill_missing("sv", 0.0))])
    return d.select(*PK, F.round(A.array_sum("sv"), 5).alias("total"))


