"""Ordered operators along recordings."""

import re

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import grid, lines, passive, runs, segments, smooth
from ..fixtures import CTE
from .registry import SQL, query

PK = ["transect_id", "ping_index"]
KEY = ["transect_id"]

_SEG = """,
steps AS (SELECT *, ts_s - lag(ts_s) OVER w AS dt FROM {src} WINDOW w AS (PARTITION BY transect_id ORDER BY ping_index)),
base AS (SELECT transect_id, quantile_cont(dt, 0.975) AS q FROM steps GROUP BY 1),
seg AS (SELECT s.* EXCLUDE (dt), CAST(sum(CASE WHEN dt > q * {thr} THEN 1 ELSE 0 END) OVER (
          PARTITION BY s.transect_id ORDER BY ping_index) AS BIGINT) AS segment_id
        FROM steps s JOIN base USING (transect_id))"""


@query(
    "flagship_segment_lines",
    "samp",
    _SEG.format(src="echo", thr=20)
    + """,
st AS (SELECT transect_id, quantile_cont(v, 0.5) AS c, (quantile_cont(v, 0.9) - quantile_cont(v, 0.1)) / 2.56 AS s
       FROM samp WHERE v IS NOT NULL GROUP BY 1),
nrm AS (SELECT transect_id, ping_index, avg((v - c) / s) AS level FROM samp JOIN st USING (transect_id) GROUP BY 1, 2),
mx AS (SELECT transect_id, ping_index, max(logit) AS m FROM samp GROUP BY 1, 2),
ex AS (SELECT s.transect_id, s.ping_index, j, depth, exp(logit - m) AS e FROM samp s JOIN mx USING (transect_id, ping_index)),
-- probabilities run over increasing depth, so upfacing pings are read backwards
pr AS (SELECT *, e / sum(e) OVER (PARTITION BY transect_id, ping_index) AS p FROM ex),
cu AS (SELECT *, sum(p) OVER (PARTITION BY transect_id, ping_index ORDER BY depth) AS below,
              sum(p) OVER (PARTITION BY transect_id, ping_index ORDER BY depth DESC) AS above FROM pr),
ln AS (SELECT transect_id, ping_index,
              coalesce(max(CASE WHEN above > 0.5 THEN depth END), max(depth)) AS turbulence,
              coalesce(min(CASE WHEN below > 0.5 THEN depth END), max(depth)) AS bottom FROM cu GROUP BY 1, 2)
SELECT transect_id, segment_id, count(*) AS n_pings, round(avg(ln.turbulence), 6) AS mean_turbulence,
       round(avg(ln.bottom), 6) AS mean_bottom, round(avg(level), 6) AS mean_level
FROM seg JOIN ln USING (transect_id, ping_index) JOIN nrm USING (transect_id, ping_index) GROUP BY 1, 2""",
)
def _(t):
    d = segments.split_gaps(t.logits)
    d = grid.normalise(d, "median", "idr")
    d = d.withColumn("level", A.array_sum(F.filter("sv", lambda x: x.isNotNull())) / F.size(F.filter("sv", lambda x: x.isNotNull())))
    d = grid.face_down(d, arrays=("sv", "logit")).withColumn("_p", A.softmax("logit"))
    g = A.depth_grid("sv")
    d = d.withColumns(
        {
            "line_t": lines.line_from_probability(A.p_above("_p"), "above", g),
            "line_b": lines.line_from_probability(A.p_below("_p"), "below", g),
        }
    )
    return d.groupBy("transect_id", "segment_id").agg(
        F.count(F.lit(1)).alias("n_pings"),
        F.round(F.avg("line_t"), 6).alias("mean_turbulence"),
        F.round(F.avg("line_b"), 6).alias("mean_bottom"),
        F.round(F.avg("level"), 6).alias("mean_level"),
    )


_STEP = """,
d AS (SELECT transect_id, ping_index, j, v - lag(v) OVER (PARTITION BY transect_id, j ORDER BY ping_index) AS dv,
             count(v) OVER (PARTITION BY transect_id, ping_index) AS dummy
      FROM samp WHERE j < 38),
md AS (SELECT transect_id, ping_index, CASE WHEN count(dv) = count(*) THEN quantile_cont(dv, 0.5) END AS step FROM d GROUP BY 1, 2)"""


@query(
    "w1_median_step", "samp", _STEP + " SELECT transect_id, ping_index, round(step, 6) AS step FROM md",
)
def _(t):
    d = passive.median_step(passive.near_samples(t.echo))
    return d.select(*PK, F.round("step", 6).alias("step"))


@query("w2_split_gaps", "echo", _SEG.format(src="echo", thr=20) + " SELECT transect_id, ping_index, segment_id FROM seg")
def _(t):
    return segments.split_gaps(t.echo).select(*PK, "segment_id")


@query("w2_split_gaps_events", "series", _SEG.format(src="series", thr=1) + " SELECT transect_id, ping_index, segment_id FROM seg")
def _(t):
    return segments.split_gaps(t.series, threshold=1).select(*PK, "segment_id")


_PART = (
    _SEG.format(src="series", thr=1)
    + """,
b AS (SELECT transect_id, segment_id, min(ping_index) AS a, max(ping_index) + 1 AS z FROM seg GROUP BY 1, 2),
k AS (SELECT *, CAST(ceil((z - a) / 20.0::DOUBLE) AS BIGINT) AS n FROM b),
e AS (SELECT *, unnest(range(0, n)) AS i FROM k),
p AS (SELECT transect_id, segment_id, i, n, CAST(round_even(a + (z - a) * i / n::DOUBLE, 0) AS BIGINT) AS part_start,
             CAST(round_even(a + (z - a) * (i + 1) / n::DOUBLE, 0) AS BIGINT) AS part_end FROM e),
parts AS (SELECT *, row_number() OVER (PARTITION BY transect_id ORDER BY part_start) - 1 AS part_id,
                 max(part_end) OVER (PARTITION BY transect_id) AS total, i > 0 AS cut_before, i < n - 1 AS cut_after FROM p)"""
)


@query("w3_cut_long", "series", _PART + " SELECT transect_id, segment_id, part_id, part_start, part_end, cut_before, cut_after FROM parts")
def _(t):
    d = segments.cut_long(segments.split_gaps(t.series, threshold=1), 20)
    d = d.where("ping_index = part_start")
    return d.select("transect_id", "segment_id", "part_id", "part_start", "part_end", "cut_before", "cut_after")


def _pad_sql(on):
    before = {"max": "cut_before", "thr": "NOT cut_before", "all": "TRUE"}[on]
    after = {"max": "cut_after", "thr": "NOT cut_after", "all": "TRUE"}[on]
    return (
        _PART
        + f""",
q AS (SELECT *, CASE WHEN {before} AND part_start > 0 THEN least(5, part_start) ELSE 0 END AS pad_start,
             CASE WHEN {after} AND part_end < total THEN least(5, total - part_end) ELSE 0 END AS pad_end FROM parts)
SELECT s.transect_id, part_id, s.ping_index, s.ping_index < part_start OR s.ping_index >= part_end AS is_pad,
       CAST(pad_start AS BIGINT) AS pad_start, CAST(pad_end AS BIGINT) AS pad_end
FROM q JOIN series s ON s.transect_id = q.transect_id AND s.ping_index >= part_start - pad_start AND s.ping_index < part_end + pad_end"""
    )


def _padded(t, on):
    d = segments.cut_long(segments.split_gaps(t.series, threshold=1), 20)
    return segments.pad_overlap(d, 5, on)


for _on in ("max", "thr", "all"):

    @query(f"w4_pad_overlap_{_on}", "series", _pad_sql(_on))
    def _(t, on=_on):
        return _padded(t, on).select("transect_id", "part_id", "ping_index", "is_pad", "pad_start", "pad_end")


@query("x1_join_parts", "series", " SELECT transect_id, ping_index, round(ts_s, 3) AS ts_s, signal FROM series")
def _(t):
    return segments.join_parts(_padded(t, "all")).select(*PK, F.round("ts_s", 3).alias("ts_s"), "signal")


_RUN = """,
on_ AS (SELECT transect_id, ping_index, ping_index - row_number() OVER (PARTITION BY transect_id ORDER BY ping_index) AS g
        FROM series WHERE is_passive),
runs AS (SELECT transect_id, min(ping_index) AS first, max(ping_index) AS last FROM on_ GROUP BY transect_id, g)"""


@query("w5_runs", "series", _RUN + " SELECT transect_id, first, last FROM runs")
def _(t):
    return runs.flag_runs(t.series, "is_passive").select("transect_id", "first", "last")


@query("w6_runs_exclusive", "series", _RUN + ' SELECT transect_id, first AS start, last + 1 AS "end" FROM runs')
def _(t):
    return runs.exclusive_runs(t.series, "is_passive")


@query(
    "w7_squash_gaps",
    "series",
    """,
c AS (SELECT *, max(CASE WHEN is_passive THEN ping_index END) OVER (PARTITION BY transect_id ORDER BY ping_index) AS lo,
             min(CASE WHEN is_passive THEN ping_index END) OVER (PARTITION BY transect_id ORDER BY ping_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi,
             count(*) OVER (PARTITION BY transect_id) AS n FROM series)
SELECT transect_id, ping_index, NOT is_passive AND coalesce(hi, n) - coalesce(lo, -1) - 1 > least(4, n - 1) - 1 AS live FROM c""",
)
def _(t):
    d = t.series.withColumn("live", ~F.col("is_passive"))
    return runs.squash_gaps(d, "live", 4).select(*PK, "live")


def _region_sql(flag, kind, title, label, collate, minimum):
    return f""",
c AS (SELECT *, max(CASE WHEN {flag} THEN ping_index END) OVER (PARTITION BY transect_id ORDER BY ping_index) AS lo,
             min(CASE WHEN {flag} THEN ping_index END) OVER (PARTITION BY transect_id ORDER BY ping_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi,
             count(*) OVER (PARTITION BY transect_id) AS n, lag(ts_s) OVER w AS pt, lead(ts_s) OVER w AS nt
      FROM series WINDOW w AS (PARTITION BY transect_id ORDER BY ping_index)),
f AS (SELECT *, {flag} OR coalesce(hi, n) - coalesce(lo, -1) - 1 <= least({collate}, n - 1) - 1 AS flag,
             coalesce((ts_s + pt) / 2, ts_s - (nt - ts_s) / 2) AS l, coalesce((ts_s + nt) / 2, ts_s + (ts_s - pt) / 2) AS r FROM c),
o AS (SELECT *, ping_index - row_number() OVER (PARTITION BY transect_id ORDER BY ping_index) AS g FROM f WHERE flag),
u AS (SELECT transect_id, min(ping_index) AS first, max(ping_index) AS last, min(l) AS ts_start, max(r) AS ts_end FROM o GROUP BY transect_id, g),
x AS (SELECT *, CAST(last - first + 1 AS DOUBLE) AS length FROM u WHERE last - first + 1 > {minimum}),
y AS (SELECT *, row_number() OVER (PARTITION BY transect_id ORDER BY first) AS number FROM x)
SELECT transect_id, '{kind}' AS kind, number, first, last, length, round(ts_start, 4) AS ts_start, round(ts_end, 4) AS ts_end,
       '{label} ' || number AS region_name,
       '{title}' || chr(10) || 'Length in pixels: ' || CAST(length AS VARCHAR) || chr(10) || 'Duration in seconds: ' AS notes FROM y"""


def _region(t, flag, kind, collate, minimum):
    r = runs.flag_regions(t.series, flag, kind, collate, minimum)
    return r.select(
        "transect_id", "kind", "number", "first", "last", "length", F.round("ts_start", 4).alias("ts_start"),
        F.round("ts_end", 4).alias("ts_end"), "region_name",
        # The duration's digits are checked through its two ends.
        F.regexp_replace("notes", "seconds: .*$", "seconds: ").alias("notes"),
    )


@query("w8_passive_regions", "series", _region_sql("is_passive", "passive", "Passive data", "Passive", 3, 1))
def _(t):
    return _region(t, "is_passive", "passive", 3, 1)


@query("w8_removed_regions", "series", _region_sql("is_removed", "removed", "Removed data block", "Removed block", 0, 0))
def _(t):
    return _region(t, "is_removed", "removed", 0, 0)


def _fold(mode):
    return {
        "reflect": "CASE WHEN n = 1 THEN 0 WHEN ((k % (2*(n-1))) + 2*(n-1)) % (2*(n-1)) < n THEN ((k % (2*(n-1))) + 2*(n-1)) % (2*(n-1)) ELSE 2*(n-1) - ((k % (2*(n-1))) + 2*(n-1)) % (2*(n-1)) END",
        "edge": "greatest(0, least(k, n - 1))",
        "symmetric": "CASE WHEN ((k % (2*n)) + 2*n) % (2*n) < n THEN ((k % (2*n)) + 2*n) % (2*n) ELSE 2*n - 1 - ((k % (2*n)) + 2*n) % (2*n) END",
        "constant": "CASE WHEN k BETWEEN 0 AND n - 1 THEN k END",
    }[mode]


def _ext(src, r, mode, val="signal"):
    return f""",
ln AS (SELECT transect_id, count(*) AS n FROM {src} GROUP BY 1),
kk AS (SELECT transect_id, n, unnest(range(-{r}, n + {r})) AS k FROM ln),
ext AS (SELECT kk.transect_id, k, n, s.{val} AS x FROM (SELECT *, {_fold(mode)} AS src FROM kk) kk
        LEFT JOIN {src} s ON s.transect_id = kk.transect_id AND s.ping_index = kk.src)"""


for _k in (5, 31):

    @query(
        f"w9_median_filter_{_k}",
        "series",
        _ext("series", _k // 2, "reflect")
        + f""",
m AS (SELECT transect_id, k, n, quantile_cont(x, 0.5) OVER (PARTITION BY transect_id ORDER BY k ROWS BETWEEN {_k // 2} PRECEDING AND {_k // 2} FOLLOWING) AS y FROM ext)
SELECT transect_id, k AS ping_index, round(y, 6) AS filtered FROM m WHERE k BETWEEN 0 AND n - 1""",
    )
    def _(t, k=_k):
        return smooth.median_filter(t.series, "signal", k, out="filtered").select(*PK, F.round("filtered", 6).alias("filtered"))


@query(
    "w10_anomalies_first_pass",
    "series",
    _ext("series", 7, "reflect")
    + """,
m AS (SELECT transect_id, k, n, x, quantile_cont(x, 0.5) OVER (PARTITION BY transect_id ORDER BY k ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS y FROM ext),
r AS (SELECT transect_id, k AS ping_index, x, y, x - y AS res FROM m WHERE k BETWEEN 0 AND n - 1),
s AS (SELECT transect_id, (quantile_cont(res, 0.75) - quantile_cont(res, 0.25)) / 1.35 AS sd FROM r GROUP BY 1)
SELECT transect_id, ping_index, abs(res) > 2 * sd AS is_replaced, round(CASE WHEN abs(res) > 2 * sd THEN y ELSE x END, 6) AS signal
FROM r JOIN s USING (transect_id)""",
)
def _(t):
    d = smooth.first_pass(t.series, "signal", thr=2, kernel=15)
    return d.select(*PK, "is_replaced", F.round("signal", 6).alias("signal"))


def _median_list(xs, n, r):
    """Running medians of a list, mirrored at its ends."""
    k = f"CASE WHEN {n} = 1 THEN 0 ELSE (CASE WHEN pmod(k, 2 * ({n} - 1)) < {n} THEN pmod(k, 2 * ({n} - 1)) ELSE 2 * ({n} - 1) - pmod(k, 2 * ({n} - 1)) END) END"
    k = re.sub(r"pmod\(k, (2 \* \(\w+ - 1\))\)", r"(((k % (\1)) + \1) % (\1))", k)
    return f"list_transform(range(0, {n}), lambda i: list_aggregate(list_transform(range(i - {r}, i + {r} + 1), lambda k: {xs}[({k}) + 1]), 'quantile_cont', 0.5))"


def _anomaly_rounds(src):
    """``done``: one row per key with lists in order of index, after rounds of cleaning until nothing new or a state comes again.

    ``src`` has columns key, i, x without NULL.
    """
    spread = lambda values, lo, hi, scale: f"(list_aggregate({values}, 'quantile_cont', {hi}) - list_aggregate({values}, 'quantile_cont', {lo})) / {scale}"
    return f""",
l0 AS (SELECT key, list(i ORDER BY i) AS ids, list(x ORDER BY i) AS xs, count(*) AS n FROM {src} GROUP BY key),
l1 AS (SELECT *, {_median_list("xs", "n", 100)} AS ys FROM l0),
l2 AS (SELECT *, list_transform(range(1, n + 1), lambda i: xs[i] - ys[i]) AS res FROM l1),
l3 AS (SELECT *, list_transform(res, lambda v: abs(v) > 5 * sd) AS hit FROM (SELECT *, {spread("res", 0.25, 0.75, 1.35)} AS sd FROM l2)),
rounds AS (
  SELECT key, ids, n, list_transform(range(1, n + 1), lambda i: CASE WHEN hit[i] THEN ys[i] ELSE xs[i] END) AS xs, hit, ys, []::VARCHAR[] AS states, false AS ends, false AS settled FROM l3
  UNION ALL
  SELECT key, ids, n, xs, hit, ys, list_append(states, state), NOT live OR list_contains(states, state), NOT live FROM (
    SELECT *, md5(xs::VARCHAR || hit::VARCHAR) AS state FROM (
      SELECT key, ids, n, states, ys, live, hit, list_transform(range(1, n + 1), lambda i: CASE WHEN hit[i] THEN ys[i] ELSE xs[i] END) AS xs FROM (
        SELECT key, ids, n, states, xs, ys, list_contains(now, true) AS live, list_transform(range(1, n + 1), lambda i: hit[i] OR coalesce(now[i], false)) AS hit FROM (
          SELECT *, list_transform(res, lambda v: abs(v) > 4 * sd) AS now FROM (
            SELECT *, {spread("list_filter(res, lambda v, i: NOT hit[i])", 0.10, 0.90, 2.56)} AS sd FROM (
              SELECT *, list_transform(range(1, n + 1), lambda i: xs[i] - ys[i]) AS res FROM (
                SELECT * EXCLUDE (ys), {_median_list("xs", "n", 15)} AS ys FROM rounds WHERE NOT ends)))))))),
done AS (SELECT key, unnest(ids) AS i, unnest(xs) AS x, unnest(hit) AS hit, unnest(ys) AS y, settled FROM rounds WHERE ends)"""


_ANOMALIES = f"""WITH RECURSIVE {CTE["series"]},
src AS (SELECT transect_id AS key, ping_index AS i, signal AS x FROM series)
{_anomaly_rounds("src")}
SELECT key AS transect_id, i AS ping_index, round(x, 6) AS signal, hit AS is_replaced, settled FROM done"""


@query("w10_remove_anomalies", None, _ANOMALIES)
def _(t):
    d = smooth.remove_anomalies(t.series, "signal", thr=5, thr2=4)
    return d.select(*PK, F.round("signal", 6).alias("signal"), "is_replaced", "settled")


_SURFACE = f"""WITH RECURSIVE {CTE["series"]},
act AS (SELECT transect_id, ping_index, ts_s, signal, ts_s - lag(ts_s) OVER (PARTITION BY transect_id ORDER BY ping_index) AS dt FROM series WHERE NOT is_passive),
q AS (SELECT transect_id, quantile_cont(dt, 0.975) AS q FROM act GROUP BY 1),
sg AS (SELECT a.*, sum(CASE WHEN dt > q * 20 THEN 1 ELSE 0 END) OVER (PARTITION BY a.transect_id ORDER BY ping_index) AS seg FROM act a JOIN q USING (transect_id)),
src AS (SELECT {{'t': transect_id, 's': seg}} AS key, ping_index AS i, signal AS x FROM sg)
{_anomaly_rounds("src")},
j AS (SELECT s.transect_id, s.ping_index, s.ts_s, s.is_passive, d.x, d.hit, d.settled, CASE WHEN d.y IS NOT NULL THEN {{'x': s.ts_s, 'y': d.y}} END AS p
      FROM series s LEFT JOIN done d ON d.key.t = s.transect_id AND d.i = s.ping_index),
b AS (SELECT *, last_value(p IGNORE NULLS) OVER (PARTITION BY transect_id ORDER BY ping_index) AS lo,
             first_value(p IGNORE NULLS) OVER (PARTITION BY transect_id ORDER BY ping_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM j),
o AS (SELECT b.*, s.signal AS raw FROM b JOIN series s USING (transect_id, ping_index))
SELECT transect_id, ping_index,
  round(CASE WHEN NOT is_passive THEN x ELSE coalesce(CASE WHEN lo IS NULL THEN hi.y WHEN hi IS NULL THEN lo.y WHEN hi.x <= lo.x THEN lo.y
    ELSE lo.y + (hi.y - lo.y) / (hi.x - lo.x) * (ts_s - lo.x) END, raw) END, 6) AS surface,
  coalesce(hit, true) AS is_surrogate, coalesce(settled, true) AS settled FROM o"""


@query("w11_fix_surface", None, _SURFACE)
def _(t):
    d = smooth.fix_surface(t.series.withColumnRenamed("signal", "surface"))
    return d.select(*PK, F.round("surface", 6).alias("surface"), "is_surrogate", "settled")


@query(
    "w12_passive_candidates",
    "samp",
    _STEP + " SELECT transect_id, ping_index, step < -25 AS is_start, step > 25 AS is_end FROM md WHERE step < -25 OR step > 25",
)
def _(t):
    return passive.candidates(t.echo).select(*PK, "is_start", "is_end")


_GAUSS = smooth.gaussian_weights(1.0)


def _gauss_case(col="o"):
    return "CASE " + " ".join(f"WHEN {col} = {i - 4} THEN {w!r}::DOUBLE" for i, w in enumerate(_GAUSS)) + " END"


@query(
    "w13_passive_clusters",
    "samp",
    f""",
ln AS (SELECT transect_id, count(*) AS n FROM echo GROUP BY 1),
near AS (SELECT transect_id, ping_index, j, v FROM samp WHERE j < 38),
kk AS (SELECT transect_id, n, i, o, i + o AS k FROM (SELECT transect_id, n, unnest(range(0, n)) AS i FROM ln), (SELECT unnest(range(-4, 5)) AS o)),
sm AS (SELECT kk.transect_id, i AS ping_index, j, sum(v * {_gauss_case()}) AS v
       FROM (SELECT *, {_fold('symmetric')} AS src FROM kk) kk JOIN near s ON s.transect_id = kk.transect_id AND s.ping_index = kk.src GROUP BY 1, 2, 3),
d AS (SELECT transect_id, ping_index, v - lag(v) OVER (PARTITION BY transect_id, j ORDER BY ping_index) AS dv FROM sm),
md AS (SELECT transect_id, ping_index, CASE WHEN count(dv) = count(*) THEN quantile_cont(dv, 0.5) END AS step FROM d GROUP BY 1, 2),
c AS (SELECT *, 'start' AS kind, step AS d FROM md WHERE step < -12 UNION ALL SELECT *, 'end', -step FROM md WHERE step > 12),
g AS (SELECT *, CASE WHEN ping_index - lag(ping_index) OVER (PARTITION BY transect_id, kind ORDER BY ping_index) <= 3 THEN 0 ELSE 1 END AS b FROM c),
r AS (SELECT *, sum(b) OVER (PARTITION BY transect_id, kind ORDER BY ping_index) AS run FROM g)
SELECT transect_id, arg_min(ping_index, (d, ping_index)) AS ping_index, kind = 'start' AS is_start, kind = 'end' AS is_end FROM r GROUP BY transect_id, kind, run""",
)
def _(t):
    return passive.clusters(t.echo).select(*PK, "is_start", "is_end")


# The greedy reading in SQL. ``cand`` lists candidate starts and ends, ``th`` the threshold per
# recording. Where a start's stretch ends does not depend on what was read before, so the
# reading is a chain over starts.
def _stretch_sql(before, after):
    return f""",
nn AS (SELECT transect_id, max(ping_index) + 1 AS n FROM echo GROUP BY 1),
x AS (SELECT transect_id, ping_index AS i, j, v FROM samp WHERE j < 38),
fe AS (SELECT transect_id, min(CASE WHEN is_end THEN ping_index END) AS e0, min(CASE WHEN is_start THEN ping_index END) AS s0 FROM cand GROUP BY 1),
ld AS (SELECT transect_id, e0 FROM fe WHERE e0 IS NOT NULL AND (s0 IS NULL OR e0 < s0)),
st AS (SELECT c.transect_id, ping_index AS s FROM cand c LEFT JOIN ld USING (transect_id) WHERE is_start AND (e0 IS NULL OR ping_index > e0)),
fw AS (SELECT st.transect_id, s, b.i FROM st JOIN x a ON a.transect_id = st.transect_id AND a.i = greatest(0, s - {before}) JOIN x b ON b.transect_id = st.transect_id AND b.i >= s AND b.j = a.j
       JOIN th ON th.transect_id = st.transect_id GROUP BY ALL HAVING quantile_cont(a.v - b.v, 0.5) < any_value(thr)),
en AS (SELECT st.transect_id, st.s, coalesce(min(fw.i), any_value(n)) AS e FROM st JOIN nn USING (transect_id) LEFT JOIN fw ON fw.transect_id = st.transect_id AND fw.s = st.s GROUP BY 1, 2),
nx AS (SELECT a.transect_id, a.s, a.e, min(b.s) AS nxt FROM en a LEFT JOIN en b ON b.transect_id = a.transect_id AND b.s > a.e GROUP BY ALL),
ch AS (SELECT transect_id, s, e, nxt FROM nx WHERE (transect_id, s) IN (SELECT (transect_id, min(s)) FROM nx GROUP BY transect_id)
       UNION ALL SELECT nx.transect_id, nx.s, nx.e, nx.nxt FROM ch JOIN nx ON nx.transect_id = ch.transect_id AND nx.s = ch.nxt),
bw AS (SELECT ch.transect_id, ch.s, b.i FROM ch JOIN nn USING (transect_id) JOIN x a ON a.transect_id = ch.transect_id AND a.i = least(n - 1, e + {after}) JOIN x b ON b.transect_id = ch.transect_id AND b.i < e AND b.j = a.j
       JOIN th ON th.transect_id = ch.transect_id WHERE e < n GROUP BY ALL HAVING quantile_cont(a.v - b.v, 0.5) < any_value(thr)),
ws AS (SELECT ch.transect_id, ch.s, ch.e, CASE WHEN ch.e >= any_value(n) THEN ch.s ELSE coalesce(least(ch.s, max(bw.i) + 1), 0) END AS a
       FROM ch JOIN nn USING (transect_id) LEFT JOIN bw ON bw.transect_id = ch.transect_id AND bw.s = ch.s GROUP BY 1, 2, 3
       UNION ALL SELECT transect_id, 0, e0, 0 FROM ld),
mk AS (SELECT *, CASE WHEN a <= lag(e) OVER (PARTITION BY transect_id ORDER BY s) THEN 0 ELSE 1 END AS nw FROM ws),
gr AS (SELECT *, sum(nw) OVER (PARTITION BY transect_id ORDER BY s) AS g FROM mk)
SELECT transect_id, CAST(arg_min(a, s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS "end" FROM gr GROUP BY transect_id, g"""


_V1 = "WITH RECURSIVE " + CTE["samp"] + _STEP
_FIXED = ", th AS (SELECT DISTINCT transect_id, {thr}::DOUBLE AS thr FROM echo)"
_CAND = ", cand AS (SELECT md.transect_id, ping_index, step < -thr AS is_start, step > thr AS is_end FROM md JOIN th USING (transect_id) WHERE step < -thr OR step > thr)"
_IQR = ", th AS (SELECT transect_id, quantile_cont(step, 0.75) - quantile_cont(step, 0.25) AS thr FROM md GROUP BY 1)"


@query("w12_find_passive", sql=_V1 + _FIXED.format(thr=25) + _CAND + _stretch_sql(1, 0))
def _(t):
    return passive.find_passive(t.echo)


@query("w12_find_passive_deviation", sql=_V1 + _IQR + _CAND + _stretch_sql(1, 0))
def _(t):
    return passive.find_passive(t.echo, threshold=None, deviation=1.0)


_V2 = SQL["w13_passive_clusters"].replace("WITH ", "WITH RECURSIVE ", 1)
_V2 = _V2.replace("\nSELECT transect_id, arg_min(ping_index", ",\ncand AS (SELECT transect_id, arg_min(ping_index") + ")" + _FIXED.format(thr=35) + _stretch_sql(2, 1)


@query("w13_find_passive_v2", sql=_V2)
def _(t):
    return passive.find_passive_v2(t.echo)


@query(
    "a22_compare_finders",
    sql=f"""SELECT transect_id, count(*) FILTER (WHERE xa = 1 AND xb = 1) AS n_both, count(*) FILTER (WHERE xb IS NULL) AS n_first_only, count(*) FILTER (WHERE xa IS NULL) AS n_second_only,
       bool_and(xa IS NOT NULL AND xb IS NOT NULL) AS agree
FROM (SELECT *, 1 AS xa FROM ({SQL['w12_find_passive']})) a FULL JOIN (SELECT *, 1 AS xb FROM ({SQL['w13_find_passive_v2']})) b USING (transect_id, start, "end") GROUP BY 1""",
)
def _(t):
    return passive.compare_finders(passive.find_passive(t.echo), passive.find_passive_v2(t.echo))


@query(
    "w14_gaussian_time",
    "series",
    _ext("series", 4, "symmetric")
    + f""",
p AS (SELECT a.transect_id, a.k AS ping_index, sum(b.x * {_gauss_case('(b.k - a.k)')}) AS y
      FROM ext a JOIN ext b ON a.transect_id = b.transect_id AND b.k BETWEEN a.k - 4 AND a.k + 4
      WHERE a.k BETWEEN 0 AND a.n - 1 GROUP BY 1, 2)
SELECT transect_id, ping_index, round(y, 6) AS smooth FROM p""",
)
def _(t):
    return smooth.gaussian_time(t.series, "signal", 1.0, out="smooth").select(*PK, F.round("smooth", 6).alias("smooth"))


@query(
    "w14_gaussian_depth",
    "samp",
    f""",
o AS (SELECT transect_id, ping_index, j, o, (((j + o) % 128) + 128) % 128 AS m FROM samp, (SELECT unnest(range(-4, 5)) AS o)),
s AS (SELECT o.transect_id, o.ping_index, o.j, sum(x.logit * {_gauss_case('o.o')}) AS y
      FROM o JOIN samp x ON x.transect_id = o.transect_id AND x.ping_index = o.ping_index AND x.j = CASE WHEN o.m < 64 THEN o.m ELSE 127 - o.m END
      GROUP BY 1, 2, 3)
SELECT transect_id, ping_index, CAST(j AS INT) AS j, round(y, 6) AS smooth FROM s""",
)
def _(t):
    d = t.logits.withColumn("s", smooth.gaussian_depth("logit", 1.0))
    return d.select(*PK, F.posexplode("s").alias("j", "v")).select(*PK, "j", F.round("v", 6).alias("smooth"))


for _mode in ("reflect", "edge", "constant"):

    @query(
        f"w16_pad_{_mode}",
        "series",
        _ext("series", 40, _mode)
        + " SELECT transect_id, k AS ping_index, x AS signal, CAST(40 AS BIGINT) AS pad_start FROM ext",
    )
    def _(t, mode=_mode):
        return segments.pad_in_time(t.series, 40, mode).select(*PK, "signal", F.coalesce("pad_start", F.lit(40)).cast("long").alias("pad_start"))


_WIN = """,
ln AS (SELECT transect_id, count(*) AS n FROM series GROUP BY 1),
w AS (SELECT *, CAST(ceil(n / 16.0::DOUBLE) AS BIGINT) AS k FROM ln),
c AS (SELECT transect_id, n, unnest(range(0, k)) AS win, k FROM w),
win AS (SELECT transect_id, n, win, CAST(round_even(win * (n / k::DOUBLE) + 0.5::DOUBLE * (n / k::DOUBLE), 0) AS BIGINT) AS center FROM c)"""


@query("w17_windows", "series", _WIN + ' SELECT transect_id, CAST(win AS INT) AS "window", center, center - 8 AS i1, center + 8 AS i2 FROM win')
def _(t):
    n = t.series.groupBy("transect_id").agg(F.count(F.lit(1)).alias("n_pings"))
    return segments.windows(n, 16).select("transect_id", "window", "center", "i1", "i2")


def _range_sql(mode):
    f = {
        "reflect": "CASE WHEN m = 1 THEN 0 WHEN ((k % (2*(m-1))) + 2*(m-1)) % (2*(m-1)) < m THEN ((k % (2*(m-1))) + 2*(m-1)) % (2*(m-1)) ELSE 2*(m-1) - ((k % (2*(m-1))) + 2*(m-1)) % (2*(m-1)) END",
        "edge": "greatest(0, least(k, m - 1))",
    }[mode]
    return (
        _WIN
        + f""",
r AS (SELECT transect_id, win, center - 8 AS i1, greatest(center - 8, 0) AS lo, least(center + 8, n) - greatest(center - 8, 0) AS m,
             unnest(range(center - 8, center + 8)) AS oi FROM win),
q AS (SELECT *, oi - lo AS k FROM r)
SELECT q.transect_id, CAST(win AS INT) AS "window", oi AS out_index, s.ping_index, s.signal
FROM (SELECT *, {f} + lo AS src FROM q) q JOIN series s ON s.transect_id = q.transect_id AND s.ping_index = q.src"""
    )


for _mode in ("reflect", "edge"):

    @query(f"s13_read_ranges_{_mode}", "series", _range_sql(_mode))
    def _(t, mode=_mode):
        n = t.series.groupBy("transect_id").agg(F.count(F.lit(1)).alias("n_pings"))
        w = segments.windows(n, 16).select("transect_id", "window", "i1", "i2")
        return segments.read_ranges(t.series, w, mode).select("transect_id", "window", "out_index", "ping_index", "signal")


@query("p22_head_cap", "series", " SELECT transect_id, ping_index, signal FROM series WHERE ping_index < 3500")
def _(t):
    # The cut is the operator, and a caller's choice: no flow applies it by itself.
    return t.series.where("ping_index < 3500").select(*PK, "signal")


