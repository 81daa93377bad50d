"""Probabilities, metrics, losses, sampling and augmentation."""

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import lines, metrics, probs, sampling
from .registry import query

PK = ["transect_id", "ping_index"]
KEY = ["transect_id"]

_PR = """,
mx AS (SELECT transect_id, ping_index, max(logit) AS m FROM samp GROUP BY 1, 2),
pr AS (SELECT s.*, exp(logit - m) / sum(exp(logit - m)) OVER (PARTITION BY s.transect_id, s.ping_index) AS p FROM samp s JOIN mx USING (transect_id, ping_index)),
cu AS (SELECT *, least(1, greatest(0, sum(p) OVER (PARTITION BY transect_id, ping_index ORDER BY j))) AS below,
              least(1, greatest(0, sum(p) OVER (PARTITION BY transect_id, ping_index ORDER BY j DESC))) AS above FROM pr)"""


@query("w15_boundary_probabilities", "samp", _PR + " SELECT transect_id, ping_index, CAST(j AS INT) AS j, round(p, 9) AS p, round(below, 9) AS below, round(above, 9) AS above FROM cu")
def _(t):
    d = t.logits.withColumn("p", A.softmax("logit"))
    d = d.withColumns({"below": A.p_below("p"), "above": A.p_above("p")})
    z = F.explode(F.arrays_zip("p", "below", "above", F.sequence(F.lit(0), F.size("p") - 1).alias("j")))
    return d.withColumn("_z", z).select(*PK, F.col("_z.j").alias("j"), *[F.round(f"_z.{c}", 9).alias(c) for c in ("p", "below", "above")])


@query(
    "a17_log_avg_exp", "samp",
    " SELECT transect_id, ping_index, round(max(logit) + ln(avg(exp(logit - mm))), 6) AS lae, round(2 * (max(logit) / 2 + ln(avg(exp(logit / 2 - mm / 2)))), 6) AS lae_t2, round(avg(logit), 6) AS mean FROM (SELECT *, max(logit) OVER (PARTITION BY transect_id, ping_index) AS mm FROM samp) GROUP BY 1, 2",
)
def _(t):
    return t.logits.select(
        *PK, F.round(A.log_avg_exp("logit"), 6).alias("lae"), F.round(A.log_avg_exp("logit", 2.0), 6).alias("lae_t2"), F.round(A.array_mean("logit"), 6).alias("mean"),
    )


@query(
    "w18_first_last_index", "samp",
    " SELECT transect_id, ping_index, CAST(coalesce(min(CASE WHEN logit > 2.5 THEN j END), -1) AS INT) AS first, CAST(coalesce(max(CASE WHEN logit > 2.5 THEN j END), -1) AS INT) AS last FROM samp GROUP BY 1, 2",
)
def _(t):
    f = A.above("logit", 2.5)
    return t.logits.select(*PK, A.first_index(f).alias("first"), A.last_index(f).alias("last"))


_LINE = _PR.replace("ORDER BY j)", "ORDER BY depth)").replace("ORDER BY j DESC)", "ORDER BY depth DESC)") + """,
ln AS (SELECT transect_id, ping_index, coalesce(max(CASE WHEN above > 0.5 THEN depth END), max(depth)) AS upper_line, coalesce(min(CASE WHEN below > 0.5 THEN depth END), max(depth)) AS lower_line FROM cu GROUP BY 1, 2)"""


@query("w19_probability_to_line", "samp", _LINE + " SELECT transect_id, ping_index, upper_line, lower_line FROM ln")
def _(t):
    from ..operators import grid

    d = grid.face_down(t.logits, arrays=("sv", "logit")).withColumn("p", A.softmax("logit"))
    g = A.depth_grid("sv")
    return d.select(
        *PK, lines.line_from_probability(A.p_above("p"), "above", g).alias("upper_line"), lines.line_from_probability(A.p_below("p"), "below", g).alias("lower_line"),
    )


def _channels(t):
    """Ten channels per ping: the logits scaled by 1 - channel/20."""
    ch = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.transform("logit", lambda x: x * (1 - c / 20)))
    return t.logits.withColumn("logits", ch)


_U2 = """,
mx AS (SELECT *, max(logit) OVER (PARTITION BY transect_id, ping_index) AS mm FROM samp),
e AS (SELECT *, exp((logit - mm)) AS e0, exp((logit - mm) * 0.95::DOUBLE) AS e1, exp((logit - mm) * 0.75::DOUBLE) AS e5 FROM mx),
s AS (SELECT *, e0 / sum(e0) OVER q AS b0, e5 / sum(e5) OVER q AS b5, e1 / sum(e1) OVER q AS b1, ln(avg(exp((logit - mm) * 0.9::DOUBLE)) OVER q) + mm * 0.9::DOUBLE AS lr,
             ln(avg(exp((logit - mm) * 0.85::DOUBLE)) OVER q) + mm * 0.85::DOUBLE AS lp FROM e WINDOW q AS (PARTITION BY transect_id, ping_index)),
c AS (SELECT *, least(1, sum(b0) OVER u) AS bt, least(1, sum(b0) OVER d) AS abt, least(1, sum(b1) OVER u) AS bb, least(1, sum(b1) OVER d) AS ab, least(1, sum(b5) OVER u) AS bsf,
             1 / (1 + exp(-lr)) AS p_removed, 1 / (1 + exp(-lp)) AS p_passive, 1 / (1 + exp(-logit * 0.8::DOUBLE)) AS pa FROM s
      WINDOW u AS (PARTITION BY transect_id, ping_index ORDER BY j), d AS (PARTITION BY transect_id, ping_index ORDER BY j DESC)),
k AS (SELECT *, 0.5::DOUBLE * ((1 - abt) + bt) * 0.5::DOUBLE * ((1 - bb) + ab) * (1 - p_removed) * (1 - p_passive) * (1 - pa) AS p_keep,
             abt < 0.5 AND bb < 0.5 AND p_removed < 0.5 AND p_passive < 0.5 AND pa < 0.5 AS m_keep FROM c)"""


@query(
    "u2_probabilities", "samp",
    _U2 + " SELECT transect_id, ping_index, CAST(j AS INT) AS j, round(abt, 8) AS above_turbulence, round(bb, 8) AS below_bottom, round(p_removed, 8) AS p_removed, round(p_passive, 8) AS p_passive, round(pa, 8) AS p_patch FROM k",
)
def _(t):
    d = probs.probabilities(_channels(t))
    z = F.explode(F.arrays_zip("p_above_turbulence", "p_below_bottom", "p_patch", F.sequence(F.lit(0), F.size("sv") - 1).alias("j")))
    return d.withColumn("_z", z).select(
        *PK, F.col("_z.j").alias("j"), F.round("_z.p_above_turbulence", 8).alias("above_turbulence"), F.round("_z.p_below_bottom", 8).alias("below_bottom"),
        F.round("p_removed", 8).alias("p_removed"), F.round("p_passive", 8).alias("p_passive"), F.round("_z.p_patch", 8).alias("p_patch"),
    )


@query("w21_joint_keep", "samp", _U2 + " SELECT transect_id, ping_index, CAST(j AS INT) AS j, round(p_keep, 8) AS p_keep, m_keep AS mask_keep FROM k")
def _(t):
    d = probs.probabilities(_channels(t))
    z = F.explode(F.arrays_zip("p_keep", "mask_keep", F.sequence(F.lit(0), F.size("sv") - 1).alias("j")))
    return d.withColumn("_z", z).select(*PK, F.col("_z.j").alias("j"), F.round("_z.p_keep", 8).alias("p_keep"), F.col("_z.mask_keep").alias("mask_keep"))


@query("n8_facing_columns", "samp", " SELECT transect_id, ping_index, round(CASE WHEN is_upfacing THEN 1 / (1 + exp(-max(logit) * 0.5)) ELSE 1 / (1 + exp(-max(logit))) END, 8) AS p_top FROM samp GROUP BY transect_id, ping_index, is_upfacing")
def _(t):
    d = t.logits.withColumns({"p_top_upfacing": A.sigmoid(F.array_max("logit") * 0.5), "p_top_downfacing": A.sigmoid(F.array_max("logit"))})
    return d.select(*PK, F.round(probs.for_facing("p_top"), 8).alias("p_top"))


@query("n9_patch_choice", "samp", " SELECT transect_id, ping_index, round(sum(1 / (1 + exp(-logit * CASE WHEN is_upfacing THEN 0.55 ELSE 0.8 END))), 6) AS total FROM samp GROUP BY 1, 2")
def _(t):
    d = probs.probabilities(_channels(t))
    return d.select(*PK, F.round(A.array_sum(probs.patch_choice()), 6).alias("total"))


@query(
    "a20_label_loss", "samp",
    _U2 + """,
ix AS (SELECT transect_id, ping_index, least(63, count(*) FILTER (WHERE j * 0.5 + 0.25 < turbulence)) AS it, greatest(0, count(*) FILTER (WHERE j * 0.5 + 0.25 <= bottom) - 1) AS ib FROM samp GROUP BY 1, 2),
pp AS (SELECT k.transect_id, k.ping_index, any_value(is_upfacing) AS is_upfacing, any_value(is_passive) AS is_passive, any_value(surface >= bottom) AS bad, any_value(k.ping_index % 23 IN (5, 6, 7)) AS rem,
              max(CASE WHEN j = it THEN b0 END) AS pt, max(CASE WHEN j = ib THEN b1 END) AS pb, any_value(p_removed) AS r, any_value(p_passive) AS q,
              avg(-(CASE WHEN j % 9 = 0 THEN ln(pa) ELSE ln(1 - pa) END)) AS lpa FROM k JOIN ix USING (transect_id, ping_index) GROUP BY 1, 2)
SELECT transect_id, count(*) AS n_pings, round(avg((CASE WHEN bad OR rem THEN 0 ELSE -ln(pt) - ln(pb) END) - CASE WHEN rem THEN ln(r) ELSE ln(1 - r) END - CASE WHEN is_passive THEN ln(q) ELSE ln(1 - q) END + lpa), 6) AS loss FROM pp GROUP BY 1""",
)
def _(t):
    d = probs.probabilities(_channels(t)).withColumns(
        {"depth_start": F.lit(0.25), "depth_stop": F.lit(31.75), "is_passive": (F.col("ping_index") % 17).between(11, 14),
         "is_removed": (F.col("ping_index") % 23).isin(5, 6, 7), "mask_patches": F.transform("sv", lambda _, j: j % 9 == 0)}
    )
    d = lines.boundary_indices(lines.sane_labels(d)).withColumn("is_surrogate", F.lit(False))
    d = d.select(*PK, "is_upfacing", "is_bad_labels", "is_passive", "is_removed", "is_surrogate", "index_turbulence", "index_bottom", "mask_patches",
                 "p_boundary_turbulence", "p_boundary_bottom", "p_removed", "p_passive", "p_patch")
    r = probs.label_loss(d, group=KEY)
    return r.select("transect_id", "n_pings", F.round("loss", 6).alias("loss"))


# --- metrics ---

_SC = """,
g AS (SELECT sample_id, channel, stratum, count(*) AS n, count(*) FILTER (WHERE (pred > 0.5) = (target > 0.5)) AS hit, count(*) FILTER (WHERE pred > 0.5 AND target > 0.5) AS tp,
             count(*) FILTER (WHERE pred > 0.5) AS p, count(*) FILTER (WHERE target > 0.5) AS t FROM cells GROUP BY 1, 2, 3),
s1 AS (SELECT *, hit / n AS accuracy, CASE WHEN p = 0 THEN 1.0::DOUBLE ELSE tp / p END AS precision, CASE WHEN t = 0 THEN 1.0::DOUBLE ELSE tp / t END AS recall,
              CASE WHEN p + t - tp = 0 THEN 1.0::DOUBLE ELSE tp / (p + t - tp) END AS jaccard, p / n AS active_output, t / n AS active_target FROM g),
sc AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM s1)"""
_BY = ["sample_id", "channel", "stratum"]
_CR = list(metrics.CRITERIA)


def _scores(t):
    return metrics.mask_scores(t.cells, _BY)


for _id, _c in (("a3", ["accuracy"]), ("a4", ["precision"]), ("a5", ["recall"]), ("a6", ["f1", "jaccard", "active_output", "active_target"])):

    @query(f"{_id}_mask_{'_'.join(_c[:2])}", "cells", _SC + " SELECT sample_id, channel, stratum, n, " + ", ".join(f"round({c}, 9) AS {c}" for c in _c) + " FROM sc")
    def _(t, c=_c):
        return _scores(t).select(*_BY, "n", *[F.round(x, 9).alias(x) for x in c])


@query("a4_mask_precision_strict", "cells", _SC + " SELECT sample_id, channel, stratum, round(CASE WHEN p = 0 AND t > 0 THEN 0.0::DOUBLE ELSE precision END, 9) AS precision FROM sc")
def _(t):
    return metrics.mask_scores(t.cells, _BY, strict=True).select(*_BY, F.round("precision", 9).alias("precision"))


@query("a6_logit_scores", "cells", """,
g AS (SELECT sample_id, count(*) AS n, count(*) FILTER (WHERE pred - 0.45 > 0) AS p, count(*) FILTER (WHERE pred - 0.45 > 0 AND target > 0.5) AS tp, count(*) FILTER (WHERE target > 0.5) AS t FROM cells GROUP BY 1)
SELECT sample_id, n, round(p / n, 9) AS active_output, round(CASE WHEN p + t - tp = 0 THEN 1.0 ELSE tp / (p + t - tp) END, 9) AS jaccard FROM g""")
def _(t):
    d = t.cells.withColumn("pred", F.col("pred") - 0.45)
    r = metrics.mask_scores(d, ["sample_id"], logits=True)
    return r.select("sample_id", "n", F.round("active_output", 9).alias("active_output"), F.round("jaccard", 9).alias("jaccard"))


for _how, _f in (("mean", "avg"), ("sum", "sum")):

    @query(f"a6_reduced_{_how}", "cells", _SC + " SELECT channel, " + ", ".join(f"round({_f}({c}), 7) AS {c}" for c in _CR) + " FROM sc GROUP BY 1")
    def _(t, how=_how):
        return metrics.reduce_scores(_scores(t), ["channel"], how).select("channel", *[F.round(c, 7).alias(c) for c in _CR])


_PCT = {"accuracy", "precision", "recall", "active_output", "active_target"}
_MT = ", ".join(f"round({100 if c in _PCT else 1} * sum({c} * n) / sum(n), 7) AS {c}" for c in _CR)


@query(
    "a13_meters", "cells",
    _SC + f" SELECT channel, '' AS stratum, count(*) AS n_values, {_MT} FROM sc GROUP BY 1 UNION ALL SELECT channel, stratum, count(*), {_MT} FROM sc GROUP BY 1, 2",
)
def _(t):
    m = metrics.meters(_scores(t), condition="stratum", weight="n")
    return m.select("channel", "stratum", "n_values", *[F.round(c, 7).alias(c) for c in _CR])


@query(
    "a14_channel_cells", "samp",
    _U2 + """,
r AS (SELECT transect_id, ping_index, j, depth, turbulence, bottom, surface, is_passive, abt, bt, bb, ab, bsf, pa, p_removed, p_passive, m_keep,
             NOT is_passive AND NOT (ping_index % 23 IN (5, 6, 7)) AND NOT depth < turbulence AND NOT depth > bottom AND NOT (j % 9 = 0) AS keep FROM k),
l AS (SELECT transect_id, ping_index, 'overall' AS channel, m_keep::INT::DOUBLE AS pred, keep::INT::DOUBLE AS target FROM r
      UNION ALL SELECT transect_id, ping_index, 'turbulence', bt, 1 - (depth < turbulence)::INT FROM r
      UNION ALL SELECT transect_id, ping_index, 'surface', bsf, 1 - (depth < surface)::INT FROM r
      UNION ALL SELECT transect_id, ping_index, 'bottom', ab, 1 - (depth > bottom)::INT FROM r
      UNION ALL SELECT transect_id, ping_index, 'patch', pa, (j % 9 = 0)::INT FROM r
      UNION ALL SELECT transect_id, ping_index, 'removed', p_removed, (ping_index % 23 IN (5, 6, 7))::INT FROM r WHERE j = 0
      UNION ALL SELECT transect_id, ping_index, 'passive', p_passive, is_passive::INT FROM r WHERE j = 0)
SELECT transect_id, channel, count(*) AS n, round(avg(((pred > 0.5) = (target > 0.5))::INT), 9) AS accuracy, round(avg((target > 0.5)::INT), 9) AS active_target FROM l GROUP BY 1, 2""",
)
def _(t):
    from ..operators import masks

    d = probs.probabilities(_channels(t)).withColumns(
        {"is_passive": (F.col("ping_index") % 17).between(11, 14), "is_removed": (F.col("ping_index") % 23).isin(5, 6, 7), "mask_patches": F.transform("sv", lambda _, j: j % 9 == 0)}
    )
    d = masks.keep_mask(lines.line_masks(d))
    c = metrics.channel_cells(d)
    s = metrics.mask_scores(c, ["transect_id", "channel"])
    return s.select("transect_id", "channel", "n", F.round("accuracy", 9).alias("accuracy"), F.round("active_target", 9).alias("active_target"))


@query("a16_metric_correlation", "cells", _SC + " SELECT channel, count(*) AS n, round(corr(active_target, active_output), 7) AS corr FROM sc GROUP BY 1")
def _(t):
    return metrics.correlation(_scores(t), by=["channel"]).select("channel", "n", F.round("corr", 7).alias("corr"))


@query(
    "s18_wide_metrics", "cells",
    _SC.replace(", stratum, count(*) AS n,", ", '' AS stratum, count(*) AS n,").replace("GROUP BY 1, 2, 3", "GROUP BY 1, 2")
    + " SELECT sample_id, " + ", ".join(f"round(max(CASE WHEN channel = '{ch}' THEN {c} END), 7) AS {ch}_{c}" for ch in "ANR" for c in ("accuracy", "jaccard")) + " FROM sc GROUP BY 1",
)
def _(t):
    s = metrics.mask_scores(t.cells, ["sample_id", "channel"])
    w = metrics.wide_metrics(s, ["sample_id"], ["A", "N", "R"], ("accuracy", "jaccard"))
    from ..session import scratch

    path = scratch(t.spark, "metrics")
    metrics.write_metrics_csv(w, path)
    back = t.spark.read.option("header", True).schema(w.schema).csv(path)
    return back.select("sample_id", *[F.round(c, 7).alias(c) for c in back.columns if c != "sample_id"])


# --- random, splits, augmentation ---


def _u(seed, keys, draw):
    k = " || '|' || ".join(f"CAST({x} AS VARCHAR)" for x in keys)
    return f"(CAST('0x' || substr(md5('{seed}|' || {k} || '|{draw}'), 1, 8) AS UBIGINT) / 4294967296.0::DOUBLE)"


def _h(seed, keys, draw):
    k = " || '|' || ".join(f"CAST({x} AS VARCHAR)" for x in keys)
    return f"md5('{seed}|' || {k} || '|{draw}')"


@query("r1_uniform_draw", "series", f" SELECT transect_id, ping_index, round({_u(7, ['transect_id', 'ping_index'], 'u')}, 9) AS u, round(exp(ln(2.0) * (2 * {_u(7, ['transect_id'], 's')} - 1)), 9) AS scale FROM series")
def _(t):
    return t.series.select(*PK, F.round(sampling.uniform(7, PK), 9).alias("u"), F.round(sampling.log_uniform_scale(sampling.uniform(7, KEY, "s"), 2.0), 9).alias("scale"))


@query(
    "r2_split", "files",
    f", r AS (SELECT path, row_number() OVER (ORDER BY {_h(1, ['path'], 'shuffle')}) - 1 AS r, count(*) OVER () AS n FROM files), k AS (SELECT *, CAST(round_even(n * 0.1::DOUBLE, 0) AS BIGINT) AS k FROM r) SELECT path, CASE WHEN r < n - 2 * k THEN 'train' WHEN r < n - k THEN 'test' ELSE 'validate' END AS part FROM k",
)
def _(t):
    return sampling.split(t.files.select("path"), ["path"], 1)


@query(
    "r3_group_split", "files",
    f", g AS (SELECT DISTINCT survey FROM files), r AS (SELECT survey, row_number() OVER (ORDER BY {_h(1, ['survey'], 'shuffle')}) - 1 AS r, count(*) OVER () AS n FROM g), k AS (SELECT *, CAST(floor(n * 0.1::DOUBLE + 1e-9) AS BIGINT) AS k FROM r) SELECT path, survey, CASE WHEN r < n - 2 * k THEN 'train' WHEN r < n - k THEN 'test' ELSE 'validate' END AS part FROM files JOIN k USING (survey)",
)
def _(t):
    return sampling.group_split(t.files.select("path", "survey"), "survey", 1).select("path", "survey", "part")


@query(
    "r4_stratified_split", "files",
    f", b AS (SELECT *, survey LIKE '%1' AS lo, tide = 'de' AS s FROM files), r AS (SELECT path, s, row_number() OVER (PARTITION BY s ORDER BY {_h(1, ['path'], 'shuffle')}) - 1 AS r, count(*) OVER (PARTITION BY s) AS n FROM b WHERE NOT lo), k AS (SELECT *, CAST(floor(n * 0.1::DOUBLE + 1e-9) AS BIGINT) AS k FROM r) SELECT path, CASE WHEN r < n - 2 * k THEN 'train' WHEN r < n - k THEN 'test' ELSE 'validate' END AS part FROM k UNION ALL SELECT path, 'leaveout' FROM b WHERE lo",
)
def _(t):
    return sampling.stratified_split(t.files, ["path"], F.col("survey").endswith("1"), F.col("tide") == "de", 1).select("path", "part")


@query(
    "r5_reflect_time", "series",
    f", l AS (SELECT *, max(ping_index) OVER (PARTITION BY transect_id) AS last FROM series) SELECT transect_id, CASE WHEN {_u(3, ['transect_id'], 'reflect')} <= 0.5 THEN last - ping_index ELSE ping_index END AS ping_index, signal FROM l",
)
def _(t):
    return sampling.reflect_time(t.series, 3).select(*PK, "signal")


@query(
    "r6_colour_jitter", "samp",
    f", d AS (SELECT *, -0.5 + 1.0 * {_u(5, ['transect_id'], 'brightness')} AS b, 0.7 + 0.6 * {_u(5, ['transect_id'], 'contrast')} AS c, {_u(5, ['transect_id'], 'order')} < 0.5 AS f FROM samp) SELECT transect_id, ping_index, CAST(j AS INT) AS j, round(CASE WHEN f THEN (v + b) * c ELSE v * c + b END, 6) AS v FROM d",
)
def _(t):
    return sampling.colour_jitter(t.echo, 5, 0.5, 0.3).select(*PK, F.posexplode("sv").alias("j", "v")).withColumn("v", F.round("v", 6))


@query(
    "r7_crop_width", "series",
    f", l AS (SELECT *, count(*) OVER (PARTITION BY transect_id) AS n FROM series), a AS (SELECT *, {_u(9, ['transect_id'], 'width')} * 0.5::DOUBLE * n AS amt FROM l) SELECT transect_id, CAST(ping_index - floor(amt / 2) AS BIGINT) AS ping_index, signal FROM a WHERE ping_index >= floor(amt / 2) AND ping_index < floor(amt / 2) + n - floor(amt)",
)
def _(t):
    return sampling.crop_width(t.series, 9, 0.5).select(*PK, "signal")


_R8 = f""",
g AS (SELECT transect_id, any_value(is_upfacing) AS up, min(bottom) AS bmin, max(turbulence) AS tmax, min(CASE WHEN surface > 0.25 THEN surface END) AS smin, max(bottom) AS bmax,
             quantile_cont(turbulence, 0.25) AS t25, quantile_cont(turbulence, 0.5) AS t50, quantile_cont(bottom, 0.5) AS b50 FROM echo GROUP BY 1),
a AS (SELECT *, greatest(0.75::DOUBLE, bmin - 0.5) AS td, least(31.25::DOUBLE, greatest(tmax, bmin)) AS bs, CASE WHEN up THEN greatest(0.25::DOUBLE, coalesce(smin, 0.25::DOUBLE)) ELSE 0.25::DOUBLE END AS ot, CASE WHEN up THEN 31.75::DOUBLE ELSE bmax END AS ob,
             CASE WHEN up THEN coalesce(smin, 0.25::DOUBLE) ELSE 0.25::DOUBLE END - 2.5::DOUBLE AS olo, CASE WHEN up THEN 31.75::DOUBLE ELSE bmax END + 2.5::DOUBLE AS ohi FROM g),
b AS (SELECT *, 0.25::DOUBLE * abs(ob - ot) AS gr, abs(ob - ot) * 0.25::DOUBLE / 1.25::DOUBLE AS sh FROM a),
c AS (SELECT *, least(td, greatest(0.25::DOUBLE, ot - gr)) AS ct0, least(td, ot + sh, t25) AS ct1, least(31.75::DOUBLE, CASE WHEN up THEN greatest(bs, ob - sh) ELSE greatest(bs, ob - sh, b50) END) AS cb0, least(31.75::DOUBLE, greatest(bs, ob) + gr) AS cb1,
             greatest(0.25::DOUBLE, least(td, greatest(t50, ot + sh))) AS rt1 FROM b),
d AS (SELECT *, least(31.75::DOUBLE, CASE WHEN up THEN cb0 ELSE greatest(bs, b50) END) AS rb0, {_u(11, ['transect_id'], 'branch')} AS br, {_u(11, ['transect_id'], 'top')} AS ut, {_u(11, ['transect_id'], 'low')} AS ul, {_u(11, ['transect_id'], 'grow-top')} AS gt, {_u(11, ['transect_id'], 'grow-low')} AS gl, {_u(11, ['transect_id'], 'near-side')} AS ns FROM c),
e AS (SELECT *, CASE WHEN br < 0.1 THEN 'none' WHEN br - 0.1::DOUBLE - 0.1::DOUBLE < 0 THEN 'optimal' WHEN br - 0.1::DOUBLE - 0.1::DOUBLE < 0.4 THEN 'close' ELSE 'random' END AS branch FROM d),
f AS (SELECT *, CASE WHEN branch IN ('close', 'random') AND (ct0 > ct1 OR cb0 > cb1 OR ct1 >= cb0 OR 0.25 > rt1 OR rb0 > 31.75 OR rt1 >= rb0) THEN 'limits contradict each other' END AS error FROM e)
SELECT transect_id, branch, error,
  round(CASE WHEN error IS NOT NULL OR branch = 'none' THEN NULL WHEN branch = 'optimal' THEN olo WHEN branch = 'close' THEN CASE WHEN gt < 0.5 THEN ct0 + (ot - ct0) * ut ELSE ot + (ct1 - ot) * ut END WHEN up OR ns < 0.5 THEN 0.25 + (rt1 - 0.25) * ut ELSE ot END, 6) AS crop_lo,
  round(CASE WHEN error IS NOT NULL OR branch = 'none' THEN NULL WHEN branch = 'optimal' THEN ohi WHEN branch = 'close' THEN CASE WHEN gl < 0.5 THEN cb0 + (ob - cb0) * ul ELSE ob + (cb1 - ob) * ul END WHEN NOT up OR ns < 0.5 THEN rb0 + (31.75 - rb0) * ul ELSE ob END, 6) AS crop_hi FROM f"""


@query("r8_random_depth_crop", "echo", _R8)
def _(t):
    r = sampling.random_depth_limits(t.lined, 11)
    return r.select("transect_id", "branch", "error", F.round("crop_lo", 6).alias("crop_lo"), F.round("crop_hi", 6).alias("crop_hi"))


@query(
    "r9_random_grid", "series",
    f""",
n AS (SELECT transect_id, count(*) AS n FROM series GROUP BY 1),
k AS (SELECT transect_id, n, unnest(range(0, 40)) AS k FROM n),
g AS (SELECT transect_id, {_u(13, ['transect_id', 'k'], 'x')} * (n - 1) AS x FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY transect_id ORDER BY x) - 1 AS i FROM g)
SELECT o.transect_id, i AS ping_index, round(x, 6) AS position, round(a.signal + (coalesce(b.signal, a.signal) - a.signal) * (x - floor(x)), 6) AS signal
FROM o JOIN series a ON a.transect_id = o.transect_id AND a.ping_index = floor(x) LEFT JOIN series b ON b.transect_id = o.transect_id AND b.ping_index = floor(x) + 1""",
)
def _(t):
    return sampling.resample_time(t.series, 13, 40).select(*PK, F.round("position", 6).alias("position"), F.round("signal", 6).alias("signal"))


@query("r9_elastic_grid")
def _(t):
    return sampling.resample_time(t.series, 13, 40, elastic=0.05, sigma=4.0).select(*PK, F.round("position", 6).alias("position"), F.round("signal", 6).alias("signal"))


@query("r10_order_choice", "series", f" SELECT DISTINCT transect_id, CASE WHEN {_u(4, ['transect_id'], 'order')} < 0.5 THEN 0 ELSE 1 END AS resample_order FROM series")
def _(t):
    return t.series.select("transect_id").distinct().withColumn("resample_order", sampling.order_choice(4, KEY))


@query(
    "t2_interleave", "files",
    f", r AS (SELECT path, survey, row_number() OVER (PARTITION BY survey ORDER BY {_h(2, ['path'], 'shuffle')}) - 1 AS r, count(*) OVER (PARTITION BY survey) AS n FROM files) SELECT path, survey, row_number() OVER (ORDER BY (r + 0.5::DOUBLE) / n, survey) - 1 AS position FROM r",
)
def _(t):
    return sampling.interleave(t.files.select("path", "survey"), "survey", ["path"], 2).select("path", "survey", "position")


@query(
    "t3_evenly_spaced", "files",
    f", r AS (SELECT path, survey, row_number() OVER (PARTITION BY survey ORDER BY {_h(2, ['path'], 'shuffle')}) - 1 AS r, count(*) OVER (PARTITION BY survey) AS n FROM files), p AS (SELECT path, row_number() OVER (ORDER BY (r + 0.5::DOUBLE) / n, survey) - 1 AS position FROM r) SELECT path, position FROM p WHERE position % 7 = 0 AND position < 224",
)
def _(t):
    d = sampling.interleave(t.files.select("path", "survey"), "survey", ["path"], 2)
    return sampling.evenly_spaced(d, "position", 7).select("path", "position")


@query(
    "t4_named_head", "files",
    f", r AS (SELECT path, row_number() OVER (ORDER BY {_h(1, ['path'], 'shuffle')}) - 1 AS r, count(*) OVER () AS n FROM files), k AS (SELECT *, CAST(round_even(n * 0.1::DOUBLE, 0) AS BIGINT) AS k FROM r) SELECT path, 'validate1' AS part FROM k WHERE r >= n - k ORDER BY path LIMIT 1",
)
def _(t):
    d = sampling.split(t.files.select("path"), ["path"], 1).where("part = 'validate'")
    return sampling.head_of(d, ["path"]).select("path", F.lit("validate1").alias("part"))
