"""Agreement between predicted and target masks, and the meters that collect it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A

CRITERIA = ("accuracy", "precision", "recall", "f1", "jaccard", "active_output", "active_target")


def _ratio(num, den, empty) -> Column:
    return F.when(den == 0, F.lit(float(empty))).otherwise(num / F.nullif(den, F.lit(0)))


def mask_scores(df: DataFrame, by: Sequence[str], pred: str = "pred", target: str = "target", threshold: float = 0.5,
                logits: bool = False, strict: bool = False) -> DataFrame:
    """All mask criteria per sample in one aggregation over cells.

    Precision without predicted positives is 1, or with ``strict`` 0 if there was something
    to find. Recall with nothing to find is 1; F1 with both 0 is 0; Jaccard of two empty
    masks is 1. With ``logits`` the prediction goes through a sigmoid first.
    """
    p = (A.sigmoid(pred) if logits else F.col(pred)) > threshold
    t = F.col(target).cast("double") > threshold
    g = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(p == t).alias("_hit"),
        F.count_if(p & t).alias("_tp"),
        F.count_if(p).alias("_p"),
        F.count_if(t).alias("_t"),
    )
    tp, pp, tt, n = (F.col(c).cast("double") for c in ("_tp", "_p", "_t", "n"))
    none_found = F.when(tt > 0, 0.0).otherwise(1.0) if strict else F.lit(1.0)
    precision = F.when(pp == 0, none_found).otherwise(tp / F.nullif(pp, F.lit(0.0)))
    recall = _ratio(tp, tt, 1)
    union = pp + tt - tp
    g = g.withColumns({"precision": precision, "recall": recall})
    s = F.col("precision") + F.col("recall")
    return g.withColumns(
        {
            "accuracy": F.col("_hit") / n,
            "f1": _ratio(2 * F.col("precision") * F.col("recall"), s, 0),
            "jaccard": _ratio(tp, union, 1),
            "active_output": pp / n,
            "active_target": tt / n,
        }
    ).drop("_hit", "_tp", "_p", "_t")


def reduce_scores(scores: DataFrame, by: Sequence[str] = (), how: str = "mean", criteria: Sequence[str] = CRITERIA) -> DataFrame:
    """Mean or sum of per-sample scores; ``none`` leaves them as they are."""
    if how == "none":
        return scores
    fn = {"mean": F.avg, "sum": F.sum}[how]
    return scores.groupBy(*by).agg(*[fn(c).alias(c) for c in criteria])


def channel_cells(df: DataFrame, cond: str = "") -> DataFrame:
    """Prediction and target of every channel in long form, one row per ping and channel.

    Overall compares keep masks; turbulence and surface the cells below their line; bottom
    the cells above; removed and passive one value per ping; patch the patch masks. A
    prediction and a target of different sizes are an error.
    """
    inv = lambda c: F.transform(c, lambda x: 1 - x.cast("double"))
    dbl = lambda c: F.transform(c, lambda x: x.cast("double"))
    one = lambda c: F.array(F.col(c).cast("double"))

    def paired(p, t):
        z = F.arrays_zip(p.alias("pred"), t.alias("target"))
        bad = F.raise_error(F.concat(F.lit("prediction of "), F.size(p).cast("string"), F.lit(" cells, target of "), F.size(t).cast("string")))
        return F.when(F.size(p) == F.size(t), z).otherwise(bad.cast("array<struct<pred:double,target:double>>"))

    spec = {
        "overall": (dbl(f"mask_keep{cond}"), dbl("mask")),
        "turbulence": (F.col(f"p_below_turbulence{cond}"), inv("mask_turbulence")),
        "surface": (F.col(f"p_below_surface{cond}"), inv("mask_surface")),
        "bottom": (F.col(f"p_above_bottom{cond}"), inv("mask_bottom")),
        "removed": (one(f"p_removed{cond}"), one("is_removed")),
        "passive": (one(f"p_passive{cond}"), one("is_passive")),
        "patch": (F.col(f"p_patch{cond}"), dbl("mask_patches")),
    }
    used = {p for p in ("mask_keep", "p_below_turbulence", "p_below_surface", "p_above_bottom", "p_removed", "p_passive", "p_patch")}
    drop = [c for c in df.columns if c.startswith(("p_", "mask")) or c.rstrip(cond) in used]
    rows = F.array(
        *[F.struct(F.lit(k).alias("channel"), paired(p, t).alias("cells")) for k, (p, t) in spec.items()]
    )
    d = df.withColumn("_r", F.explode(rows)).drop(*drop)
    d = d.withColumn("channel", F.col("_r.channel")).withColumn("_c", F.explode("_r.cells"))
    return d.withColumns({"pred": F.col("_c").getField("pred"), "target": F.col("_c").getField("target")}).drop("_r", "_c")


def meters(scores: DataFrame, channel: str = "channel", condition: str = "facing", weight: str | None = None,
           criteria: Sequence[str] = CRITERIA) -> DataFrame:
    """Running meters: weighted mean of per-sample scores per channel, overall and by condition.

    One aggregation with grouping sets; the condition is '' for the unconditional meter.
    Accuracy, precision, recall and active fractions are percentages.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    d = scores.withColumn("_w", w)
    g = d.groupingSets([[F.col(channel)], [F.col(channel), F.col(condition)]], F.col(channel), F.col(condition))
    pct = {"accuracy", "precision", "recall", "active_output", "active_target"}
    aggs = [
        ((100.0 if c in pct else 1.0) * F.sum(F.col(c) * F.col("_w")) / F.sum(F.when(F.col(c).isNotNull(), F.col("_w")))).alias(c)
        for c in criteria
    ]
    out = g.agg(*aggs, F.count(F.lit(1)).alias("n_values"), F.grouping(condition).alias("_g"))
    return out.withColumn(condition, F.when(F.col("_g") == 1, F.lit("")).otherwise(F.col(condition))).drop("_g")


def wide_metrics(scores: DataFrame, sample: Sequence[str], channels: Sequence[str], criteria: Sequence[str] = CRITERIA) -> DataFrame:
    """One column per channel and criterion, one row per sample."""
    # The pivot values are given, so no pass over the data is needed to find them.
    p = scores.groupBy(*sample).pivot("channel", list(channels)).agg(*[F.first(c).alias(c) for c in criteria])
    return p


def write_metrics_csv(wide: DataFrame, path: str, mode: str = "errorifexists") -> None:
    wide.write.mode(mode).option("header", True).csv(path)


def correlation(scores: DataFrame, a: str = "active_target", b: str = "active_output", by: Sequence[str] = ()) -> DataFrame:
    return scores.groupBy(*by).agg(F.corr(a, b).alias("corr"), F.count(F.lit(1)).alias("n"))
