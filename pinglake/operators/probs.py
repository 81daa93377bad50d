"""Probabilities from raw model outputs, and the labels' log-loss."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A

# The position of each output in a model's channel list.
CHANNELS = {
    "turbulence": 0,
    "bottom": 1,
    "removed": 2,
    "passive": 3,
    "patch": 4,
    "surface": 5,
    "turbulence_original": 6,
    "bottom_original": 7,
    "patch_original": 8,
    "patch_ntob": 9,
}
UPPER = ("turbulence", "turbulence_original", "surface")
LOWER = ("bottom", "bottom_original")
FLAGS = ("removed", "passive")
PATCHES = ("patch", "patch_original", "patch_ntob")
CONDITIONS = ("", "_downfacing", "_upfacing")


def reduce_depth(logit, how: str = "logavgexp", temperature: float | None = None) -> Column:
    """One logit per ping from one per cell."""
    if how == "mean":
        return A.array_mean(logit)
    if how in ("logavgexp", "lae"):
        return A.log_avg_exp(logit, temperature)
    raise ValueError(f"unknown reduction {how!r}")


def probabilities(df: DataFrame, top: str = "boundary", bottom: str = "boundary", reduce_removed: str = "logavgexp",
                  reduce_passive: str = "logavgexp", conditional: bool = False, logits: str = "logits",
                  channels_per_condition: int | None = None) -> DataFrame:
    """Probability columns from ``logits``, an array of per-cell arrays, one per channel.

    ``top``/``bottom`` say whether line channels are ``boundary`` logits (softmax along
    depth, then running sums) or ``mask`` logits (sigmoid). A conditional model repeats
    the channels for downfacing and upfacing input, in columns with that suffix. Adds
    ``p_keep`` and ``mask_keep``. The name ``top`` is an alias of ``turbulence``.
    """
    out = df
    per = channels_per_condition or len(CHANNELS)
    for i, cond in enumerate(CONDITIONS if conditional else CONDITIONS[:1]):
        def ch(name, off=i * per):
            return F.get(logits, F.lit(CHANNELS[name] + off))

        cols = {}
        for name in (*UPPER, *LOWER):
            mode = top if name in UPPER else bottom
            if mode == "boundary":
                cols[f"p_boundary_{name}{cond}"] = A.softmax(ch(name))
            elif mode == "mask":
                main, other = ("above", "below") if name in UPPER else ("below", "above")
                cols[f"p_{main}_{name}{cond}"] = F.transform(ch(name), A.sigmoid)
                cols[f"p_{other}_{name}{cond}"] = F.transform(ch(name), lambda x: 1 - A.sigmoid(x))
            else:
                raise ValueError(f"unknown output mode {mode!r}")
        for name, how in (("removed", reduce_removed), ("passive", reduce_passive)):
            cols[f"p_{name}{cond}"] = A.sigmoid(reduce_depth(ch(name), how))
        for name in PATCHES:
            cols[f"p_{name}{cond}"] = F.transform(ch(name), A.sigmoid)
        out = out.withColumns(cols)
        out = out.withColumns(
            {
                f"p_{side}_{name}{cond}": fn(f"p_boundary_{name}{cond}")
                for name in (*UPPER, *LOWER)
                if (top if name in UPPER else bottom) == "boundary"
                for side, fn in (("above", A.p_above), ("below", A.p_below))
            }
        )
        out = joint_keep(out, cond)
    return out


def joint_keep(df: DataFrame, cond: str = "") -> DataFrame:
    """Probability and decision that a cell is kept, from lines, flags and patches."""
    c = lambda n: F.col(f"p_{n}{cond}")
    flags = (1 - c("removed")) * (1 - c("passive"))

    def p(z):
        return A.clip(0.5 * ((1 - z["0"]) + z["1"]) * 0.5 * ((1 - z["3"]) + z["2"]) * flags * (1 - z["4"]), 0.0, 1.0)

    def m(z):
        return (z["0"] < 0.5) & (z["3"] < 0.5) & (c("removed") < 0.5) & (c("passive") < 0.5) & (z["4"] < 0.5)

    parts = F.arrays_zip(c("above_turbulence"), c("below_turbulence"), c("above_bottom"), c("below_bottom"), c("patch"))
    names = [f"p_{n}{cond}" for n in ("above_turbulence", "below_turbulence", "above_bottom", "below_bottom", "patch")]

    def pick(z):
        return {str(i): z[n] for i, n in enumerate(names)}

    return df.withColumns(
        {f"p_keep{cond}": F.transform(parts, lambda z: p(pick(z))), f"mask_keep{cond}": F.transform(parts, lambda z: m(pick(z)))}
    )


def for_facing(name: str, conditional: bool = True) -> Column:
    """The conditional column that matches the ping's facing."""
    if not conditional:
        return F.col(name)
    return F.when(F.col("is_upfacing"), F.col(f"{name}_upfacing")).otherwise(F.col(f"{name}_downfacing"))


def patch_choice(mode: str | None = None, cond: str = "") -> Column:
    """Patch probabilities to use: by default new-turbulence-old-bottom when upfacing, else merged."""
    if mode is None:
        return F.when(F.col("is_upfacing"), F.col(f"p_patch_ntob{cond}")).otherwise(F.col(f"p_patch{cond}"))
    return F.col(f"p_patch{cond}") if mode == "merged" else F.col(f"p_patch_{mode}{cond}")


# --- Evaluation of labels: log-loss values only, no gradients. ---

EPS = 1e-12


def cross_entropy(p_boundary, index) -> Column:
    """-log of the probability at the labelled boundary cell."""
    return -F.log(F.greatest(F.get(A.col(p_boundary), A.col(index).cast("int")), F.lit(EPS)))


def binary_loss(p, t) -> Column:
    p, t = A.col(p), A.col(t).cast("double")
    return -(t * F.log(F.greatest(p, F.lit(EPS))) + (1 - t) * F.log(F.greatest(1 - p, F.lit(EPS))))


def binary_loss_cells(p, t) -> Column:
    """Mean over the cells of a ping."""
    n = F.size(A.col(p))
    return A.array_sum(F.zip_with(A.col(p), A.col(t), lambda a, b: binary_loss(a, b))) / n


def label_loss(df: DataFrame, weights: dict[str, float] | None = None, by_facing: bool = False, conditional: bool = False,
               group: Sequence[str] = (), ignore_lines_during_passive: bool = False,
               ignore_lines_during_removed: bool = True, ignore_surface_during_passive: bool = False,
               ignore_surface_during_removed: bool = True) -> DataFrame:
    """Weighted mean log-loss of labels under predicted probabilities.

    Lines: cross-entropy at the label index over pings with sane labels; surface also not
    where the line is a surrogate. Excluded pings count as 0 and stay in the denominator.
    Weights: ``turbulence``, ``bottom``, ``surface``, ``removed``, ``passive``, ``patch``,
    ``overall`` and ``auxiliary``, a factor for the variants.

    With ``conditional`` the loss of every facing that occurs, computed on that facing's
    outputs and counted over all pings, joins the unconditional one, and the sum is halved
    when more than one is present.
    """
    w = {"turbulence": 1.0, "bottom": 1.0, "surface": 1.0, "removed": 1.0, "passive": 1.0, "patch": 1.0, "overall": 0.0, "auxiliary": 1.0}
    w |= weights or {}
    has = set(df.columns)
    good = (~F.col("is_bad_labels")).cast("double")

    def included(surface):
        g = good
        pas = ignore_surface_during_passive if surface else ignore_lines_during_passive
        rem = ignore_surface_during_removed if surface else ignore_lines_during_removed
        if pas:
            g = g * (1 - F.col("is_passive").cast("double"))
        if rem:
            g = g * (1 - F.col("is_removed").cast("double"))
        if surface:
            g = g * (1 - F.col("is_surrogate").cast("double"))
        return g

    def terms(cond):
        t = []
        for name in (*UPPER, *LOWER):
            base = name.split("_")[0]
            weight = w[base] * (w["auxiliary"] if name != base else 1.0)
            if weight and f"p_boundary_{name}{cond}" in has and f"index_{name}" in has:
                t.append(weight * cross_entropy(f"p_boundary_{name}{cond}", f"index_{name}") * included(base == "surface"))
        for name in FLAGS:
            if w[name] and f"p_{name}{cond}" in has:
                t.append(w[name] * binary_loss(f"p_{name}{cond}", f"is_{name}"))
        for name in PATCHES:
            weight = w["patch"] * (w["auxiliary"] if name != "patch" else 1.0)
            target = name.replace("patch", "mask_patches")
            if weight and f"p_{name}{cond}" in has and target in has:
                t.append(weight * binary_loss_cells(f"p_{name}{cond}", target))
        if w["overall"] and f"p_keep{cond}" in has:
            t.append(w["overall"] * binary_loss_cells(f"p_keep{cond}", "mask"))
        total = F.lit(0.0)
        for x in t:
            total = total + x
        return total

    loss = terms("")
    present = F.lit(1)
    if conditional:
        up = F.col("is_upfacing")
        loss = loss + F.when(up, terms("_upfacing")).otherwise(terms("_downfacing"))
        present = 1 + F.max(up.cast("int")) + F.max((~up).cast("int"))
    keys = [*group, *(["is_upfacing"] if by_facing else [])]
    d = df.withColumn("_loss", loss)
    halve = F.when(present > 1, 2).otherwise(1) if conditional else F.lit(1)
    return d.groupBy(*keys).agg((F.avg("_loss") / halve).alias("loss"), F.count(F.lit(1)).alias("n_pings"))
