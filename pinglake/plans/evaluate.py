"""Agreement of predictions with labels over whole recordings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import metrics
from ..session import cut
from .decompose import evaluation_labels
from .scoring import score_to_lines

KEY = ["transect_id"]


def evaluate(labelled: DataFrame, load: Callable, max_depth: float | None = None, max_pings: int | None = None, **options) -> DataFrame:
    """Every criterion per recording and channel.

    Labels are cut as evaluation does, the model sees the same pings, and predictions are
    matched to labels by ping.
    """
    lab = cut(evaluation_labels(labelled, max_pings, max_depth), "labels")
    # Every recording keeps its own grid, so that predictions meet labels cell by cell.
    pred = score_to_lines(lab, load, autocrop=1, height=None, **options)
    p = pred.select(*KEY, "ping_index", *[c for c in pred.columns if c.startswith(("p_", "mask_keep"))])
    lab = lab.select(*KEY, "ping_index", "is_upfacing", "is_passive", "is_removed", "mask", "mask_turbulence", "mask_bottom", "mask_surface", "mask_patches")
    cells = metrics.channel_cells(lab.join(p, [*KEY, "ping_index"]))
    return metrics.mask_scores(cells, [*KEY, "is_upfacing", "channel"])
