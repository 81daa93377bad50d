"""Putting data sets together and taking them apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SETTINGS = {"max_depth": "double", "offset_turbulence": "double", "offset_bottom": "double", "remove_nearfield": "boolean", "nearfield_distance": "double"}


def concat(parts: Sequence[tuple[DataFrame, dict]]) -> DataFrame:
    """Data sets one after the other, each copy with its own cleaning settings as columns."""
    out = None
    for i, (d, settings) in enumerate(parts):
        d = d.withColumn("copy", F.lit(i + 1))
        for k, typ in SETTINGS.items():
            d = d.withColumn(k, F.lit(settings.get(k)).cast(typ))
        out = d if out is None else out.unionByName(d)
    return out


def merge_partitions(parts: dict[str, DataFrame]) -> DataFrame:
    """Equally named partitions of sub data sets, with the sub data set as column ``sub``."""
    out = None
    for name, d in parts.items():
        d = d.withColumn("sub", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out


def leave_out(df: DataFrame, col: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose name matches, and the rest."""
    hit = F.coalesce(F.col(col).rlike(pattern), F.lit(False))
    return df.where(hit), df.where(~hit)
