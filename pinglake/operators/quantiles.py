"""Exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BLOCK, value_block


def quantiles(df: DataFrame, key: Sequence[str], value: str, probs: Sequence[float], out: str = "q",
              rows: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles per group, as one array column in the order of ``probs``.

    ``percentile`` keeps every distinct value of a group in one buffer. Here each group is
    counted over slices of its value range (pre-aggregated before the shuffle), and only
    the slices that hold a wanted rank are sorted. NULLs are left out.
    """
    v = df.select(*key, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    b = value_block(v, key, "_v", rows)
    hist = b.groupBy(*key, BLOCK).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*key)
    hist = hist.select(
        *key,
        BLOCK,
        "_c",
        (F.sum("_c").over(w.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_before"),
        F.sum("_c").over(w).alias("_n"),
    )
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    pos = F.transform(wanted, lambda p: p * (F.col("_n") - 1))
    ranks = F.array_distinct(
        F.concat(F.transform(pos, lambda p: F.floor(p).cast("long")), F.transform(pos, lambda p: F.ceil(p).cast("long")))
    )
    hist = hist.withColumn(
        "_ranks", F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_c")))
    ).where(F.size("_ranks") > 0)
    picked = (
        b.join(hist.drop("_c"), [*key, BLOCK])
        .groupBy(*key, BLOCK, "_v")
        .agg(F.count(F.lit(1)).alias("_c"), F.first("_before").alias("_before"), F.first("_n").alias("_n"),
             F.first("_ranks").alias("_ranks"))
    )
    run = Window.partitionBy(*key, BLOCK).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    picked = picked.withColumn("_hi", F.col("_before") + F.sum("_c").over(run)).select(
        *key,
        "_n",
        "_v",
        F.explode(
            F.filter("_ranks", lambda r: (r >= F.col("_hi") - F.col("_c")) & (r < F.col("_hi")))
        ).alias("_r"),
    )
    # At most two ranks per wanted quantile reach this aggregate.
    m = picked.groupBy(*key).agg(
        F.first("_n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_m")
    )

    def one(p):
        x = p * (F.col("_n") - 1)
        lo = F.try_element_at("_m", F.floor(x).cast("long"))
        hi = F.try_element_at("_m", F.ceil(x).cast("long"))
        return lo + (hi - lo) * (x - F.floor(x))

    return m.select(*key, F.transform(wanted, one).alias(out), F.col("_n").alias("_count"))
