"""Recordings stored in shards of a fixed number of pings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import crop_depth
from ..operators.segments import SHARD, read_ranges, split_gaps


def shard(df: DataFrame, max_depth: float | None = None, shard_len: int = SHARD, arrays: Sequence[str] = ("sv",), idx: str = "ping_index",
          halve: Sequence[str] = ("turbulence", "bottom")) -> DataFrame:
    """Shard number per ping, deep cells dropped from every array, signal and lines as 32-bit floats."""
    d = crop_depth(df, None, max_depth, arrays) if max_depth is not None else df
    d = d.withColumn("shard", F.floor(F.col(idx) / shard_len).cast("long"))
    d = d.withColumn("sv", F.transform("sv", lambda x: x.cast("float")))
    return d.withColumns({c: F.col(c).cast("float") for c in halve if c in d.columns})


def write_shards(df: DataFrame, path: str, dataset: str, max_depth: float | None = None, shard_len: int = SHARD, arrays: Sequence[str] = ("sv",),
                 mode: str = "errorifexists", key: Sequence[str] = ("transect_id",)) -> None:
    """Segment at recording gaps and store; the index restarts in each segment.

    Files are ranged by recording, segment and shard, so a ping range touches few row
    groups however long the recording is.
    """
    d = split_gaps(df, key=key)
    first = d.groupBy(*key, "segment_id").agg(F.min("ping_index").alias("_a"))
    d = d.join(first, [*key, "segment_id"]).withColumn("ping_index", F.col("ping_index") - F.col("_a")).drop("_a")
    d = shard(d, max_depth, shard_len, arrays).withColumn("dataset", F.lit(dataset))
    d.repartitionByRange(*key, "segment_id", "shard").sortWithinPartitions(*key, "segment_id", "shard", "ping_index").write.mode(mode).partitionBy(
        "dataset"
    ).parquet(path)


def read_shards(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    d = spark.read.parquet(path)
    return d.where(F.col("dataset") == dataset) if dataset else d


def read_range(spark: SparkSession, path: str, ranges: DataFrame, mode: str = "edge", key: Sequence[str] = ("transect_id", "segment_id")) -> DataFrame:
    """Pings [i1, i2) of stored segments, extended beyond their ends by ``mode``."""
    return read_ranges(read_shards(spark, path), ranges, mode, key)
