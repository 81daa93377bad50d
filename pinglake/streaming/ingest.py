"""Incremental ingest: each ping export is read once, however often ingest runs."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from ..sources.pings import good, headers, parse_pings, quarantine, read_text


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, pattern: str = "*.txt", files_per_batch: int = 10_000) -> None:
    """Read the files not seen before, append their pings, and stop.

    The file source remembers what it has read in the checkpoint. A batch writes below its
    own number and replaces what an interrupted attempt may have left, so a retry adds
    nothing twice. Rows are parsed once and stored apart, good ones and unreadable ones.
    Part files may come in different batches; a batch looks up headers that it lacks in the
    source, so the first part of a text must be there when another one is ingested.
    """
    rows = (
        spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch)
        .text(source).select("value", F.col("_metadata.file_path").alias("file"))
    )

    def store(batch: DataFrame, number: int) -> None:
        # A file is never split over batches, but the part files of a text may be.
        heads = cut(headers(batch), "headers")
        lack = [r["_text"] for r in heads.where(F.col("_h").isNull() & F.col("_text").contains("/part-*-")).select("_text").collect()]  # at most a batch's files
        if lack:
            # The column holds URIs; a reader takes patterns.
            found = [re.sub(r"([][{}?*\\])", r"\\\1", unquote(p.rpartition("/part-*-")[0])) + "/part-*-" + p.rpartition("/part-*-")[2] for p in lack]
            more = headers(read_text(spark, found)).where(F.col("_h").isNotNull())
            heads = cut(heads.where(F.col("_h").isNotNull()).unionByName(more), "headers")
        kind = F.when(F.col("error").isNull(), "pings").otherwise("quarantine")
        parse_pings(batch, heads).withColumn("kind", kind).write.mode("overwrite").partitionBy("kind").parquet(f"{target}/batches/batch={number}")

    q = rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def ingested(spark: SparkSession, target: str) -> DataFrame:
    return good(spark.read.parquet(f"{target}/batches").where("kind = 'pings'").drop("kind", "batch"))


def rejected(spark: SparkSession, target: str) -> DataFrame:
    """Rows that did not read, with their file and error."""
    return quarantine(spark.read.parquet(f"{target}/batches").where("kind = 'quarantine'"))


def session_segments(stream: DataFrame, gap: str, ts: str = "ts", key: str = "transect_id", late: str = "1 hour") -> DataFrame:
    """Segments with a fixed gap on a stream.

    An approximation of splitting at recording gaps: the batch operator derives its gap
    from the whole recording, which a stream has not seen.
    """
    return stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n_pings")).select(
        key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_pings"
    )
