"""The given tables read as recordings, lines, masks, metrics inputs and file inventories.

Each fixture exists twice: as a DataFrame (class ``Tables``) and as SQL common table
expressions (``CTE``), so that a query and its check start from the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.blocks import dense_index
from .session import ensure, prepare, scratch

KEY = ["transect_id"]


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.dir = sf_dir.rstrip("/")

    def _ingested(self, name: str, build) -> DataFrame:
        """A recording table with its ping index, stored once as an ingest would."""
        df = build()

        def write() -> str:
            path = scratch(self.spark, name)
            df.write.parquet(path)
            return path

        return self.spark.read.schema(df.schema).parquet(ensure(self.spark, (self.dir, name), write))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def series(self) -> DataFrame:
        """One scalar per ping, from ``events``."""
        e = self.read("events").select(
            F.col("user_id").alias("transect_id"),
            (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts_s"),
            "event_id",
            F.col("value").alias("signal"),
            (F.col("event_type") == "error").alias("is_passive"),
            (F.col("event_type") == "signup").alias("is_removed"),
        )
        return self._ingested("series", lambda: dense_index(e, KEY, ["ts_s", "event_id"]).drop("event_id"))

    @cached_property
    def _vectors(self) -> DataFrame:
        v = self.read("embeddings").select(F.col("label").cast("long").alias("transect_id"), "vec_id", "embedding")
        return self._ingested("vectors", lambda: dense_index(v, KEY, ["vec_id"]))

    @cached_property
    def echo(self) -> DataFrame:
        """64 samples per ping, from ``embeddings``."""
        return self._echo.drop("embedding")

    @cached_property
    def _echo(self) -> DataFrame:
        k = F.col("ping_index")
        up = F.col("transect_id") % 2 == 1
        quiet = F.when((k % 17).between(11, 14), 60).otherwise(0)
        return self._vectors.select(
            "transect_id",
            "ping_index",
            "vec_id",
            "embedding",
            (F.lit(1600000000.0) + F.col("transect_id") * 100000.0 + k * 1.0 + F.when(k >= 30, 600.0).otherwise(0.0)).alias("ts_s"),
            up.alias("is_upfacing"),
            F.when(up, 31.75).otherwise(0.25).alias("depth_start"),
            F.when(up, 0.25).otherwise(31.75).alias("depth_stop"),
            F.transform(
                "embedding",
                lambda e, j: F.when(
                    ~((j >= 38) & ((F.col("vec_id") * 31 + j * 17) % 97 == 0)),
                    F.lit(-80.0) + 100 * e.cast("double") - quiet,
                ),
            ).alias("sv"),
        )

    @cached_property
    def lined(self) -> DataFrame:
        """``echo`` with three line depths at every ping, and the raw embedding."""
        v = F.col("vec_id")
        return (
            self._echo.withColumn("surface", 1.0 + (v % 5) * 0.1)
            .withColumn("turbulence", 4.0 + (v % 11) * 0.5)
            .withColumn("bottom", 28.0 - (v % 7) * 0.5)
        )

    @cached_property
    def line_points(self) -> DataFrame:
        """The three lines on their own times: even pings, undefined at every 20th from 10."""
        k = F.col("ping_index")
        v = F.col("vec_id")
        bad = k % 20 == 10
        base = self._vectors.where(k % 2 == 0)
        return base.select(
            "transect_id",
            "ping_index",
            (F.lit(1600000000.0) + F.col("transect_id") * 100000.0 + k * 1.0 + F.when(k >= 30, 600.0).otherwise(0.0)).alias("ts_s"),
            F.when(~bad, 1.0 + (v % 5) * 0.1).alias("surface"),
            F.when(~bad, 4.0 + (v % 11) * 0.5).alias("turbulence"),
            F.when(~bad, 28.0 - (v % 7) * 0.5).alias("bottom"),
            F.lit(3).alias("status"),
        )

    @cached_property
    def masked(self) -> DataFrame:
        """``lined`` with the keep-mask of its masked copy and passive flag."""
        k = F.col("ping_index")
        n = F.size("sv")
        a, b = F.col("depth_start"), F.col("depth_stop")
        keep = F.transform(
            "sv",
            lambda x, j: (F.col("turbulence") < a + j * (b - a) / (n - 1))
            & (a + j * (b - a) / (n - 1) < F.col("bottom"))
            & ~F.col("is_passive")
            & ~(k % 23).isin(5, 6, 7)
            & ~(k.between(16, 19) & j.between(20, 26)),
        )
        return self.lined.drop("embedding").withColumn("is_passive", (k % 17).between(11, 14)).withColumn("mask", keep)

    @cached_property
    def order_lines(self) -> DataFrame:
        """Irregular line points per customer, from ``orders``."""
        return (
            self.read("orders")
            .select(
                F.col("o_custkey").alias("transect_id"),
                (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("ts_s"),
                (F.col("o_totalprice") / 10000).alias("depth"),
            )
            .groupBy("transect_id", "ts_s")
            .agg(F.min("depth").alias("depth"))
        )

    @cached_property
    def cells(self) -> DataFrame:
        """Predicted and target mask cells, from ``lineitem``."""
        return self.read("lineitem").select(
            F.col("l_suppkey").alias("sample_id"),
            F.col("l_returnflag").alias("channel"),
            F.col("l_linestatus").alias("stratum"),
            (F.col("l_discount") / 0.1).alias("pred"),
            (F.col("l_tax") > 0.04).cast("double").alias("target"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line_no"),
        )

    @cached_property
    def logits(self) -> DataFrame:
        """Stand-in model output: one logit per cell."""
        return self.lined.withColumn("logit", F.transform("embedding", lambda e: 10 * e.cast("double"))).drop("embedding")

    @cached_property
    def files(self) -> DataFrame:
        """File inventory, from ``documents``."""
        return self.read("documents").select(
            "doc_id",
            F.concat("source", F.lit("/"), "lang", F.lit("_"), F.col("doc_id").cast("string")).alias("path"),
            F.col("source").alias("survey"),
            F.col("lang").alias("tide"),
            F.col("n_chars").alias("width"),
        )

    @cached_property
    def outputs(self) -> DataFrame:
        """Outputs that exist already: one per labelled document."""
        return self.files.join(self.read("labels").select("doc_id", "quality", "toxic"), "doc_id")


_SERIES = """series AS (
  SELECT user_id AS transect_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ping_index,
         epoch_us(ts) / 1e6 AS ts_s, value AS signal, event_type = 'error' AS is_passive,
         event_type = 'signup' AS is_removed
  FROM events)"""
_ECHO = """vectors AS (
  SELECT CAST(label AS BIGINT) AS transect_id, vec_id, embedding,
         row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS ping_index
  FROM embeddings),
echo AS (
  SELECT transect_id, ping_index, vec_id, embedding,
         1600000000.0::DOUBLE + transect_id * 100000.0::DOUBLE + ping_index
           + CASE WHEN ping_index >= 30 THEN 600.0::DOUBLE ELSE 0.0::DOUBLE END AS ts_s,
         transect_id % 2 = 1 AS is_upfacing,
         CASE WHEN transect_id % 2 = 1 THEN 31.75::DOUBLE ELSE 0.25::DOUBLE END AS depth_start,
         CASE WHEN transect_id % 2 = 1 THEN 0.25::DOUBLE ELSE 31.75::DOUBLE END AS depth_stop,
         ping_index % 17 BETWEEN 11 AND 14 AS is_passive,
         1.0::DOUBLE + (vec_id % 5) * 0.1::DOUBLE AS surface,
         4.0::DOUBLE + (vec_id % 11) * 0.5::DOUBLE AS turbulence,
         28.0::DOUBLE - (vec_id % 7) * 0.5::DOUBLE AS bottom
  FROM vectors)"""
_SAMP = (
    _ECHO
    + """,
samp0 AS (
  SELECT *, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) - 1 AS j FROM echo),
samp AS (
  SELECT * EXCLUDE (embedding, e), 10 * e AS logit, depth_start + j * (depth_stop - depth_start) / 63.0::DOUBLE AS depth,
         CASE WHEN j >= 38 AND (vec_id * 31 + j * 17) % 97 = 0 THEN NULL
              ELSE -80.0::DOUBLE + 100 * e - CASE WHEN is_passive THEN 60 ELSE 0 END END AS v
  FROM samp0),
cell AS (
  SELECT *, turbulence < depth AND depth < bottom AND NOT is_passive AND ping_index % 23 NOT IN (5, 6, 7)
            AND NOT (ping_index BETWEEN 16 AND 19 AND j BETWEEN 20 AND 26) AS keep
  FROM samp)"""
)
_POINTS = (
    _ECHO
    + """,
points AS (
  SELECT transect_id, ping_index, ts_s, 3 AS status,
         CASE WHEN ping_index % 20 <> 10 THEN surface END AS surface,
         CASE WHEN ping_index % 20 <> 10 THEN turbulence END AS turbulence,
         CASE WHEN ping_index % 20 <> 10 THEN bottom END AS bottom
  FROM echo WHERE ping_index % 2 = 0)"""
)
_ORDERS = """order_lines AS (
  SELECT o_custkey AS transect_id, epoch_us(o_orderdate) / 1e6 AS ts_s, min(o_totalprice / 10000) AS depth
  FROM orders GROUP BY ALL)"""
_CELLS = """cells AS (
  SELECT l_suppkey AS sample_id, l_returnflag AS channel, l_linestatus AS stratum, l_discount / 0.1::DOUBLE AS pred,
         CASE WHEN l_tax > 0.04::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS target,
         l_orderkey AS order_id, l_linenumber AS line_no
  FROM lineitem)"""
_FILES = """files AS (
  SELECT doc_id, source || '/' || lang || '_' || doc_id AS path, source AS survey, lang AS tide, n_chars AS width
  FROM documents),
outputs AS (SELECT files.*, quality, toxic FROM files JOIN labels USING (doc_id))"""

CTE = {
    "series": _SERIES,
    "echo": _ECHO,
    "samp": _SAMP,
    "points": _POINTS,
    "points_samp": _SAMP + _POINTS[len(_ECHO):],
    "orders": _ORDERS,
    "cells": _CELLS,
    "files": _FILES,
}
