"""The whole job: files in a folder to line and region files, told what to do with outputs that exist."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid
from ..operators.blocks import dense_index
from ..session import cut, exists
from ..sources import files, lines, pings, regions
from .scoring import lines_and_regions, region_columns, score_to_lines

KEY = ["transect_id"]


def outputs_in(spark: SparkSession, output_dir: str) -> DataFrame:
    """Outputs that a job has written below ``output_dir`` (``output``)."""
    path = f"{output_dir.rstrip('/')}/outputs"
    if not exists(spark, path):
        return spark.range(0).select(F.lit("").alias("output"))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    # Folder names are percent-encoded once as names and once more in the listed path.
    folder = F.regexp_extract("path", r"/output=([^/]*)/[^/]+$", 1)
    return found.select(F.try_url_decode(F.replace(F.try_url_decode(F.replace(folder, F.lit("+"), F.lit("%2B"))), F.lit("+"), F.lit("%2B"))).alias("output")).distinct()


def plan_job(spark: SparkSession, folder: str, output_dir: str, mode: str = "error", suffix: str = "",
             names: Sequence[str] = ("turbulence", "bottom", "surface"), extensions: Sequence[str] = ("csv",)) -> tuple[DataFrame, DataFrame]:
    """(inputs with their action, outputs of each input). Contents are not read."""
    found = files.find_files(spark, [folder], extensions=extensions)
    root = folder.rstrip("/") + "/"
    # Listed paths carry a scheme; outputs are named by the path below the folder.
    below = F.element_at(F.split("path", F.lit("\\Q" + root.split("://")[-1] + "\\E")), -1)
    plan = files.output_plan(found.select(F.col("path").alias("file"), below.alias("path")), "", "", suffix, lines=names)
    status = files.existing_outputs(plan, outputs_in(spark, output_dir), ["file", "path"])
    return files.decide(status, mode), plan


def run_job(spark: SparkSession, folder: str, output_dir: str, load: Callable, mode: str = "error", suffix: str = "",
            names: Sequence[str] = ("turbulence", "bottom", "surface"), extensions: Sequence[str] = ("csv",), dry_run: bool = False,
            smoothing: tuple[float, float] | None = None, during_passive: str = "interpolate-time", autocrop: float = 0.35,
            score_options: dict | None = None, region_options: dict | None = None) -> DataFrame:
    """Find files, read, regrid, score, write; returns one row per input with what happened to it.

    ``mode`` is ``error`` (stop if any output exists), ``skip``, ``overwrite`` or
    ``skip_or_overwrite``; other inputs' outputs are never touched. An output is a folder
    ``output=<name>`` of ordered text parts below ``<output_dir>/outputs``. Rows that do not read
    go to ``<output_dir>/quarantine``; a file without a single good ping yields no outputs and is
    reported as ``failed``. The plan is made, and a stop decided, before any content is read.
    """
    actions, plan = plan_job(spark, folder, output_dir, mode, suffix, names, extensions)
    actions = cut(actions, "actions")
    bad = actions.where("action = 'error'").limit(1).collect()
    if bad and not dry_run:
        raise FileExistsError(f"outputs of {bad[0]['path']} exist")
    todo = actions.where("action = 'process'").select("file", "path")
    if dry_run or todo.isEmpty():
        return actions
    rows = pings.read_text(spark, folder).join(todo, "file", "left_semi")
    parsed = cut(pings.parse_pings(rows), "parsed")
    pings.quarantine(parsed).write.mode("append").parquet(f"{output_dir.rstrip('/')}/quarantine")
    rec = pings.as_recordings(pings.good(parsed), F.col("file"))
    # Bad rows leave gaps: pings are numbered anew in order.
    rec = cut(dense_index(rec.withColumnRenamed("ping_index", "_given"), KEY, ["_given"]).drop("_given"), "pings")
    # Stored, as statistics, steps and segments each read the pings on their grid.
    rec = cut(grid.regrid(rec), "grid")
    columns = (*names, *region_columns((region_options or {}).get("patch_mode")))
    scored = score_to_lines(rec, load, autocrop=autocrop, smoothing=smoothing, **{"columns": columns, **(score_options or {})})
    pts, rect, contours = lines_and_regions(scored, during_passive, names=names, **(region_options or {}))
    name = cut(plan.select(F.col("file").alias("transect_id"), "kind", "output"), "names")
    line = lines.line_rows(pts, pad=True).withColumnRenamed("line", "kind").select(*KEY, "kind", "seq", "value")
    region = regions.region_rows(rect, contours).withColumn("kind", F.lit("regions")).select(*KEY, "kind", "seq", "value")
    # A recording without regions still gets its (empty) region file.
    none = scored.select(*KEY).distinct().join(region.select(*KEY).distinct(), KEY, "left_anti")
    head = none.select(*KEY, F.lit("regions").alias("kind"), F.lit(-1).cast("long").alias("seq"), F.lit(regions.HEADER + "\r\n0").alias("value"))
    text = line.unionByName(region).unionByName(head).join(name, [*KEY, "kind"]).select("output", "seq", "value")
    ordered = text.repartitionByRange("output", "seq").sortWithinPartitions("output", "seq").select("output", "value")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("lineSep", "\r\n").partitionBy("output").text(f"{output_dir.rstrip('/')}/outputs")
    done = scored.groupBy(F.col("transect_id").alias("file")).agg(F.count("*").alias("n_pings"))
    report = actions.join(done, "file", "left")
    failed = (F.col("action") == "process") & F.col("n_pings").isNull()
    return report.withColumn("action", F.when(failed, "failed").otherwise(F.col("action")))
