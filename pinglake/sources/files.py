"""Finding inputs, naming outputs, partition lists, and text files with ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.arrays import col


def find_files(spark: SparkSession, folders: Sequence[str] = (), files: Sequence[str] = (), extensions: Sequence[str] | None = ("csv",),
               recursive: bool = True) -> DataFrame:
    """Input files: those given outright always, those in folders by extension, any case.

    A missing path is an error. Contents are not read.
    """
    def listing(paths, only):
        d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
        d = d.select("path", F.col("length"), F.col("modificationTime").alias("modified"))
        return with_extension(d, extensions) if only else d

    out = None
    for folder in folders:
        d = listing([folder], True)
        if not recursive:
            root = folder.rstrip("/").split("/")[-1]
            d = d.where(text.base_name(text.folder("path")) == root)
        out = d if out is None else out.unionByName(d)
    if files:
        d = listing(files, False)
        out = d if out is None else out.unionByName(d)
    return out


def with_extension(df: DataFrame, extensions: Sequence[str] | None, path: str = "path") -> DataFrame:
    if extensions is None:
        return df
    return df.where(text.extension(path).isin(*[e.lower() for e in extensions]))


def destination(path, source_dir: str, output_dir: str, keep_ext: bool = False) -> Column:
    """Where outputs of an input go: the same sub-tree below ``output_dir``.

    Absolute paths outside the source folder keep only their name. No output folder: next
    to the input.
    """
    p = col(path)
    src = source_dir.rstrip("/") + "/"
    if not output_dir:
        out = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(src), p)) if source_dir else p
    else:
        inside = F.when(p.startswith(src), F.substring(p, len(src) + 1, 1 << 30)).when(p.startswith("/"), text.base_name(p)).otherwise(p)
        out = text.join_path(F.lit(output_dir), inside)
    return out if keep_ext else text.without_extension(out)


def output_plan(df: DataFrame, source_dir: str = "", output_dir: str = "", suffix: str = "", keep_ext: bool = False,
                lines: Sequence[str] = ("turbulence", "bottom", "surface"), path: str = "path") -> DataFrame:
    """One row per input and required output: ``output``, ``kind``."""
    d = df.withColumn("_d", destination(path, source_dir, output_dir, keep_ext))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit("evl").alias("ext")) for k in lines], F.struct(F.lit("regions").alias("kind"), F.lit("evr").alias("ext")))
    d = d.withColumn("_k", F.explode(kinds))
    return d.withColumn("kind", F.col("_k.kind")).withColumn(
        "output", F.concat("_d", F.lit("."), F.col("_k.kind"), F.lit(f"{suffix}."), F.col("_k.ext"))
    ).drop("_d", "_k")


def existing_outputs(plan: DataFrame, existing: DataFrame, by: Sequence[str] = ("path",)) -> DataFrame:
    """Per input: outputs needed, outputs present."""
    p = plan.join(existing.select("output").distinct().withColumn("_x", F.lit(1)), "output", "left")
    return p.groupBy(*by).agg(F.count(F.lit(1)).alias("n_outputs"), F.count("_x").alias("n_present"))


def decide(status: DataFrame, mode: str = "error") -> DataFrame:
    """What happens to each input: ``process``, ``skip`` or ``error``.

    ``skip`` leaves inputs alone whose outputs all exist and stops at partly existing
    ones; ``overwrite`` processes all; ``error`` stops at any existing output.
    """
    some, all_ = F.col("n_present") > 0, F.col("n_present") == F.col("n_outputs")
    rule = {
        "error": F.when(some, "error").otherwise("process"),
        "overwrite": F.lit("process"),
        "skip": F.when(all_, "skip").when(some, "error").otherwise("process"),
        "skip_or_overwrite": F.when(all_, "skip").otherwise("process"),
    }
    if mode not in rule:
        raise ValueError(f"unknown mode {mode!r}")
    return status.withColumn("action", rule[mode])


def read_partition_table(spark: SparkSession, folder: str, partition: str) -> DataFrame:
    """Partition list with its header kept in ``header.txt`` beside it; all columns as text."""
    head = spark.read.text(f"{folder}/header.txt").limit(1).collect()[0][0]
    names = [h.strip() for h in head.split(",")]
    return spark.read.schema(", ".join(f"`{n}` string" for n in names)).csv(f"{folder}/{partition}.txt")


def partition_paths(df: DataFrame, by_survey: bool, name: str = "Filename", root: str | None = None, dataset: str = "", sharded: bool = False) -> DataFrame:
    """Recording paths of a partition list as ``recording``.

    ``by_survey`` puts the name's part before its first underscore in front as a folder.
    ``root`` makes full paths, below ``<root>_sharded`` when sharded.
    """
    f = F.trim(F.col(name))
    p = F.concat(text.survey_of(F.col(name)), F.lit("/"), f) if by_survey else f
    p = text.without_suffix(p)
    if root is not None:
        base = root.rstrip("/") + ("_sharded" if sharded else "")
        p = text.join_path(F.lit(base), F.lit(dataset), p)
    return df.withColumn("recording", p)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """One entry per line, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("Filename"))


def enrich_inventory(files: DataFrame, inventory: DataFrame, path: str = "path", survey: str = "survey") -> DataFrame:
    """Survey (first folder), tide from the name, and the survey's inventory columns."""
    d = files.withColumn(survey, F.substring_index(path, "/", 1)).withColumn("tide", text.tide_of(F.col(path)))
    return d.join(inventory, survey, "left")


def write_text(rows: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], line_ending: str = "\r\n", mode: str = "errorifexists") -> None:
    """Text rows in order, one folder per key.

    Rows are ranged by (keys, order): a folder has one file unless it is large or meets a
    range boundary, and then its files in name order are its text.
    """
    rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).select(*keys, "value").write.mode(mode).option(
        "lineSep", line_ending
    ).partitionBy(*keys).text(path)
