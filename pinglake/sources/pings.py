"""Ping exports: text files whose rows are metadata followed by a signal of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.arrays import sentinel_to_null

# Metadata fields of a ping export and their types.
FIELDS = {
    "Ping_index": "int",
    "Distance_gps": "double",
    "Distance_vl": "double",
    "Ping_date": "string",
    "Ping_time": "string",
    "Ping_milliseconds": "double",
    "Latitude": "double",
    "Longitude": "double",
    "Depth_start": "double",
    "Depth_stop": "double",
    "Range_start": "double",
    "Range_stop": "double",
    "Sample_count": "int",
}
REQUIRED = ("Ping_date", "Ping_time", "Ping_milliseconds", "Depth_start", "Depth_stop")
BOM = "\ufeff"


def read_text(spark: SparkSession, path, recursive: bool = True, pattern: str | None = None) -> DataFrame:
    """Rows of text files with the file they come from. Big files split over tasks."""
    r = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    return r.text(path).select("value", F.col("_metadata.file_path").alias("file"))


def text_of(file="file") -> Column:
    """The text that a file belongs to: the part files that one job wrote into a folder are one text, other files one each."""
    return F.regexp_replace(file, r"/part-\d+-(\p{XDigit}{8}(?:-\p{XDigit}{4}){3}-\p{XDigit}{12})[.-]c\d+[^/]*$", "/part-*-$1*")


def _split(rows: DataFrame) -> DataFrame:
    line = F.regexp_replace("value", f"^{BOM}", "")
    cells = F.transform(F.split(line, ","), lambda x: F.trim(x))
    return rows.where(F.is_valid_utf8("value")).select("file", "value", cells.alias("_c"), text_of().alias("_text"))


def _is_header() -> Column:
    return F.array_contains("_c", "Ping_date") & F.array_contains("_c", "Depth_start")


def headers(rows: DataFrame) -> DataFrame:
    """(_text, _h): the entries of each text's header, NULL without one."""
    return _split(rows).groupBy("_text").agg(F.min_by("_c", F.when(_is_header(), F.col("file"))).alias("_h"))


def parse_pings(rows: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Typed pings from text rows (``value``, ``file``).

    The header, the row that names the date and depth fields, says which leading entries
    are metadata. Only the first of a text's part files has it, and it holds for all of them;
    ``heads`` (see ``headers``) gives it if not all are among the rows. Unknown fields go to the
    map ``extra``. Rows that are not UTF-8 are skipped. Rows that cannot be read keep an
    ``error``; see ``good`` and ``quarantine``.
    """
    d = _split(rows)
    # One header per text: the smaller side by far; Spark broadcasts it only if its size allows.
    if heads is None:
        heads = d.where(_is_header()).groupBy("_text").agg(F.min_by("_c", "file").alias("_h"))
    d = d.where(~_is_header()).join(heads, "_text", "left")

    def raw(name):
        return F.get("_c", F.array_position("_h", name).cast("int") - 1)

    cols, bad = [], F.lit(False)
    for name, typ in FIELDS.items():
        known = F.array_contains("_h", name)
        v = F.when(known, raw(name) if typ == "string" else raw(name).try_cast(typ))
        cols.append(v.alias(name))
        if typ != "string":
            bad = bad | (known & v.isNull())
    n = F.size("_h")
    tail = F.slice("_c", n + 1, F.greatest(F.size("_c") - n, F.lit(0)))
    sv = F.transform(tail, lambda x: x.try_cast("double"))
    extra = F.map_filter(F.map_from_arrays("_h", F.slice(F.concat("_c", F.array_repeat(F.lit(None).cast("string"), n)), F.lit(1), n)), lambda k, _: ~k.isin(*FIELDS))
    missing = F.lit(False)
    for name in REQUIRED:
        missing = missing | ~F.array_contains("_h", name)
    d = d.select(
        "file", "value", *cols, F.when(F.col("_h").isNotNull(), extra).alias("extra"), F.when(F.col("_h").isNotNull(), sv).alias("_sv"),
        F.col("_h").isNull().alias("_nohead"), F.coalesce(missing, F.lit(False)).alias("_miss"), F.coalesce(bad, F.lit(False)).alias("_bad"),
    )
    d = d.withColumn("ts_s", text.ping_time("Ping_date", "Ping_time", "Ping_milliseconds"))
    err = (
        F.when(F.col("_nohead"), "file has no header")
        .when(F.col("_miss"), "header lacks a required field")
        .when(F.col("_bad"), "metadata field is not a number")
        .when(F.col("ts_s").isNull(), "bad date or time")
        .when(F.exists("_sv", lambda x: x.isNull()), "sample is not a number")
    )
    return d.select(
        "file", *FIELDS, "extra", "ts_s", F.timestamp_micros(F.bround(F.col("ts_s") * 1e6).cast("long")).alias("ts"),
        sentinel_to_null("_sv").alias("sv"), err.alias("error"), F.when(err.isNotNull(), F.col("value")).alias("raw"),
    )


def good(df: DataFrame, errors: str = "quarantine") -> DataFrame:
    """Rows without error; with ``errors="raise"`` an error stops the job."""
    if errors == "raise":
        e = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("bad input: "), F.col("error")))).otherwise(F.lit(None).cast("string"))
        return df.withColumn("error", e).where(F.col("error").isNull()).drop("error", "raw")
    return df.where(F.col("error").isNull()).drop("error", "raw")


def quarantine(df: DataFrame) -> DataFrame:
    """Rows with an error, as read."""
    return df.where(F.col("error").isNotNull()).select("file", "error", "raw")


def read_pings(spark: SparkSession, path, errors: str = "quarantine", pattern: str | None = None) -> DataFrame:
    return good(parse_pings(read_text(spark, path, pattern=pattern)), errors)


def count_lines(rows: DataFrame) -> DataFrame:
    """Lines per text (of part files, ``file`` is the first), and pings (lines without the header)."""
    n = F.count(F.lit(1))
    return rows.groupBy(text_of().alias("_text")).agg(F.min("file").alias("file"), n.alias("n_lines"), (n - 1).alias("n_pings")).drop("_text")


def as_recordings(pings: DataFrame, transect) -> DataFrame:
    """Pings in the operators' columns; ``transect`` names the recording of a file."""
    return pings.select(
        transect.alias("transect_id"), F.col("Ping_index").cast("long").alias("ping_index"), "ts_s",
        F.col("Depth_start").alias("depth_start"), F.col("Depth_stop").alias("depth_stop"), "sv",
    )


def render_pings(df: DataFrame) -> DataFrame:
    """Export rows (``transect_id``, ``seq``, ``value``) of pings, header first; missing samples as marker."""
    head = F.concat(F.lit(BOM), F.array_join(F.array(*[F.lit(f) for f in FIELDS]), ", "))
    t = F.timestamp_seconds(F.floor("ts_s"))
    ms = (F.col("ts_s") - F.floor("ts_s")) * 1000
    meta = [
        F.col("ping_index").cast("string"), F.lit("0.0"), F.lit("0.0"), F.date_format(t, "yyyy-MM-dd"), F.date_format(t, "HH:mm:ss"),
        F.bround(ms, 3).cast("string"), F.lit("44.0"), F.lit("-66.0"), F.col("depth_start").cast("string"), F.col("depth_stop").cast("string"),
        F.lit("0.0"), F.lit("0.0"), F.size("sv").cast("string"),
    ]
    row = F.concat_ws(", ", *meta, F.array_join(F.transform("sv", lambda x: F.coalesce(x, F.lit(-9.9e37)).cast("string")), ", "))
    body = df.select("transect_id", F.col("ping_index").alias("seq"), row.alias("value"))
    return body.unionByName(df.select("transect_id").distinct().select("transect_id", F.lit(-1).cast("long").alias("seq"), head.alias("value")))
