"""Line files: reading and writing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.blocks import dense_index
from ..operators.lines import is_undefined
from ..session import cut
from . import files

HEADER = "\ufeffEVBD 3 10.0.270.37090"  # fixed value: first row of a line file
KEYS = ("transect_id", "line")


def parse_lines(rows: DataFrame, special_to_null: bool = True) -> DataFrame:
    """Points from text rows (``value`` and any other columns).

    The header and the point count are skipped. Other rows without four entries, or with
    a non-empty third one, get an ``error``.
    """
    f = F.split("value", " ")
    d = rows.withColumn("_f", f).where(~F.regexp_replace("value", "^\ufeff", "").startswith("EVBD") & ~F.col("value").rlike(r"^\s*\d*\s*$"))
    ts = text.parse_stamp(F.concat_ws(" ", F.get("_f", F.lit(0)), F.get("_f", F.lit(1))))
    depth = F.get("_f", F.lit(3)).try_cast("double")
    status = F.get("_f", F.lit(4)).try_cast("int")
    err = (
        F.when(F.size("_f") < 4, "short row")
        .when(F.length(F.get("_f", F.lit(2))) > 0, "third entry is not empty")
        .when(ts.isNull(), "bad date or time")
        .when(depth.isNull() | status.isNull(), "bad depth or status")
    )
    d = d.withColumns({"ts_s": ts, "depth": depth, "status": status, "error": err})
    if special_to_null:
        d = d.withColumn("depth", F.when(~is_undefined("depth"), F.col("depth")))
    return d.drop("_f", "value")


def read_lines(spark: SparkSession, path: str, special_to_null: bool = True, errors: str = "raise") -> DataFrame:
    """Points of line files below ``path``; folder names ``key=value`` become columns."""
    d = parse_lines(spark.read.text(path), special_to_null)
    if errors == "raise":
        e = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("bad line file: "), "error"))).otherwise(F.lit(None).cast("string"))
        return d.withColumn("error", e).where(F.col("error").isNull()).drop("error")
    return d


def line_rows(lines: DataFrame, pad: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """Text rows of line files: keys, ``seq``, ``value``.

    ``lines`` has ``ts_s``, ``depth``, ``status``. With ``pad`` each line gets a point half a
    step before its first and after its last point.
    """
    keys = list(keys)
    d = cut(dense_index(lines.select(*keys, "ts_s", "depth", "status"), keys, ["ts_s"], "seq"), "line-points")
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    at = lambda i, c: F.max(F.when(F.col("seq") == i, F.col(c)))
    e = d.join(n, keys).where((F.col("seq") < 2) | (F.col("seq") >= F.col("_n") - 2)).groupBy(*keys).agg(
        F.first("_n").alias("_n"), at(0, "ts_s").alias("t0"), at(1, "ts_s").alias("t1"), at(F.col("_n") - 2, "ts_s").alias("t8"),
        at(F.col("_n") - 1, "ts_s").alias("t9"), at(0, "depth").alias("d0"), at(F.col("_n") - 1, "depth").alias("d9"),
        at(0, "status").alias("s0"), at(F.col("_n") - 1, "status").alias("s9"),
    )
    if pad:
        many = e.where("_n > 1")
        first = many.select(*keys, (F.col("t0") - (F.col("t1") - F.col("t0")) / 2).alias("ts_s"), F.col("d0").alias("depth"), F.col("s0").alias("status"), F.lit(-1).cast("long").alias("seq"))
        last = many.select(*keys, (F.col("t9") + (F.col("t9") - F.col("t8")) / 2).alias("ts_s"), F.col("d9").alias("depth"), F.col("s9").alias("status"), F.col("_n").alias("seq"))
        d = d.unionByName(first).unionByName(last)
    body = d.select(*keys, "seq", F.concat(text.stamp("ts_s"), F.lit("  "), F.col("depth").cast("string"), F.lit(" "), F.col("status").cast("string"), F.lit(" ")).alias("value"))
    total = F.col("_n") + (F.when(F.col("_n") > 1, 2).otherwise(0) if pad else F.lit(0))
    head = e.select(*keys, F.explode(F.array(F.struct(F.lit(-3).cast("long").alias("seq"), F.lit(HEADER).alias("value")), F.struct(F.lit(-2).cast("long").alias("seq"), total.cast("string").alias("value")))).alias("_h"))
    return body.unionByName(head.select(*keys, "_h.seq", "_h.value"))


def write_lines(lines: DataFrame, path: str, pad: bool = False, line_ending: str = "\r\n", mode: str = "errorifexists", keys: Sequence[str] = KEYS) -> None:
    files.write_text(line_rows(lines, pad, keys), path, keys, ["seq"], line_ending, mode)


def lines_long(df: DataFrame, cols: Sequence[str], status: int = 1, key: Sequence[str] = ("transect_id",), ts: str = "ts_s") -> DataFrame:
    """Line columns of pings as points of a line table."""
    pts = F.array(*[F.struct(F.lit(c).alias("line"), F.col(c).cast("double").alias("depth")) for c in cols])
    return df.select(*key, F.col(ts).alias("ts_s"), F.explode(pts).alias("_p")).select(*key, "_p.line", "ts_s", "_p.depth", F.lit(status).alias("status"))


def lines_from_masked_pings(pings: DataFrame, max_gap: float = 1.0) -> DataFrame:
    """Turbulence and bottom points from masked pings (missing samples count as masked)."""
    from ..operators.lines import lines_from_mask  # noqa: PLC0415

    d = lines_from_mask(pings.withColumn("mask", F.transform("sv", lambda x: x.isNotNull())), "mask", max_gap, "turbulence", "bottom")
    return lines_long(d, ["turbulence", "bottom"])
