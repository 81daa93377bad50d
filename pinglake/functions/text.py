"""Date-time text, names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import col


def stamp(ts_s) -> Column:
    """Epoch seconds as ``CCYYMMDD HHmmSSssss`` (ssss in 0.1 ms, half to even, carried)."""
    ticks = F.bround(col(ts_s) * 1e4).cast("long")
    sec = F.floor(ticks / F.lit(10000)).cast("long")
    return F.concat(
        F.date_format(F.timestamp_seconds(sec), "yyyyMMdd HHmmss"), F.lpad((ticks - sec * 10000).cast("string"), 4, "0")
    )


def parse_stamp(s) -> Column:
    """Epoch seconds of ``CCYYMMDD HHmmSSssss``; NULL when malformed."""
    s = col(s)
    base = F.try_to_timestamp(F.substring(s, 1, 15), F.lit("yyyyMMdd HHmmss"))
    ok = s.rlike(r"^\d{8} \d{6}\d*$")
    digits = F.substring(s, 16, 20)
    frac = F.when(F.length(digits) > 0, F.concat(F.lit("0."), digits).try_cast("double")).otherwise(F.lit(0.0))
    return F.when(ok, F.unix_micros(base) / 1e6 + frac)


def ping_time(date, time, milliseconds) -> Column:
    """Epoch seconds of a ping: date, time, and milliseconds cut to whole microseconds."""
    base = F.try_to_timestamp(F.concat_ws(" ", col(date), col(time)), F.lit("yyyy-MM-dd HH:mm:ss"))
    return (F.unix_micros(base) + F.floor(1000 * col(milliseconds))) / 1e6


def base_name(path) -> Column:
    return F.regexp_extract(col(path), r"([^/\\]*)$", 1)


def folder(path) -> Column:
    return F.regexp_replace(col(path), r"/?[^/\\]*$", "")


def without_extension(path) -> Column:
    """Path without the extension of its last part; leading dots do not begin one."""
    return F.regexp_replace(col(path), r"(?<=[^/\\.])\.[^./\\]*$", "")


def extension(path) -> Column:
    """Lower-case extension without the dot; empty if none."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.]\.([^.]*)$", 1))


def join_path(*parts) -> Column:
    """Parts joined with single slashes; empty ones are left out."""
    cols = [F.regexp_replace(col(p), r"/+$", "") for p in parts[:-1]] + [col(parts[-1])]
    return F.concat_ws("/", *[F.when(F.length(c) > 0, c) for c in cols])


def without_slash(path) -> Column:
    return F.regexp_replace(col(path), r"[/\\]+$", "")


def survey_of(name) -> Column:
    """Part of a file name before its first underscore."""
    return F.substring_index(col(name), "_", 1)


def tide_of(name) -> Column:
    return F.when(col(name).contains("_E_"), "Ebb").when(col(name).contains("_F_"), "Flow").otherwise("")


def without_suffix(path, suffix: str = "_Sv_raw.csv") -> Column:
    return F.replace(col(path), F.lit(suffix), F.lit(""))


def mask_line_base(path) -> Column:
    """Base name of lines derived from a masked file."""
    stem = without_extension(path)
    name = F.replace(F.replace(base_name(stem), F.lit("_Sv_raw"), F.lit("")), F.lit("_Sv"), F.lit(""))
    return join_path(folder(stem), name)
