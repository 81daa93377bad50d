"""Sources, sinks, inventories and set operations. Text is rendered from the given tables, stored in the shared folder and read back."""

from pyspark.sql import functions as F

from ..functions import text
from ..operators import asof, grid, patches, runs
from ..session import ensure, scratch
from ..sources import files, pings, regions, shards
from ..sources import lines as line_files
from ..streaming import ingest as ing
from .registry import query

PK = ["transect_id", "ping_index"]


def _id():
    return F.regexp_extract("file", r"transect_id=(\d+)", 1).cast("long")


def _export(t):
    """Ping exports of all echograms, one folder per recording, in the shared folder."""

    def write() -> str:
        path = scratch(t.spark, "pings-text")
        rows = pings.render_pings(t.echo)
        # One malformed row per recording, after the others.
        bad = rows.where("seq = 5").select("transect_id", F.lit(1 << 40).alias("seq"), F.regexp_replace("value", "^5,", "five,").alias("value"))
        files.write_text(rows.unionByName(bad), path, ["transect_id"], ["seq"])
        return path

    return ensure(t.spark, (t.dir, "export"), write)


def _rows(t):
    return pings.read_text(t.spark, _export(t))


@query("s1_read_pings", "samp", " SELECT transect_id, ping_index, round(ts_s, 4) AS ts_s, depth_start, depth_stop, CAST(count(*) AS INT) AS sample_count, count(v) AS n_present, round(sum(v), 4) AS total FROM samp GROUP BY ALL")
def _(t):
    d = pings.good(pings.parse_pings(_rows(t)))
    present = F.filter("sv", lambda x: x.isNotNull())
    return d.select(
        _id().alias("transect_id"), F.col("Ping_index").cast("long").alias("ping_index"), F.round("ts_s", 4).alias("ts_s"), F.col("Depth_start").alias("depth_start"),
        F.col("Depth_stop").alias("depth_stop"), F.col("Sample_count").alias("sample_count"), F.size(present).cast("long").alias("n_present"),
        F.round(F.aggregate(present, F.lit(0.0), lambda a, x: a + x), 4).alias("total"),
    )


@query("s16_quarantine", "echo", " SELECT transect_id, 'metadata field is not a number' AS error, count(*) FILTER (WHERE ping_index = 5) AS n_bad FROM echo GROUP BY 1 HAVING n_bad > 0")
def _(t):
    q = pings.quarantine(pings.parse_pings(_rows(t)))
    return q.groupBy(_id().alias("transect_id"), "error").agg(F.count(F.lit(1)).alias("n_bad"))


@query("s19_count_lines", "echo", " SELECT transect_id, count(*) + 1 + count(*) FILTER (WHERE ping_index = 5) AS n_lines, count(*) + count(*) FILTER (WHERE ping_index = 5) AS n_pings FROM echo GROUP BY 1")
def _(t):
    c = _rows(t).groupBy(_id().alias("transect_id")).agg(F.count(F.lit(1)).alias("n_lines"))
    return c.withColumn("n_pings", F.col("n_lines") - 1)


@query("s15_incremental_ingest", "echo", " SELECT transect_id, count(*) AS n_pings, round(sum(ts_s - 1600000000), 2) AS total FROM echo GROUP BY 1")
def _(t):
    target = scratch(t.spark, "ingest")
    for _ in range(2):  # the second run finds nothing new
        ing.ingest(t.spark, _export(t), target, f"{target}/checkpoint")
    d = ing.ingested(t.spark, target)
    return d.groupBy(_id().alias("transect_id")).agg(F.count(F.lit(1)).alias("n_pings"), F.round(F.sum(F.col("ts_s") - 1600000000), 2).alias("total"))


def _points_long(t):
    p = t.line_points
    cols = ["surface", "turbulence", "bottom"]
    pts = F.explode(F.array(*[F.struct(F.lit(c).alias("line"), F.coalesce(c, F.lit(-10000.99)).alias("depth")) for c in cols]))
    return p.select("transect_id", "ts_s", "status", pts.alias("_p")).select("transect_id", "_p.line", "ts_s", "_p.depth", "status")


_LONG = """,
lp AS (SELECT transect_id, 'surface' AS line, ts_s, surface AS depth, status FROM points UNION ALL SELECT transect_id, 'turbulence', ts_s, turbulence, status FROM points
       UNION ALL SELECT transect_id, 'bottom', ts_s, bottom, status FROM points)"""


def _line_folder(t):
    path = scratch(t.spark, "lines-text")
    line_files.write_lines(_points_long(t), path)
    return path


@query("s3_read_lines", "points", _LONG + " SELECT transect_id, line, round(ts_s, 4) AS ts_s, round(depth, 6) AS depth, status FROM lp")
def _(t):
    d = line_files.read_lines(t.spark, _line_folder(t))
    return d.select(F.col("transect_id").cast("long").alias("transect_id"), "line", F.round("ts_s", 4).alias("ts_s"), F.round("depth", 6).alias("depth"), "status")


@query(
    "s5_write_lines", "points",
    _LONG + """,
n AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY transect_id, line) AS n, lead(ts_s) OVER w AS nt, lag(ts_s) OVER w AS pt FROM lp WINDOW w AS (PARTITION BY transect_id, line ORDER BY ts_s)),
p AS (SELECT transect_id, line, ts_s, depth FROM lp UNION ALL SELECT transect_id, line, ts_s - (nt - ts_s) / 2, depth FROM n WHERE rn = 1 AND n > 1 UNION ALL SELECT transect_id, line, ts_s + (ts_s - pt) / 2, depth FROM n WHERE rn = n AND n > 1),
k AS (SELECT transect_id, line, CAST(round_even(ts_s * 1e4, 0) AS BIGINT) AS tk, coalesce(depth, -10000.99::DOUBLE) AS depth FROM p)
SELECT transect_id, line, strftime(make_timestamp(CAST(tk // 10000 AS BIGINT) * 1000000), '%Y%m%d %H%M%S') || lpad(CAST(tk % 10000 AS VARCHAR), 4, '0') || '  ' || CAST(depth AS VARCHAR) || ' 3 ' AS value FROM k
UNION ALL SELECT transect_id, line, 'EVBD 3 10.0.270.37090' FROM lp GROUP BY 1, 2
UNION ALL SELECT transect_id, line, CAST(count(*) + CASE WHEN count(*) > 1 THEN 2 ELSE 0 END AS VARCHAR) FROM lp GROUP BY 1, 2""",
)
def _(t):
    r = line_files.line_rows(_points_long(t), pad=True)
    return r.select("transect_id", "line", F.regexp_replace("value", "^\ufeff", "").alias("value"))


_REG = """,
on_ AS (SELECT *, ping_index - row_number() OVER (PARTITION BY transect_id ORDER BY ping_index) AS g FROM series WHERE is_passive),
ts AS (SELECT transect_id, ping_index, ts_s, lag(ts_s) OVER w AS pt, lead(ts_s) OVER w AS nt FROM series WINDOW w AS (PARTITION BY transect_id ORDER BY ping_index)),
u AS (SELECT o.transect_id, min(o.ping_index) AS first, max(o.ping_index) AS last, min(coalesce((t.ts_s + pt) / 2, t.ts_s - (nt - t.ts_s) / 2)) AS a, max(coalesce((t.ts_s + nt) / 2, t.ts_s + (t.ts_s - pt) / 2)) AS b
      FROM on_ o JOIN ts t USING (transect_id, ping_index) GROUP BY o.transect_id, g),
rg AS (SELECT *, row_number() OVER (PARTITION BY transect_id ORDER BY first) AS number FROM u)"""


def _rectangles(t):
    r = runs.flag_regions(t.series, "is_passive", "passive")
    return r.withColumns({"top": F.lit(0.25), "low": F.lit(31.75)})


_READ_REGIONS = _REG + " SELECT transect_id, number, 'passive' AS kind, 4 AS creation_type, 0 AS region_type, 'Passive ' || number AS region_name, round(round_even(a * 1e4, 0) / 1e4, 4) AS ts_start, round(round_even(b * 1e4, 0) / 1e4, 4) AS ts_end, 4 AS n_points FROM rg"


def _read_back(t, line_ending):
    path = scratch(t.spark, "regions-text")
    regions.write_regions(path, _rectangles(t), line_ending=line_ending, common_notes="by hand\n\nsecond paragraph")
    d = regions.read_regions(t.spark, path)
    return d.select(F.col("transect_id").cast("long").alias("transect_id"), "number", "kind", "creation_type", "region_type", "region_name", F.round("ts_start", 4).alias("ts_start"),
                    F.round("ts_end", 4).alias("ts_end"), F.size("points").alias("n_points"))


@query("s4_read_regions", "series", _READ_REGIONS)
def _(t):
    return _read_back(t, "\r\n")


@query("s4_read_regions_lf", "series", _READ_REGIONS)
def _(t):
    return _read_back(t, "\n")



@query(
    "s6_write_regions", "series",
    _REG + """,
k AS (SELECT *, CAST(round_even(a * 1e4, 0) AS BIGINT) AS ta, CAST(round_even(b * 1e4, 0) AS BIGINT) AS tb FROM rg),
s AS (SELECT *, strftime(make_timestamp(CAST(ta // 10000 AS BIGINT) * 1000000), '%Y%m%d %H%M%S') || lpad(CAST(ta % 10000 AS VARCHAR), 4, '0') AS l, strftime(make_timestamp(CAST(tb // 10000 AS BIGINT) * 1000000), '%Y%m%d %H%M%S') || lpad(CAST(tb % 10000 AS VARCHAR), 4, '0') AS r FROM k)
SELECT transect_id, '13 4 ' || number || ' 0 4 -1 1 ' || l || '  0.25 ' || r || '  31.75' AS header, l || ' 0.25 ' || l || ' 31.75 ' || r || ' 31.75 ' || r || ' 0.25 0' AS points, 'Passive ' || number AS name FROM s""",
)
def _(t):
    rows = regions.region_rows(_rectangles(t)).where("seq >= 0")
    ln = F.split("value", "\r\n")
    return rows.select("transect_id", F.get(ln, F.lit(1)).alias("header"), F.element_at(ln, -2).alias("points"), F.element_at(ln, -1).alias("name"))


@query("p21_region_class", "files", """ SELECT doc_id, CASE tide WHEN 'en' THEN 'passive' WHEN 'fr' THEN 'removed' WHEN 'de' THEN 'patch' ELSE 'other' END AS kind FROM files""")
def _(t):
    notes = F.when(F.col("tide") == "en", "Passive data\nx").when(F.col("tide") == "fr", "Removed data block").when(F.col("tide") == "de", "Removed patch 3").otherwise("see Passive data")
    return t.files.select("doc_id", regions.region_class(notes).alias("kind"))


@query(
    "a19_region_counts", "series",
    _REG + " SELECT transect_id, 'passive' AS kind, count(*) FILTER (WHERE last - first + 1 > 2) AS n_kept, count(*) FILTER (WHERE last - first + 1 <= 2) AS n_skipped FROM rg GROUP BY 1",
)
def _(t):
    return regions.region_counts(runs.flag_regions(t.series, "is_passive", "passive"), 2)


@query("n7_region_text", "series", _REG + " SELECT transect_id, number, 'Passive_v2 ' || number AS region_name, 'Passive data' || chr(10) || 'Length in pixels: ' || CAST(CAST(last - first + 1 AS DOUBLE) AS VARCHAR) AS notes FROM rg")
def _(t):
    r = runs.flag_regions(t.series, "is_passive", "passive", name_suffix="_v2")
    return r.select("transect_id", "number", "region_name", F.regexp_replace("notes", "\nDuration.*$", "").alias("notes"))


@query(
    "a10_polygon_area", "series",
    """,
f AS (SELECT transect_id, ping_index, ts_s, signal, first_value(ts_s) OVER w AS fx, first_value(signal) OVER w AS fy, lead(ts_s) OVER w AS nx, lead(signal) OVER w AS ny FROM series WINDOW w AS (PARTITION BY transect_id ORDER BY ping_index))
SELECT transect_id, round(abs(sum((signal - fy) * (coalesce(nx, fx) - ts_s) - (ts_s - fx) * (coalesce(ny, fy) - signal))) / 2, 1) AS area FROM f GROUP BY 1""",
)
def _(t):
    a = patches.polygon_area(t.series, ["transect_id"], "ping_index", "ts_s", "signal")
    return a.select("transect_id", F.round("area", 1).alias("area"))


@query(
    "a11_polygon_regions", "echo",
    """,
f AS (SELECT transect_id, ping_index, ts_s, turbulence AS d, first_value(ts_s) OVER w AS fx, first_value(turbulence) OVER w AS fy, lead(ts_s) OVER w AS nx, lead(turbulence) OVER w AS ny FROM echo WINDOW w AS (PARTITION BY transect_id ORDER BY ping_index))
SELECT transect_id, min(ts_s) AS ts_start, max(ts_s) AS ts_end, min(d) AS top, max(d) AS low, count(*) AS n_points, round(abs(sum((d - fy) * (coalesce(nx, fx) - ts_s) - (ts_s - fx) * (coalesce(ny, fy) - d))) / 2, 4) AS area FROM f GROUP BY 1""",
)
def _(t):
    r = patches.polygon_regions(t.lined, ["transect_id"], "ping_index", "ts_s", "turbulence")
    return r.select("transect_id", "ts_start", "ts_end", "top", "low", "n_points", F.round("area", 4).alias("area"))


_EXT = "path || CASE doc_id % 4 WHEN 0 THEN '.csv' WHEN 1 THEN '.CSV' WHEN 2 THEN '.ev' ELSE '' END"


def _named(t):
    ext = F.when(F.col("doc_id") % 4 == 0, ".csv").when(F.col("doc_id") % 4 == 1, ".CSV").when(F.col("doc_id") % 4 == 2, ".ev").otherwise("")
    return t.files.withColumn("path", F.concat("path", ext))


@query("s9_find_files", "files", f" SELECT doc_id, {_EXT} AS path FROM files WHERE doc_id % 4 < 2")
def _(t):
    return files.with_extension(_named(t), ["csv"]).select("doc_id", "path")


@query("s10_output_paths", "files", " SELECT doc_id, kind, '/out/' || path || '.' || kind || '-x.' || CASE kind WHEN 'regions' THEN 'evr' ELSE 'evl' END AS output FROM files, (SELECT unnest(['turbulence', 'bottom', 'surface', 'regions']) AS kind)")
def _(t):
    return files.output_plan(_named(t), "", "/out", "-x").select("doc_id", "kind", "output")


@query(
    "s11_partition_paths", "files",
    " SELECT doc_id, '/data_sharded/mobile/' || survey || '/' || survey || '_' || doc_id AS recording FROM files",
)
def _(t):
    d = t.files.withColumn("Filename", F.concat(F.lit(" "), F.col("survey"), F.lit("_"), F.col("doc_id").cast("string"), F.lit("_Sv_raw.csv ")))
    d = d.withColumn("Filename", F.trim("Filename"))
    return files.partition_paths(d, True, root="/data", dataset="mobile", sharded=True).select("doc_id", "recording")


@query("n4_path_parts", "files", " SELECT doc_id, survey AS folder, tide || '_' || doc_id AS name, tide AS stem_survey, CASE doc_id % 4 WHEN 0 THEN 'csv' WHEN 1 THEN 'csv' WHEN 2 THEN 'ev' ELSE '' END AS ext FROM files")
def _(t):
    d = _named(t)
    name = text.base_name(text.without_extension("path"))
    return d.select("doc_id", text.folder("path").alias("folder"), name.alias("name"), text.survey_of(name).alias("stem_survey"), text.extension("path").alias("ext"))


_PLAN = """,
pl AS (SELECT path, path || '.' || kind || '.evl' AS output FROM files, (SELECT unnest(['turbulence', 'bottom', 'surface']) AS kind) UNION ALL SELECT path, path || '.regions.evr' FROM files),
ex AS (SELECT DISTINCT path || '.turbulence.evl' AS output FROM outputs UNION SELECT path || '.bottom.evl' FROM outputs UNION SELECT path || '.surface.evl' FROM outputs WHERE quality = 1 UNION SELECT path || '.regions.evr' FROM outputs WHERE quality = 1),
st AS (SELECT path, count(*) AS n_outputs, count(ex.output) AS n_present FROM pl LEFT JOIN ex USING (output) GROUP BY 1)"""


def _status(t):
    o = t.outputs
    part = lambda k, e, d: d.select(F.concat("path", F.lit(f".{k}.{e}")).alias("output"))
    full = o.where("quality = 1")
    ex = part("turbulence", "evl", o).unionByName(part("bottom", "evl", o)).unionByName(part("surface", "evl", full)).unionByName(part("regions", "evr", full))
    return files.existing_outputs(files.output_plan(t.files), ex)


@query("j7_existing_outputs", "files", _PLAN + " SELECT * FROM st")
def _(t):
    return _status(t)


for _mode, _case in (
    ("error", "CASE WHEN n_present > 0 THEN 'error' ELSE 'process' END"), ("overwrite", "'process'"),
    ("skip", "CASE WHEN n_present = n_outputs THEN 'skip' WHEN n_present > 0 THEN 'error' ELSE 'process' END"),
):

    @query(f"s17_write_mode_{_mode}", "files", _PLAN + f" SELECT path, {_case} AS action FROM st")
    def _(t, mode=_mode):
        return files.decide(_status(t), mode).select("path", "action")


@query("j6_enrich_inventory", "files", ", inv AS (SELECT survey, count(*) AS grids FROM files WHERE tide = 'en' GROUP BY 1) SELECT f.doc_id, f.survey, CASE tide WHEN 'en' THEN 'Ebb' WHEN 'fr' THEN 'Flow' ELSE '' END AS tide, grids FROM files f LEFT JOIN inv USING (survey)")
def _(t):
    inv = t.files.where("tide = 'en'").groupBy("survey").agg(F.count(F.lit(1)).alias("grids"))
    name = F.concat("survey", F.lit("/g"), F.when(F.col("tide") == "en", "_E_").when(F.col("tide") == "fr", "_F_").otherwise("_"), F.col("doc_id").cast("string"))
    f = t.files.select("doc_id", name.alias("path"))
    return files.enrich_inventory(f, inv).select("doc_id", "survey", "tide", "grids")


@query("x2_concat_datasets", "files", " SELECT path, survey AS dataset, 1 AS copy, 70.0::DOUBLE AS max_depth FROM files UNION ALL SELECT path, survey, 2, NULL FROM files WHERE survey = 'src1'")
def _(t):
    from ..plans import datasets

    a = t.files.select("path", F.col("survey").alias("dataset"))
    return datasets.concat([(a, {"max_depth": 70.0}), (a.where("dataset = 'src1'"), {"max_depth": None})]).select("path", "dataset", "copy", "max_depth")


@query("x3_merge_partitions", "files", " SELECT path, tide AS sub FROM files")
def _(t):
    from ..plans import datasets

    parts = {s: t.files.where(F.col("tide") == s).select("path") for s in ("de", "en", "es", "fr")}
    return datasets.merge_partitions(parts).select("path", "sub")


@query("x4_complement", "files", " SELECT path, regexp_matches(path, '(en_.*1|/fr_.*2)$') AS left_out FROM files")
def _(t):
    from ..plans import datasets

    out, rest = datasets.leave_out(t.files.select("path"), "path", "(en_.*1|/fr_.*2)$")
    return out.withColumn("left_out", F.lit(True)).unionByName(rest.withColumn("left_out", F.lit(False)))


_SEG = """,
steps AS (SELECT *, ts_s - lag(ts_s) OVER (PARTITION BY transect_id ORDER BY ping_index) AS dt FROM echo),
base AS (SELECT transect_id, quantile_cont(dt, 0.975) AS q FROM steps GROUP BY 1),
seg AS (SELECT s.transect_id, ping_index, CAST(sum(CASE WHEN dt > q * 20 THEN 1 ELSE 0 END) OVER (PARTITION BY s.transect_id ORDER BY ping_index) AS BIGINT) AS segment_id FROM steps s JOIN base USING (transect_id)),
loc AS (SELECT *, row_number() OVER (PARTITION BY transect_id, segment_id ORDER BY ping_index) - 1 AS i FROM seg)"""


@query("s12_write_shards", "samp", _SEG + " SELECT transect_id, segment_id, CAST(i // 16 AS BIGINT) AS shard, count(DISTINCT ping_index) AS n_pings, count(*) AS n_cells, round(sum(v::FLOAT::DOUBLE), 3) AS total FROM loc JOIN samp USING (transect_id, ping_index) WHERE depth <= 20 GROUP BY 1, 2, 3")
def _(t):
    path = scratch(t.spark, "shards")
    shards.write_shards(t.echo, path, "demo", max_depth=20, shard_len=16)
    d = shards.read_shards(t.spark, path, "demo")
    return d.groupBy("transect_id", "segment_id", "shard").agg(
        F.count(F.lit(1)).alias("n_pings"), F.sum(F.size("sv")).alias("n_cells"),
        F.round(F.sum(F.aggregate(F.filter("sv", lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x.cast("double"))), 3).alias("total"),
    )


@query(
    "s14_recording_with_lines", "points",
    """,
n AS (SELECT e.transect_id, e.ping_index, e.ts_s, max(CASE WHEN p.ts_s <= e.ts_s THEN p.ts_s END) AS x0, min(CASE WHEN p.ts_s >= e.ts_s THEN p.ts_s END) AS x1
      FROM echo e JOIN points p ON p.transect_id = e.transect_id WHERE p.turbulence IS NOT NULL GROUP BY 1, 2, 3),
v AS (SELECT n.*, a.turbulence AS y0, b.turbulence AS y1, a.bottom AS z0, b.bottom AS z1 FROM n LEFT JOIN points a ON a.transect_id = n.transect_id AND a.ts_s = x0 LEFT JOIN points b ON b.transect_id = n.transect_id AND b.ts_s = x1)
SELECT transect_id, ping_index, round(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x1 <= x0 THEN y0 ELSE y0 + (y1 - y0) / (x1 - x0) * (ts_s - x0) END, 5) AS turbulence,
       round(CASE WHEN x0 IS NULL THEN z1 WHEN x1 IS NULL OR x1 <= x0 THEN z0 ELSE z0 + (z1 - z0) / (x1 - x0) * (ts_s - x0) END, 5) AS bottom FROM v""",
)
def _(t):
    p = pings.as_recordings(pings.good(pings.parse_pings(_rows(t))), _id())
    d = grid.regrid(p)
    pts = line_files.read_lines(t.spark, _line_folder(t)).withColumn("transect_id", F.col("transect_id").cast("long"))
    wide = pts.groupBy("transect_id", "ts_s").pivot("line", ["turbulence", "bottom"]).agg(F.first("depth"))
    d = asof.interpolate_onto(d, wide, ["transect_id"], "ts_s", ["turbulence", "bottom"])
    return d.select(*PK, F.round("turbulence", 5).alias("turbulence"), F.round("bottom", 5).alias("bottom"))


@query(
    "s20_lines_from_masked_files", "samp",
    """,
ck AS (SELECT *, sum(CASE WHEN keep THEN 0 ELSE 1 END) OVER (PARTITION BY transect_id, ping_index ORDER BY j) AS g FROM (SELECT * REPLACE (keep AND v IS NOT NULL AS keep) FROM cell)),
rl AS (SELECT transect_id, ping_index, g, count(*) AS len FROM ck WHERE keep GROUP BY ALL),
sq AS (SELECT ck.*, keep AND (is_upfacing OR len > 1) AS k2 FROM ck LEFT JOIN rl ON rl.transect_id = ck.transect_id AND rl.ping_index = ck.ping_index AND rl.g = ck.g AND ck.keep),
ml AS (SELECT transect_id, ping_index, any_value(ts_s) AS ts_s, min(CASE WHEN k2 THEN depth END) - any_value(depth_stop - depth_start) / 63.0::DOUBLE / 2 AS a, max(CASE WHEN k2 THEN depth END) + any_value(depth_stop - depth_start) / 63.0::DOUBLE / 2 AS b FROM sq GROUP BY 1, 2)
SELECT transect_id, 'turbulence' AS line, ts_s, round(a, 5) AS depth FROM ml UNION ALL SELECT transect_id, 'bottom', ts_s, round(b, 5) FROM ml""",
)
def _(t):
    path = scratch(t.spark, "masked-text")
    m = t.masked.withColumn("sv", F.zip_with("sv", "mask", lambda v, k: F.when(k, v)))
    files.write_text(pings.render_pings(m), path, ["transect_id"], ["seq"])
    p = pings.as_recordings(pings.read_pings(t.spark, path), _id())
    d = line_files.lines_from_masked_pings(p)
    return d.select("transect_id", "line", "ts_s", F.round("depth", 5).alias("depth"))


