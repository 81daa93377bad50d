import pytest
from pyspark.sql import functions as F

from pinglake.functions import text
from pinglake.sources import files, lines, pings, regions
from pinglake.streaming.ingest import ingest, ingested, rejected

HEAD = "﻿Ping_index, Ping_date, Ping_time, Ping_milliseconds, Depth_start, Depth_stop, Vessel\n"


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_read_pings(spark, tmp_path):
    write(tmp_path / "a.csv", HEAD.encode() + b"0, 2020-01-02, 03:04:05, 250.5, 1, 9, Sea, -50.5, 9.9e37, -9.9e+37\n1, 2020-01-02, 03:04:06, 0, 1, 9, Sea, -51\n\xff\xfe, x\n")
    d = pings.read_pings(spark, str(tmp_path)).orderBy("Ping_index").collect()
    assert [r.Ping_index for r in d] == [0, 1]
    assert d[0].sv == [-50.5, None, None] and d[1].sv == [-51.0]
    assert d[0].extra == {"Vessel": "Sea"} and d[0].Latitude is None
    assert d[0].ts_s == pytest.approx(1577934245.2505) and d[0].Depth_stop == 9.0


def test_bad_rows_are_set_apart(spark, tmp_path):
    write(tmp_path / "a.csv", HEAD + "x, 2020-01-02, 03:04:05, 0, 1, 9, Sea, -50\n1, 2020-13-02, 03:04:06, 0, 1, 9, Sea, -51\n2, 2020-01-02, 03:04:06, 0, 1, 9, Sea, -5x\n3, 2020-01-02, 03:04:07, 0, 1, 9, Sea, -5\n")
    write(tmp_path / "b.csv", "1, 2, 3\n")
    p = pings.parse_pings(pings.read_text(spark, str(tmp_path)))
    assert pings.good(p).count() == 1
    assert sorted(r.error for r in pings.quarantine(p).collect()) == ["bad date or time", "file has no header", "metadata field is not a number", "sample is not a number"]
    with pytest.raises(Exception, match="bad input"):
        pings.good(p, "raise").collect()
    n = {r.file.rsplit("/", 1)[1]: (r.n_lines, r.n_pings) for r in pings.count_lines(pings.read_text(spark, str(tmp_path))).collect()}
    assert n == {"a.csv": (5, 4), "b.csv": (1, 0)}


@pytest.mark.parametrize("ending", ["\r\n", "\n"])
def test_lines_round_trip(spark, tmp_path, ending):
    data = [(1, "bottom", 1.6e9 + i, None if i == 2 else 20.0 + i / 8, 3) for i in range(5)] + [(2, "bottom", 1.6e9, 7.0, 3)]
    df = spark.createDataFrame(data, "transect_id long, line string, ts_s double, depth double, status int")
    path = str(tmp_path / "lines")
    lines.write_lines(df.withColumn("depth", F.coalesce("depth", F.lit(-10000.99))), path, pad=True, line_ending=ending)
    got = sorted((int(r.transect_id), r.line, r.ts_s, r.depth, r.status) for r in lines.read_lines(spark, path).na.fill({"depth": -1.0}).collect())
    want = sorted([(a, b, c, -1.0 if d is None else d, e) for a, b, c, d, e in data] + [(1, "bottom", 1.6e9 - 0.5, 20.0, 3), (1, "bottom", 1.6e9 + 4.5, 20.5, 3)])
    assert got == want
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "lines").rglob("part-*")) if "transect_id=1" in str(p))
    first = raw.decode("utf-8-sig").split(ending)
    assert first[0] == "EVBD 3 10.0.270.37090" and first[1] == "7" and first[3] == "20200913 1226400000  20.0 3 "


def test_bad_line_rows(spark, tmp_path):
    write(tmp_path / "x.evl", "EVBD 3 10\r\n3\r\n20200913 1226400000  20.0 3 \r\n20200913 1226400000 x 20.0 3 \r\n20200913 12264\r\n")
    d = lines.read_lines(spark, str(tmp_path), errors="keep")
    assert sorted(r.error or "" for r in d.collect()) == ["", "short row", "third entry is not empty"]
    with pytest.raises(Exception, match="bad line file"):
        lines.read_lines(spark, str(tmp_path)).collect()


def rect(spark):
    d = [(1, "passive", 1, 1.6e9, 1.6e9 + 5, 0.5, 30.0, "Passive 1", "Passive data\nLength in pixels: 5.0", 4, 0), (1, "removed", 1, 1.6e9 + 9, 1.6e9 + 12, 0.5, 30.0, "Removed block 1", "Removed data block", 4, 0)]
    return spark.createDataFrame(d, "transect_id long, kind string, number long, ts_start double, ts_end double, top double, low double, region_name string, notes string, creation_type int, region_type int")


def contour(spark):
    d = [(1, 1, [(1.6e9 + 1, 3.0), (1.6e9 + 2, 4.0), (1.6e9 + 3, 3.5)], "Removed patch\nArea in pixels: 2", "Removed patch 1", 2, 0, 1.6e9 + 1, 1.6e9 + 3, 3.0, 4.0)]
    return spark.createDataFrame(d, "transect_id long, number long, points array<struct<ts_s:double,depth:double>>, notes string, region_name string, creation_type int, region_type int, ts_start double, ts_end double, top double, low double")


@pytest.mark.parametrize("ending", ["\r\n", "\n"])
@pytest.mark.parametrize("whole", [False, True])
def test_regions_round_trip(spark, tmp_path, ending, whole):
    path = str(tmp_path / "r")
    notes = "by hand\r\n\r\nsecond paragraph" if whole else "by hand"
    regions.write_regions(path, rect(spark), contour(spark), common_notes=notes, line_ending=ending)
    d = regions.read_regions(spark, path, line_ending=None if whole else ending).orderBy("number").collect()
    assert [(r.number, r.kind, r.creation_type, r.region_name) for r in d] == [(1, "passive", 4, "Passive 1"), (2, "removed", 4, "Removed block 1"), (3, "patch", 2, "Removed patch 1")]
    assert (d[0].ts_start, d[0].ts_end, d[0].top, d[0].low) == (1.6e9, 1.6e9 + 5, 0.5, 30.0)
    assert [(p.ts_s, p.depth) for p in d[2].points] == [(1.6e9 + 1, 3.0), (1.6e9 + 2, 4.0), (1.6e9 + 3, 3.5)]
    assert all(r.warning is None and r.notes.endswith("second paragraph" if whole else "by hand") for r in d)
    other = regions.read_regions(spark, path, parse=False, line_ending=None if whole else ending)
    assert {r.kind for r in other.collect()} == {"other"}


def test_wrong_line_ending_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "r")
    regions.write_regions(path, rect(spark), contour(spark), line_ending="\n")
    assert regions.read_regions(spark, path, line_ending="\r\n").count() == 3


def test_unsupported_region_version(spark, tmp_path):
    write(tmp_path / "x.evr", "EVRG 7 10\r\n1\r\n\r\n12 4 1 0 4 -1 1 20200913 1226400000  1 20200913 1226450000  2\r\n0\r\n0\r\nU\r\n20200913 1226400000 1 0\r\nn\r\n")
    assert regions.read_regions(spark, str(tmp_path), errors="keep").collect()[0].error == "unsupported region structure"
    with pytest.raises(Exception, match="bad region file"):
        regions.read_regions(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("t,s", [(1.6e9, "20200913 1226400000"), (1.6e9 + 0.99996, "20200913 1226410000"), (1.6e9 + 0.00015, "20200913 1226400002")])
def test_stamp(spark, t, s):
    r = spark.createDataFrame([(t,)], "t double").select(text.stamp("t").alias("s")).collect()[0].s
    assert r == s


def test_find_files(spark, tmp_path):
    for n in ("a.csv", "b.CSV", "c.ev", "sub/d.csv"):
        write(tmp_path / n, "x")
    names = lambda d: sorted(r.path.rsplit("/", 1)[1] for r in d.collect())
    assert names(files.find_files(spark, [str(tmp_path)])) == ["a.csv", "b.CSV", "d.csv"]
    assert names(files.find_files(spark, [str(tmp_path)], recursive=False)) == ["a.csv", "b.CSV"]
    assert names(files.find_files(spark, [str(tmp_path / "sub")], [str(tmp_path / "c.ev")])) == ["c.ev", "d.csv"]
    with pytest.raises(Exception):
        files.find_files(spark, [str(tmp_path / "none")]).collect()


@pytest.mark.parametrize(
    "path,src,out,want",
    [("sub/a.csv", "", "", "sub/a"), ("/src/sub/a.csv", "/src", "/out", "/out/sub/a"), ("/else/a.csv", "/src", "/out", "/out/a"), ("sub/a.b.csv", "/src", "/out", "/out/sub/a.b"), ("sub/a", "/src", "", "/src/sub/a")],
)
def test_destination(spark, path, src, out, want):
    assert spark.createDataFrame([(path,)], "path string").select(files.destination("path", src, out).alias("d")).collect()[0].d == want


def test_partition_lists(spark, tmp_path):
    write(tmp_path / "sets/header.txt", "Filename, Tide\n")
    write(tmp_path / "sets/train.txt", "Survey1_GR1_Sv_raw.csv,Ebb\nSurvey2_GR2_Sv_raw.csv,Flow\n")
    d = files.read_partition_table(spark, str(tmp_path / "sets"), "train")
    got = files.partition_paths(d, True, root="/data/", dataset="mobile", sharded=True).orderBy("recording").collect()
    assert [(r.recording, r.Tide) for r in got] == [("/data_sharded/mobile/Survey1/Survey1_GR1", "Ebb"), ("/data_sharded/mobile/Survey2/Survey2_GR2", "Flow")]
    write(tmp_path / "list/test.txt", " a_Sv_raw.csv \nb\n")
    got = files.partition_paths(files.read_list(spark, str(tmp_path / "list")), False, root="/data", dataset="x").orderBy("recording").collect()
    assert [r.recording for r in got] == ["/data/x/a", "/data/x/b"]


def test_incremental_ingest(spark, tmp_path):
    row = "{}, 2020-01-02, 03:04:05, 0, 1, 9, Sea, -50, -51\n"
    write(tmp_path / "in/a.txt", HEAD + row.format(0) + row.format(1))
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"))
    ingest(*args)
    ingest(*args)
    assert ingested(spark, str(tmp_path / "out")).count() == 2
    write(tmp_path / "in/b.txt", HEAD + row.format(7) + "x" + row.format(8))
    ingest(*args)
    assert sorted(r.Ping_index for r in ingested(spark, str(tmp_path / "out")).collect()) == [0, 1, 7]
    bad = rejected(spark, str(tmp_path / "out")).collect()
    assert [(r.file.rsplit("/", 1)[1], r.raw[:2]) for r in bad] == [("b.txt", "x8")]
    assert all(r.error for r in bad)


JOB = "0a1b2c3d-0000-4000-8000-123456789abc"


def parts(folder):
    """A text in three part files, of which the first has the header, beside a part of another job and a plain file without one."""
    row = "{}, 2020-01-02, 03:04:05, 0, 1, 9, Sea, -50, -51\n"
    write(folder / f"part-00001-{JOB}.c000.txt", HEAD + row.format(0))
    write(folder / f"part-00002-{JOB}.c000.txt", row.format(1) + row.format(2))
    write(folder / f"part-00010-{JOB}.c000.txt", row.format(3))
    write(folder / f"part-00002-{JOB[::-1].replace('-', '0')[:8]}{JOB[8:]}.c000.txt", row.format(4))
    write(folder / "x.txt", row.format(5))


def test_part_files_share_their_header(spark, tmp_path):
    parts(tmp_path / "t=1")
    p = pings.parse_pings(pings.read_text(spark, str(tmp_path)))
    assert sorted((r.Ping_index, r.extra["Vessel"]) for r in pings.good(p).collect()) == [(0, "Sea"), (1, "Sea"), (2, "Sea"), (3, "Sea")]
    assert [r.error for r in pings.quarantine(p).collect()] == ["file has no header"] * 2
    n = sorted((r.file.rsplit("/", 1)[1][:10], r.n_lines, r.n_pings) for r in pings.count_lines(pings.read_text(spark, str(tmp_path))).collect())
    assert n == [("part-00001", 5, 4), ("part-00002", 1, 0), ("x.txt", 1, 0)]


def test_parts_in_different_batches(spark, tmp_path):
    parts(tmp_path / "in [a] b" / "t=1")
    ingest(spark, str(tmp_path / "in \\[a\\] b"), str(tmp_path / "out"), str(tmp_path / "ck"), files_per_batch=1)
    assert sorted(r.Ping_index for r in ingested(spark, str(tmp_path / "out")).collect()) == [0, 1, 2, 3]
    assert sorted(r.raw[0] for r in rejected(spark, str(tmp_path / "out")).collect()) == ["4", "5"]


def test_text_in_part_files_round_trips(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 4).selectExpr("1L AS transect_id", "id AS ping_index", "1.6e9D + id AS ts_s", "0D AS depth_start", "1D AS depth_stop", "array(-50D, -51D) AS sv")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        files.write_text(pings.render_pings(rows), str(tmp_path / "p"), ["transect_id"], ["seq"])
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert len(list((tmp_path / "p" / "transect_id=1").glob("part-*"))) > 1
    assert pings.read_pings(spark, str(tmp_path / "p"), errors="raise").count() == 4000


def test_region_lines_are_split_once(spark, tmp_path):
    regions.write_regions(str(tmp_path / "r"), rect(spark))
    d = regions.read_regions(spark, str(tmp_path / "r"))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    # The header's pattern, the parting of records, and each record's lines, header and points.
    assert plan.count("split(") <= 4, plan.count("split(")
