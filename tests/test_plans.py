"""Plans: blocks are the shuffle key, columns are pruned, nothing is joined by nested loops."""

import pytest
from pyspark.sql import functions as F

from pinglake.catalog import QUERIES
from pinglake.operators.blocks import scan, shift
from pinglake.session import cut

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark):
    d = spark.range(100).select(F.lit(1).cast("long").alias("transect_id"), F.col("id").alias("ping_index"), F.rand(1).alias("v"), F.rand(2).alias("unused"))
    return cut(d)


@pytest.mark.parametrize("op", ["scan", "shift"])
def test_windows_shuffle_by_block(stored, op):
    d = stored.drop("unused")
    out = scan(d, ["transect_id"], ["ping_index"], {"s": ("sum", "v")}) if op == "scan" else shift(d, ["transect_id"], {"p": ("v", 1)})
    lines = [x for x in plan(out).split("\n") if "Window [" in x]
    detail = [x for x in lines if "_block" in x.split("windowspecdefinition(")[1].split(" ASC")[0]]
    assert detail
    assert "unused" not in plan(out)


@pytest.mark.parametrize("name", ["j1_line_onto_pings", "j2_time_regions", "j4_index_ranges", "w4_pad_overlap_all", "a13_meters", "a18_echo_integration", "r2_split", "j7_existing_outputs", "w12_find_passive"])
def test_no_nested_loops(spark, name):
    p = plan(QUERIES[name](spark, SF))
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_filters_reach_the_scan(spark):
    d = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 5").select("vec_id")
    p = plan(d)
    assert "LessThan(vec_id,5)" in p and "embedding" not in p.split("ReadSchema")[1]
