from pyspark.sql import functions as F

from pinglake.operators import lines, masks, patches
from pinglake.session import cut


def test_an_exploded_mask_is_worked_out_once(spark):
    """No filter by the mask's size, which would work out the mask again below, and its sources per element."""
    d = spark.range(3).withColumns({"raw": F.expr("array(1.0D, 2.0D, 3.0D, 4.0D)"), "depth_start": F.lit(0.0), "depth_stop": F.lit(3.0), "turbulence": F.lit(0.5), "bottom": F.lit(2.5), "surface": F.lit(0.0)})
    d = d.withColumns({"sv": F.transform("raw", lambda x: x + F.col("id")), "is_passive": F.col("id") == 1, "is_removed": F.lit(False)})
    d = d.withColumn("mask_patches", F.transform("sv", lambda x: x < 0))
    d = masks.keep_mask(lines.line_masks(d)).select("id", F.posexplode("mask").alias("j", "keep"))
    assert "Filter" not in d._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.id, r.j) for r in d.where("keep").collect()} == {(i, j) for i in (0, 2) for j in (1, 2)}
    assert d.count() == 12


def test_masks_that_pack_tightly_are_labelled_in_many_tasks(spark):
    """A group per chunk, all of them a few kilobytes: still a task for each core."""
    d = spark.range(4000).select(F.lit(1).alias("transect_id"), F.col("id").alias("ping_index"), F.array_repeat(F.col("id") % 3 == 0, 64).alias("m"))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        lab = cut(patches.label_cells(d, "m", chunk=16).withColumn("task", F.spark_partition_id()), "tasks")
        assert lab.select("task").distinct().count() >= 2 and lab.count() == 4000
        assert lab.where((F.get("labels", F.lit(63)) > 0) != (F.col("ping_index") % 3 == 0)).isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
