import numpy as np
import pytest
from pyspark.sql import functions as F

from pinglake.plans import job
from pinglake.session import scratch
from pinglake.sources import pings


def make_model():
    """Nested, so that it travels to the workers by value."""

    def load():
        def f(signals):
            d = signals.shape[1]
            return {"logits": np.stack([np.where(np.arange(d)[None, :] == c + 3, 8.0, 0.0) + 0 * signals for c in range(10)], axis=1)}

        return f

    return load


model = make_model()


def survey(spark, n=2):
    folder = scratch(spark, "survey")
    rows = [(f"f{t}", i, 1.6e9 + 100 * t + i, 0.5, 16.0, [float(i + j) for j in range(32)]) for t in range(n) for i in range(40)]
    df = spark.createDataFrame(rows, "transect_id string, ping_index long, ts_s double, depth_start double, depth_stop double, sv array<double>")
    for t in range(n):
        text = pings.render_pings(df.where(F.col("transect_id") == f"f{t}")).coalesce(1).orderBy("seq").select("value")
        text.write.text(f"{folder}/sub/f{t}.csv")
    return folder


def listing(spark, folder):
    return sorted((r.path, r.modificationTime) for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime").collect())


def test_whole_job(spark):
    folder, out = survey(spark), scratch(spark, "job")
    # Each input is a folder with one part, which carries its own name.
    kw = dict(extensions=("txt",), autocrop=1, smoothing=(1.0, 0.5), score_options={"height": 32}, region_options={"min_passive": 0, "min_removed": 0})
    dry = job.run_job(spark, folder, out, model, dry_run=True, **kw).collect()
    assert len(dry) == 2 and {r.action for r in dry} == {"process"}
    first = job.run_job(spark, folder, out, model, **kw).collect()
    assert {(r.action, r.n_pings, r.n_present) for r in first} == {("process", 40, 0)}
    names = {r.output for r in job.outputs_in(spark, out).collect()}
    assert len(names) == 8 and all(x.split(".")[-2:] in (["turbulence", "evl"], ["bottom", "evl"], ["surface", "evl"], ["regions", "evr"]) for x in names)
    with pytest.raises(FileExistsError):
        job.run_job(spark, folder, out, model, **kw)
    before = listing(spark, f"{out}/outputs")
    again = job.run_job(spark, folder, out, model, mode="skip", **kw).collect()
    assert {r.action for r in again} == {"skip"} and listing(spark, f"{out}/outputs") == before
    other = job.run_job(spark, folder, out, model, mode="skip", suffix="-b", names=("bottom",), **kw).collect()
    assert {r.action for r in other} == {"process"} and len(job.outputs_in(spark, out).collect()) == 12
    assert set(before) <= set(listing(spark, f"{out}/outputs"))
    job.run_job(spark, folder, out, model, mode="overwrite", **kw)
    now = {r.path: r.modificationTime for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{out}/outputs").select("path", "modificationTime").collect()}
    assert len(job.outputs_in(spark, out).collect()) == 12 and not set(before) & set(now.items())
    one = next(p for p in now if "bottom.evl" in p)
    text = spark.read.text(one).count()
    assert text == 40 + 2 + 2  # points, one more at either end, header and count


def test_bad_files_are_reported(spark):
    folder, out = survey(spark, 1), scratch(spark, "job")
    spark.createDataFrame([("no header, no pings",)], "value string").coalesce(1).write.text(f"{folder}/sub/bad.csv")
    got = job.run_job(spark, folder, out, model, extensions=("txt",), autocrop=1, score_options={"height": 32}).collect()
    assert sorted(r.action for r in got) == ["failed", "process"]
    assert spark.read.parquet(f"{out}/quarantine").count() == 1
