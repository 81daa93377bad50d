"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pinglake.catalog import QUERIES  # noqa: E402
from pinglake.fixtures import Tables  # noqa: E402
from pinglake.session import local_session  # noqa: E402

HEADLINE = [
    "flagship_segment_lines", "s2_regrid_mode", "a2_normalise_median_idr", "w1_median_step", "w2_split_gaps_events", "w4_pad_overlap_max", "w5_runs",
    "w7_squash_gaps", "w8_passive_regions", "w9_median_filter_31", "w10_remove_anomalies", "w12_find_passive", "w14_gaussian_time", "w15_boundary_probabilities",
    "w22_fill_holes", "j1_line_onto_pings", "j1_orders_onto_events", "j2_time_regions", "a7_lines_from_mask", "a8_fix_lines", "a13_meters", "a18_echo_integration",
    "a20_label_loss", "p8_passive_interpolate_time", "u4_fill_enclosed", "u5_patch_contours", "u1_score_segments", "s1_read_pings", "s5_write_lines", "r2_split",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    times: dict[str, float] = {}

    def clock(name, fn):
        t0 = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - t0, 3)

    t = Tables(spark, sf_dir)
    spark.range(1000).selectExpr("sum(id)").collect()
    # Storing the recordings with their ping index, once, as an ingest does.
    clock("ingest", lambda: (t.series.count(), t.echo.count()))
    for name in HEADLINE:
        clock(name, lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
