"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS and BENCH_QUERIES (comma-separated) set the
data, the cores, the runs per query (the best one counts) and the choice of queries.
"""

from __future__ import annotations

import json
import os
import time

import pyspark

from catalog.queries import QUERIES
from surveyloom.session import local_session

HEADLINE = [
    "qa_coverage_bands", "qb_likert_by_zone", "qc_heatmap_cells", "qd_species_change", "qe_gear_rotation",
    "qe_gear_rotation_parity", "qf_pie_donut", "likert_items", "ordinal_density", "complete_cells",
    "complete_cells_long_domain", "densify", "densify_attributes", "share_in_group", "share_external_denominator",
    "pivot_wide", "unpivot_long", "left_join_one", "left_join_composite", "merge_left_suffix", "rollup_zone",
    "apply_columns", "level_domain_report", "contradictory_items", "rescale_area", "quoted_values",
    "sink_csv_indexed", "sink_partitioned",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES")
    spark = local_session(cpus, shuffle_partitions=cpus)
    spark.range(1000).selectExpr("sum(id)").collect()

    timings = {}
    for name in chosen.split(",") if chosen else HEADLINE:
        best = float("inf")
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        timings[name] = round(best, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total seconds, headline survey queries, best run each", "value": round(sum(timings.values()), 3),
        "unit": "sec", "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus, "runs": runs,
        "spark": pyspark.__version__, "shuffle_partitions": cpus,
    }))


if __name__ == "__main__":
    main()
