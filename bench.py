"""Headline queries, timed: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores,
BENCH_ROUNDS (default 1) the number of runs whose median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "e21_bar_table", "o3_top_n_other", "w7_to_relative", "e2_e3_e4_diversity", "e1_rarefy", "e6_bray_curtis",
    "e8_unifrac", "e15_permanova", "e16_permanova_factorial_blocked", "e14_dispersion_centroid", "h1_factor_model",
    "h7_h8_intervals_flagged", "v2_tmm_factors", "v4_contrasts", "v7_bh_adjust", "v11_log_linear_bc", "a14_box_stats",
    "z3_quality_profile", "z6_dereplicate", "z8_sketch", "z13_sketch_compare", "z19_coverage", "z22_tpm",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("fenloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from fenloom.plans import QUERIES

    only = sys.argv[1:] or HEADLINE
    # start the Python workers and the code generator outside the timings
    spark.range(1000).repartition(int(cpus)).mapInPandas(lambda it: it, "id long").count()
    QUERIES[only[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    rounds = int(os.environ.get("BENCH_ROUNDS", "1"))
    times = {}
    for name in only:
        took = []
        for _ in range(rounds):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(took), 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
