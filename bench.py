"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local threads. Every query runs to its end with a sink that keeps nothing, after
one untimed query that starts the engine.
"""

from __future__ import annotations

import json
import os
import sys
import time

from gridweather import session
from gridweather.plans import catalog

HEADLINES = [
    "flagship_band_temperature", "scl9_weather_features", "scl22_state_key", "flt3_strict_records", "join1_nearest_column", "join4_time_blend",
    "join5_exact_lookup", "join6_column_lookup", "join7_profile_resample", "join9_exact_else_model", "join12_as_of", "join15_nearest_vectors",
    "join16_weather_estimate", "agg5_detailed_metrics", "agg7_overall_and_bands", "agg10_class_confusion", "agg12_roc_curve",
    "agg14_permutation_importance", "agg22_access_summary", "win1_running_counts", "win5_resample", "win6_thin_by_distance", "win8_state_changes",
    "set2_upsert", "smp2_stratified_draws", "smp6_ratio_split", "smp10_latin_hypercube", "mlr3_evaluate", "str2_rate_windows",
]


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINES
    spark = session.build("bench", cpus, spark__sql__shuffle__partitions=cpus if cpus.isdigit() else "8", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    queries["scl1_longitude_fold"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in wanted:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
