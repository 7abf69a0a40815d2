"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Each query is planned and run to
completion with every output row produced (the ``noop`` sink), ``BENCH_RUNS`` times (1 by default),
after one light query has warmed the session up.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = """
lag_last_valid rolling_last_n asof_last trailing_window_join history_sequences nearest_date_fill temporal_interpolation
coord_to_station leakage_anti_join neighbor_idw haversine_knn_features season_idw_enrichment poi_radius_features
station_profile station_aux_stats decay_weighted_stats regression_metrics roc_auc spearman_matrix describe_targets
tokenize vocab subsample_frequent skipgram_pairs negative_samples sgns_gradient_step
cosine_top_k analogy_top_k method_blend variance_decompress group_median_impute composite_median link_pairing
chained_regression_impute mutual_information station_ridge permutation_importance
""".split()


def main() -> None:
    from terralex.plans.catalog import QUERIES
    from terralex.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["dedup_keep_first"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {"metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
             "sf": float(found.group(1)) if found else None}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
