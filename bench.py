"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import time

from trackgeo.plans.catalog import QUERIES
from trackgeo.session import local_session

HEADLINE = [
    "sliding_windows", "finite_runs", "smooth_in_runs", "gradient_in_runs", "smoothed_target", "local_maxima",
    "nearest_asof", "interval_lookup", "band_join", "one_to_one_join", "merge_report",
    "robust_mad", "quantile_summary", "coverage_rollup", "top_k_per_group", "null_audit",
    "column_baseline", "section_metrics", "components_over_threshold", "melt_pool_features",
    "similarity_to_medoid", "pca_scores", "loto_ridge_metrics", "metrics_by_track",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_suppkey").count().collect()  # warm up the session
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
