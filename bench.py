"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

QUERIES = [
    "trajectory_categories",
    "consensus_labels",
    "agreement_summary",
    "clean_articles",
    "shaped_records",
    "enriched_posts",
    "text_measures",
    "text_features",
    "share_user_medians",
    "share_projection",
    "weighted_clustering",
    "topic_shapes",
    "centroid_distances",
    "knn_density",
    "geometry_features",
    "transition_costs",
    "topic_matches",
    "reconstructed_topics",
    "topic_lineage",
    "paired_tests",
    "chain_window_counts",
    "bootstrap_interval",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from harbinger.plans import catalog
    from harbinger.session import local_session

    catalog.load()
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["warmup_filter"](spark, sf_dir).collect()  # start the workers
    times = {}
    for name in sys.argv[1:] or QUERIES:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf)}))


if __name__ == "__main__":
    main()
