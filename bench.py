"""Headline queries, timed once each after a warm-up; prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

NAMES = (
    "degrees", "edge_distance", "edge_flags", "distance_percentiles", "best_move_unconstrained", "best_move_constrained", "accept_moves", "contract",
    "modularity", "constraint_audit", "community_diameter", "pred_hybrid", "pred_triangle_hybrid", "nn_summary", "knn_edges",
    "louvain_pure", "louvain_plus_plus", "louvain_hybrid", "louvain_vectors", "leiden_constrained",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from kinfold.plans.catalogue import QUERIES

    QUERIES["degrees"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in NAMES:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
