"""Times the headline queries once each and prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from quillspan.plans.queries import QUERIES

HEADLINE = ["bm25_topk", "bm25_document_frequency", "knn_topk", "knn_batch", "fusion_rrf", "tiered_merge", "branch_delta", "catalog_stats", "upsert_latest", "gc_orphan_chunks", "resolved_edges", "centrality", "reachability", "couplings_given_labels", "pr_impact_risk", "line_chunks", "coverage_sample", "eval_hit_mrr", "telemetry_histograms", "debounce_sessions"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # the session's start isn't a query's time
    times = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
