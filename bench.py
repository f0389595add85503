"""Times the headline queries; prints one JSON line.

Each query runs RUNS times over whole tables, from the scan to the last row of
its result (written nowhere); the median counts.  The first run also compiles,
so a median of three is of warm runs."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from tidemark.plans.queries import QUERIES

HEADLINE = (
    "aspect_summary", "aspect_trajectory", "top_moves", "drift_reports", "evidence_topk", "fingerprint_groups", "content_hash_dedupe", "sentence_split",
    "token_count", "negated_tokens", "lm_score", "directional_scores", "qa_start", "event_returns", "classification_report", "pricing_summary", "order_rollup",
)


RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    seconds = {}
    for name in HEADLINE:
        took = []
        for _ in range(RUNS):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(median(took), 3)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1], "documents": rows}))


if __name__ == "__main__":
    main()
