"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: The engine's headline queries; each is written to Spark's noop sink, so that all of it is computed.
NAMES = ["bm25_topk", "bm25_multi_query", "bm25_phrase", "dense_topk", "hybrid_rrf", "federated_quota", "context_budget", "text_functions", "page_offsets", "chapters", "chunks", "anchor_check", "knowledge_claims", "html_markdown"]


def main() -> None:
    from pyspark.sql import SparkSession

    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "4")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from vellum.plans import registry

    took = {}
    for name in NAMES:
        began = time.time()
        registry.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    sf = re.search(r"sf([0-9.]+)", d)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else None}))


if __name__ == "__main__":
    main()
