"""Times the headline queries and prints one JSON line: the median of `BENCH_RUNS` (3) runs of each.

`similar_to` builds its vector index in the first run and looks it up in the others."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from workload import QUERIES  # noqa: E402

HEADLINE = [
    "duplicate_report", "exact_duplicates", "list_content", "keyword_hits", "quality_rules", "quality_features",
    "sentiment", "summaries", "tfidf_top_terms", "similar_to", "near_duplicate_pairs", "similarity_groups",
    "source_status", "source_health", "selector_scores", "training_retention", "feed_items", "robots_allowed",
    "page_blocks", "extract_with_selectors", "append_new_content", "near_duplicate_pairs_min_hash", "topic_model_words",
    "quality_model_metrics", "adaptive_articles", "selector_matches",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # start the engine
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    times = {}
    for name in only:
        taken = []
        for _ in range(runs):
            begin = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - begin)
        times[name] = round(statistics.median(taken), 3)
        print(name, times[name], [round(t, 3) for t in taken], file=sys.stderr)
    print(json.dumps({
        "metric": "headline queries, total wall time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
