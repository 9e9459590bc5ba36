"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from msgrisk.catalog import QUERIES
from msgrisk.session import build_session

HEADLINE = [
    "family_dedup_counts", "family_keep_first", "reference_overlap", "fold_assignment", "stratified_split",
    "pr_curve", "roc_auc", "threshold_at_fpr", "evaluation_cube", "regression_gate", "dataset_fingerprint",
    "latency_stats", "correlation_matrix", "sender_episodes", "sliding_rate", "daily_quota", "event_transitions",
    "minute_windows", "keyword_rules", "text_signals", "page_visible_text", "page_links", "link_findings",
    "sender_features", "tfidf_terms", "analyze_documents", "out_of_fold_scores", "tabular_importances",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/nation.parquet").groupBy("n_regionkey").count().collect()  # start the JVM threads
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        if name not in QUERIES:
            continue
        runs = []
        for _ in range(repeats):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
        print(name, *[round(r, 2) for r in runs], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
