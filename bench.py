"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  input folder (default /root/testdata/sf0.1)
BENCH_CPUS    local task slots (default 8)
BENCH_RUNS    timed runs per query after one warm-up; the best counts. Training runs once.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from broadsheet import catalog  # noqa: E402
from broadsheet.session import build_session  # noqa: E402

HEADLINE = (
    "article_analysis", "article_analysis_folded", "sentences", "tokens",
    "biased_sentences", "biased_sentences_by_owner", "propaganda_sentences",
    "detect_techniques", "normalize_tokens", "term_stats", "tfidf", "ctfidf",
    "entities_gazetteer", "annotated_text", "compare_articles", "page_articles",
    "page_text", "classification_report", "history_sorted", "source_edges",
)
# Trained to tolerance, which takes long: timed once, without a warm-up.
ONCE = ("propaganda_lr", "train_techniques")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": str(2 * int(cpus)),
           "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
           "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE + ONCE
    times = {}
    for name in names:
        best = None
        for run in range(1 if name in ONCE else runs + 1):
            start = time.perf_counter()
            result = catalog.QUERIES[name](spark, sf_dir)
            result.write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if run:
                best = took if best is None else min(best, took)
        times[name] = round(best if best is not None else took, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
