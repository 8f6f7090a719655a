"""Headline queries at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from speechtab.plans import catalog  # noqa: E402
from speechtab.session import local_session  # noqa: E402

HEADLINE = (
    "error_rates_by_split", "feasibility_report", "manifest", "transcripts_from_lines",
    "interval_checks", "split_assignment", "media_pairing", "fallback_boxes", "gap_fill",
    "similarity_fit", "greedy_decode_by_steps", "ngram_counts", "kneser_ney_model", "grid_rates",
    "early_stopping", "epoch_batches", "padded_batches", "inventory_reconciliation", "sentence_scores",
    "incremental_intake",
)


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", **{"spark.sql.shuffle.partitions": cpus})
    # Start the workers before the clock runs.
    catalog.QUERIES["distinct_speakers"](spark, root).collect()
    seconds = {}
    for name in HEADLINE:
        begin = time.time()
        catalog.QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - begin, 3)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(root.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
