"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once for warm-up and then RUNS times; the median counts. Results are written to the noop sink, so every row is made.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from evergrain.plans import catalog
from evergrain.session import local_session

HEADLINE = (
    "bm25_topk", "cosine_topk", "rrf_fusion", "content_dedupe_topk", "legacy_relevance_topk", "serving_inventory", "belief_fold", "belief_fold_asof", "writer_health",
    "sft_segments", "near_dup_first_wins", "pack_select", "decayed_label_fold", "first_event_24h", "tripwire_flags", "ttl_prune", "promote_score_topk", "heal_conflicts", "rel_pricing_summary",
    "indexed_bm25_topk", "cell_neighbours",
)
RUNS = int(os.environ.get("BENCH_RUNS", "1"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        took = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(took[1:]), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
