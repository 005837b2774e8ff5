"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed once, in full, through the ``noop`` sink (no collect to
the driver). There is no warm-up run: numbers are cold end-to-end wall seconds
per query in one session. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lectern.registry import QUERIES  # noqa: E402
from lectern.session import build_session  # noqa: E402

HEADLINE = [
    "knn_topk",          # J2 exact kNN join
    "precision_filter",  # J2 -> F2 -> W5
    "context_text",      # A8
    "chunk_text",        # W1 + W2 + W7
    "enrich_elements",   # P1-P7 + J1
    "page_links",        # P15
    "link_union_dedup",  # U2 + J5
    "cache_replay",      # W6
    "upsert_latest",     # J4 + S7
    "history_last5",     # W4
    "prompt",            # L3: rewrite -> embed -> kNN -> filter -> prompt
    "hash_embed",        # U2
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", "16")))
    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
