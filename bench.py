"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is forced with a ``noop`` write (full computation, nothing
collected).  ``value`` is the sum of the per-query wall times.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "m7_fit",               # documents -> TF-IDF -> PCA -> k-means -> silhouette -> cards
    "t5_tfidf",             # smoothed TF-IDF long table
    "l4_cluster_cards",     # per-cluster top words, samples, labels
    "a12_word_counts",      # word occurrences per cluster
    "m6_silhouette",        # exact euclidean silhouette
    "c1_scatter_table",     # chart table with joins
    "g17_emit_records",     # grid state machine over conversations
    "a7_crosstab_category", # pivot
]


def main() -> None:
    from shoal.plans.queries import QUERIES
    from shoal.session import ensure_checkpoint_dir, get_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("shoal-bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    ensure_checkpoint_dir(spark)
    times: dict[str, float] = {}
    for name in HEADLINE:
        if name not in QUERIES:
            continue
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
