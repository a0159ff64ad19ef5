"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once and fully executed into Spark's no-op sink, so nothing
is collected to the driver. Before timing, two queries run untimed on the
smallest scale factor (when present) to start the JVM's JIT and the Python
workers; the timed runs read only ``$BENCH_SF_DIR``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from colscope.plans.registry import QUERIES  # noqa: E402
from colscope.session import local_session  # noqa: E402

HEADLINE = [
    "profile_all",          # P3-P10: stats + exact distincts of 15 tables in one job, samples
    "inclusion_keys",       # P8: FK candidates over all tables
    "enum_values",          # P9
    "catalog_roundtrip",    # P10 -> A3 -> C1/C2
    "index_items",          # D1-D3, V3
    "cosine_topk",          # V2 dense, every embedding against all items
    "score_fusion",         # V4-V6
    "ambiguity",            # V8
    "cosine_topk_sparse",   # V1 + V2 sparse: benchmark against documents
    "examples_search",      # E2
    "guard_summary",        # G1-G4 over the SQL log
    "reconcile_totals",     # G7
    "pass_join",            # G6 pass-through
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, app="colscope-bench")
    # each table here is one file of one row group: deal its rows to all cores
    spark.conf.set("spark.colscope.inputPartitions", cpus)
    spark.conf.set("spark.sql.shuffle.partitions", str(max(8, int(cpus))))
    # warm-up (not timed): JIT and Python workers, on the smallest data available
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    warm = warm if os.path.isdir(warm) else sf_dir
    for name in ("profile_all", "cosine_topk"):
        QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
