"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` (default 8) select input and cores. Each query
runs once to warm up and once timed; ``BENCH_QUERIES`` may name a comma-separated subset.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from folioscope.registry import all_queries  # noqa: E402
from folioscope.session import get_session  # noqa: E402

HEADLINE = [
    "chunk_documents",
    "bm25_terms",
    "bm25_topk",
    "bm25_hits_mrr",
    "hash_embed",
    "cosine_topk",
    "retrieve_hybrid_rerank",
    "ablation_summary",
    "find_literal",
    "stitch_section",
    "pack_contexts",
    "build_prompts",
    "needs_rewrite",
    "latest_feedback",
    "prune_unrated",
    "route_costs",
    "request_counters",
    "latency_histogram",
    "nearest_rank_quantiles",
    "auroc",
    "compare_judges",
    "furniture",
    "assemble_markdown",
    "windowed_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = get_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    timings: dict[str, float] = {}
    for name in wanted:
        taken = []
        for attempt in range(runs + 1):
            started = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt:
                taken.append(time.perf_counter() - started)
        timings[name] = round(statistics.median(taken), 3)
        print(f"{name} {timings[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries, warm",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
