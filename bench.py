"""Time the headline queries and print one JSON line.

Settings come from the environment: ``BENCH_SF_DIR``, ``BENCH_CPUS``,
``BENCH_QUERIES`` (comma separated) and ``BENCH_RUNS``, the number of runs of which the
median counts; a query that takes longer than ``BENCH_LONG`` seconds runs once. Each
query is planned and run from the raw tables every time; its rows are produced in full
and thrown away.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = (
    "npmi_edges", "npmi_edges_docs", "quartiles_lower", "recommend_diverse", "recommend_orders", "lanes",
    "loo_scores", "merge_chains", "curate_edges", "max_merge", "phrase_cascade", "coverage_budget",
    "taxonomy_full", "match_gate", "pairing_fit", "search_items", "eval_pool", "eval_metrics", "decision_lww",
    "quality_graph", "quality_baskets", "media_rank", "slug_coverage", "basket_matches", "basket_match_score",
    "translation_delta", "word_forms", "dup_groups_words",
)


def main() -> None:
    from cobasket import build_session
    from cobasket.plans import catalogue

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    long = float(os.environ.get("BENCH_LONG", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = build_session(
        f"local[{cpus}]", "bench",
        **{
            "spark.sql.shuffle.partitions": str(max(8, int(cpus))), "spark.driver.memory": "16g",
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed query loads the JVM's classes.
    catalogue.QUERIES["popularity"](spark, sf_dir).collect()
    took = {}
    for name in names:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
            if times[0] > long:
                break
        took[name] = round(statistics.median(times), 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    total = round(sum(took.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
