"""Headline queries, timed end to end; prints one JSON line.

BENCH_SF_DIR is the table folder, BENCH_CPUS the number of local cores. Each query runs once to warm up and then
BENCH_RUNS times; the median counts. Results go to a sink that reads every row.
"""

import json
import os
import statistics
import sys
import time

import catalog
from catalog.views import build_entity_scores
from revgauge.operators.ranking import leaderboard
from revgauge.session import local_session

HEADLINE = [
    "clean_text", "strip_prompts", "remove_entity_name", "lexical_top_ngrams", "top_tokens", "ngrams",
    "explode_sentences", "encode_text", "quality_summary", "missing_report", "eda_summary", "coverage",
    "reviews_over_time", "token_coverage_curve", "review_hash", "keep_first_dedup", "incremental_append",
    "entity_mean_vector", "entity_weighted_vector", "entity_weighted_stats", "review_scores", "macro_totals",
    "evidence_topk", "percentile_rank_ties", "enrich_scores", "premier_percentiles", "leaderboard", "pool_dim_stats",
    "method_breakpoints", "head_to_head", "method_overlap", "similar_reviews", "cluster_representatives",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    chosen = sys.argv[1:] or [*HEADLINE, "build_entity_scores", "full_leaderboard"]
    jobs = {name: catalog.QUERIES[name] for name in chosen if name in catalog.QUERIES}
    if "build_entity_scores" in chosen:
        # what the ranking queries below read from the stored table
        jobs["build_entity_scores"] = build_entity_scores
    if "full_leaderboard" in chosen:
        # no stored stage: vectors, roll-ups, scores and ranks in one plan
        jobs["full_leaderboard"] = lambda s, d: leaderboard(build_entity_scores(s, d))
    times = {}
    for name, job in jobs.items():
        taken = []
        for i in range(runs + 1):
            start = time.perf_counter()
            job(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name}: first {taken[0]:.2f}s then {times[name]:.2f}s", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus}))


if __name__ == "__main__":
    main()
