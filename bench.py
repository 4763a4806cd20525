"""Time the headline queries; prints one JSON line.

Each query is run once to warm up (code generation, Python workers) and then timed
twice to a no-op sink, which computes every row and column; the best time counts.
"""

from __future__ import annotations

import json
import os
import time

from registered import keyed_queries, search_queries, vector_queries
from vicinal.session import local_session

HEADLINE = [
    "range_search_lsh_dist",
    "range_search_exact",
    "knn_lsh",
    "lsh_candidates",
    "lsh_recall",
    "lsh_postings",
    "bucket_keys",
    "index_save_load",
    "range_search_saved_index",
    "stream_radius_search",
    "load_text_vectors",
    "keyed_last_wins",
    "keyed_fold",
    "keyed_fold_builtin",
    "keyed_collect_list",
    "keyed_aggregate",
    "keyed_multiget",
    "keyed_upsert_merge",
    "keyed_delete",
    "keyed_full_outer_join",
    "keyed_update_join",
    "keyed_update_join_ordered",
    "keyed_diff",
]


def timed(run, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    queries = {**search_queries.R.queries, **vector_queries.R.queries, **keyed_queries.R.queries}
    times = {}
    for name in names.split(",") if names else HEADLINE:
        timed(queries[name], spark, sf_dir)
        times[name] = round(min(timed(queries[name], spark, sf_dir) for _ in range(2)), 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
