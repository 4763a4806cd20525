"""Hashed search against the exact scan as the data grows.

The stored vectors of one scale factor are multiplied by turning their components
(each turn is a new vector with the same statistics), the queries stay the same.
Settings come from the collision model, for a recall of 95 % of the planted neighbours.
Prints one JSON line per size, with the bytes that a search shuffles (from Spark's event log).
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from registered import common
from vicinal.operators import search, tuning
from vicinal.plans.jobs import index_vectors
from vicinal.plans.sizing import work_path
from vicinal.session import local_session
from vicinal.sources.vector_store import load_vectors, save_vectors

RADIUS = 0.9
#: Distance of a planted query from its vector, and how many of them are to be found.
PLANTED, RECALL = 0.162, 0.95
#: Bucket length of the comparator, and the largest size that it is run at.
ML_WIDTH, ML_TURNS = 0.1, 10


def grown(spark, sf_dir: str, turns: int):
    """``turns`` copies of every vector, the r-th turned by r and, from round to round,
    with the signs of a different set of components changed."""
    turn = F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("r")
    many = common.vectors(spark, sf_dir).repartition(8).select("vec_id", "v", turn)
    by, rounds = F.col("r") % common.DIMENSION, F.floor(F.col("r") / common.DIMENSION)
    turned = F.concat(F.slice("v", by + 1, common.DIMENSION), F.slice("v", F.lit(1), by))
    turned = F.transform(turned, lambda x, i: F.when((i + 1) * rounds % 3 == 1, -x).otherwise(x))
    return many.select((F.col("vec_id") * turns + F.col("r")).alias("vec_id"), turned.alias("v"))


def clock(f):
    start = time.perf_counter()
    result = f()
    return result, round(time.perf_counter() - start, 2)


def drained(make) -> float:
    """Best of two runs, planning included."""
    runs = (clock(lambda: make().write.format("noop").mode("overwrite").save())[1] for _ in range(2))
    return min(runs)


def shuffled(spark) -> int:
    """Bytes that all stages so far have written to shuffles."""
    total = 0
    for path in glob.glob(f"{spark.conf.get('spark.eventLog.dir').removeprefix('file://')}/*"):
        with open(path) as log:
            for event in (json.loads(line) for line in log if "SparkListenerStageCompleted" in line and line.endswith("}\n")):
                for a in event["Stage Info"]["Accumulables"]:
                    if a["Name"] == "internal.metrics.shuffle.write.bytesWritten":
                        total += int(a["Value"])
    return total


def moved(spark, make) -> float:
    """MB that one run shuffles."""
    before = shuffled(spark)
    make().write.format("noop").mode("overwrite").save()
    time.sleep(1)  # for the log
    return round((shuffled(spark) - before) / 1e6, 1)


def measure(spark, sf_dir: str, turns: int) -> dict:
    path = work_path(spark, "vectors")
    save_vectors(grown(spark, sf_dir, turns), path, parts=16)
    vectors = load_vectors(spark, path)
    queries = common.queries_of(spark, sf_dir).withColumn("query_id", F.col("query_id") * turns).cache()
    n_queries, n_vectors = queries.count(), vectors.count()
    tuned = tuning.tune(tuning.sampled_pairs(vectors, common.DIMENSION), PLANTED, common.DIMENSION, RECALL, max_tables=15, seed=7)
    params = tuned.params
    index, build = clock(lambda: index_vectors(vectors, params, work_path(spark, "index"), parts=4))
    pairs = search.candidates(index, queries).count()
    hashed_search = lambda: search.radius_search(index, vectors, queries, RADIUS)
    exact_search = lambda: search.exact_radius_search(
        vectors, queries, RADIUS, common.DIMENSION
    )
    hashed, exact = drained(hashed_search), drained(exact_search)
    found, truth = hashed_search(), exact_search()
    planted = found.filter("query_id = vec_id").count()
    return {
        "vectors": n_vectors,
        "queries": n_queries,
        "functions": params.num_functions,
        "width": round(params.bin_length, 3),
        "tables": len(params.family().tables),
        "model": {"recall": round(tuned.recall, 4), "share_of_pairs": float(f"{tuned.load:.2g}")},
        "share_of_pairs": float(f"{pairs / n_queries / n_vectors:.2g}"),
        "hashed_mb_shuffled": moved(spark, hashed_search),
        "exact_mb_shuffled": moved(spark, exact_search),
        "build_and_save_sec": build,
        "hashed_sec": hashed,
        "exact_sec": exact,
        "candidates_per_query": round(pairs / n_queries, 1),
        "planted_recall": round(planted / n_queries, 4),
        "found": found.count(),
        "truth": truth.count(),
    } | (comparator(vectors, queries, ML_WIDTH, 10) if turns <= ML_TURNS else {})


def comparator(vectors, queries, width: float, tables: int) -> dict:
    """Spark ML's random projection index on the same task: one function a table."""
    left = vectors.select("vec_id", array_to_vector("v").alias("x"))
    right = queries.select("query_id", array_to_vector("qv").alias("x"))
    model = BucketedRandomProjectionLSH(
        inputCol="x", outputCol="h", bucketLength=width, numHashTables=tables, seed=7
    ).fit(left)

    def near():
        return model.approxSimilarityJoin(left, right, RADIUS, "distance").select(
            "datasetA.vec_id", "datasetB.query_id", "distance"
        )

    return {
        "ml_width": width,
        "ml_sec": drained(near),
        "ml_planted_recall": round(near().filter("query_id = vec_id").count() / queries.count(), 4),
    }


if __name__ == "__main__":
    log = tempfile.mkdtemp(prefix="events-")
    settings = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{log}", "spark.eventLog.compress": "false"}
    spark = local_session("8", **settings, **{"spark.eventLog.rolling.enabled": "false", "spark.eventLog.buffer.kb": "1k"})
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    sizes = [int(x) for x in sys.argv[1:]] or [1, 10, 60]
    for turns in sizes:
        print(json.dumps(measure(spark, sf_dir, turns)), flush=True)
