"""Nearest neighbours by query-directed probing of neighbouring buckets, until there are enough candidates.

A query's own buckets may hold fewer than ``k`` vectors.  A neighbour that missed them most likely lies
just across the edge of a bin, so buckets are probed in the order of the query's distance to the edges that lead to
them.  Only queries that are still short of candidates go on to the next round; what is short after the last
one is answered by an exact scan, so that every query has ``k`` answers where the table has them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vicinal.functions.hashing import HashFamily, matrix
from vicinal.functions.vectors import L2, Metric
from vicinal.operators.index import LshIndex, key_part
from vicinal.operators.search import Asked, _few, _identified, measured
from vicinal.plans.sizing import cut_lineage, row_budget, share, work_path
from vicinal.plans.skew import spread

#: Buckets probed for a query up to the end of each round, as multiples of the number of tables.
ROUNDS = (1, 4, 16)
#: Bins changed at once by a probe.
CHANGES = 2


def perturbations(functions: int, changes: int = CHANGES) -> list[tuple[tuple[int, int], ...]]:
    """Sets of ``(function of the table, step of its bin)``, the empty one first."""
    found: list[tuple[tuple[int, int], ...]] = [()]
    for n in range(1, min(changes, functions) + 1):
        for chosen in combinations(range(functions), n):
            found += [tuple(zip(chosen, steps)) for steps in product((-1, 1), repeat=n)]
    return found


def probe_order(family: HashFamily, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """``(signatures, tables, perturbations)`` of every query's probes by rising cost, and the perturbations.

    The cost of a probe is the sum of the squared distances to the edges that it crosses.
    """
    projections = x @ family.a.T
    if family.b is None:
        sig = (projections > 0).astype(np.int64)
        # Only the other side can be probed.
        down, up = np.where(sig == 1, projections**2, np.inf), np.where(sig == 0, projections**2, np.inf)
    else:
        place = (projections + family.b) / family.bin_length
        sig = np.floor(place).astype(np.int64)
        down, up = ((place - sig) * family.bin_length) ** 2, ((sig + 1 - place) * family.bin_length) ** 2
    groups = family.groups
    chosen = [groups[i] + groups[j] for i, j in family.tables]
    patterns = perturbations(family.num_functions)
    cost = np.zeros((len(x), len(chosen), len(patterns)))
    for t, members in enumerate(chosen):
        for p, pattern in enumerate(patterns):
            for slot, step in pattern:
                cost[:, t, p] += (down if step < 0 else up)[:, members[slot]]
    cost[:, :, 0] = -1  # a query's own buckets come first, also ahead of those across an edge it lies on
    flat = cost.reshape(len(x), -1)
    order = np.argsort(flat, axis=1, kind="stable")
    order = np.where(np.isfinite(np.take_along_axis(flat, order, 1)), order, -1)
    return sig, order // len(patterns), np.where(order < 0, -1, order % len(patterns)), patterns


def probe_keys(queries: DataFrame, family: HashFamily, first: int, last: int) -> DataFrame:
    """``(query_id, table_id, bins)`` of every query's probes from ``first`` up to ``last`` times the number of
    tables, which is that of the query's own buckets."""
    dimension, tables = family.dimension, len(family.tables)
    groups = family.groups
    chosen = np.array([groups[i] + groups[j] for i, j in family.tables])
    begin, end = first * tables, last * tables
    id_type = queries.schema["query_id"].dataType.simpleString()

    def keys(batches):
        for whole in batches:
            # The costs of a part of the batch are held at a time.
            for s in range(0, len(whole), 256):
                batch = whole.slice(s, 256)
                x = matrix(batch.column("qv"), dimension)
                sig, table, pattern, patterns = probe_order(family, x)
                table, pattern = table[:, begin:end], pattern[:, begin:end]
                row, column = np.nonzero(pattern >= 0)
                t, p = table[row, column], pattern[row, column]
                bins = np.take_along_axis(sig[row], chosen[t], 1)
                steps = np.zeros((len(patterns), family.num_functions), np.int64)
                for i, changed in enumerate(patterns):
                    for slot, step in changed:
                        steps[i, slot] = step
                bins += steps[p]
                ends = np.arange(0, bins.size + 1, family.num_functions, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("query_id").take(pa.array(row)),
                        pa.array(t.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(bins.ravel())),
                    ],
                    names=["query_id", "table_id", "bins"],
                )

    return queries.mapInArrow(keys, f"query_id {id_type}, table_id int, bins array<bigint>")


def exact_knn_search(vectors: DataFrame, queries: DataFrame, k: int, dimension: int, metric: Metric = L2) -> DataFrame:
    """The ``k`` nearest of all vectors for every query, ties by id: ``(query_id, vec_id, distance, rank)``.

    The vectors stay in place and meet the queries block by block; a task keeps its own best ``k`` of
    each query.
    """
    vectors, queries = _identified(vectors.select("vec_id", "v"), "vec_id"), _identified(queries.select("query_id", "qv"), "query_id")
    kinds = [queries.schema["query_id"].dataType.simpleString(), vectors.schema["vec_id"].dataType.simpleString()]
    schema = "query_id {}, vec_id {}, distance DOUBLE".format(*kinds)
    rows = row_budget(8 * dimension + 24 * k, 16 * 1024 * 1024)
    if _few(queries, rows):
        block = queries.toArrow().combine_chunks()
        near = vectors.mapInArrow(_best_of(share(vectors.sparkSession, block), k, dimension, metric), schema)
    else:
        spark, queries = vectors.sparkSession, cut_lineage(queries)
        found, blocks = work_path(spark, "nearest"), -(-2 * queries.count() // rows)
        for i in range(blocks):
            dealt = queries.filter(F.pmod(spread(F.xxhash64("query_id")), F.lit(blocks)) == i)
            sent = share(spark, dealt.toArrow().combine_chunks())
            vectors.mapInArrow(_best_of(sent, k, dimension, metric), schema).write.mode("append").parquet(found)
            sent.unpersist()
        near = spark.read.schema(schema).parquet(found)
    return _nearest(near, k, metric)


def _nearest(near: DataFrame, k: int, metric: Metric) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(metric.nearest_first(F.col("distance")), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _best_of(shared, k: int, dimension: int, metric: Metric):
    def scan(batches):
        held = shared.value
        if not held.num_rows:
            return
        query_ids = held.column("query_id").combine_chunks()
        q = matrix(held.column("qv").combine_chunks(), dimension)
        best = None  # per query the ids and measures of its best so far
        for batch in batches:
            # Equal measures are settled by id: rows in order of their id, and stable sorts.
            for s in range(0, len(batch), 1024):
                part = batch.slice(s, 1024)
                x, ids = matrix(part.column("v"), dimension), part.column("vec_id")
                measure = metric.block(x, q).T
                key = np.where(np.isnan(measure), np.inf, measure if metric.smaller_is_nearer else -measure)
                if best is not None:
                    key, measure = np.hstack([best[1], key]), np.hstack([best[2], measure])
                    pool = [pa.concat_arrays([old, ids]) for old in best[0]]
                else:
                    pool = [ids] * len(q)
                taken_ids, taken_key, taken = [], [], []
                for row, (k_row, m_row, p_row) in enumerate(zip(key, measure, pool)):
                    least = np.flatnonzero(k_row <= np.partition(k_row, min(k, len(k_row)) - 1)[min(k, len(k_row)) - 1])
                    names = p_row.take(pa.array(least))
                    order = np.lexsort((np.argsort(np.argsort(names.to_numpy(zero_copy_only=False), kind="stable")), k_row[least]))[:k]
                    taken_ids.append(names.take(pa.array(order)))
                    taken_key.append(k_row[least][order])
                    taken.append(m_row[least][order])
                best = taken_ids, np.array(taken_key), np.array(taken)
        if best is not None:
            n = best[1].shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    query_ids.take(pa.array(np.repeat(np.arange(len(q)), n))),
                    pa.concat_arrays(best[0]),
                    pa.array(best[2].ravel(), from_pandas=True),
                ],
                names=["query_id", "vec_id", "distance"],
            )

    return scan


def probed_candidates(index: LshIndex, queries: DataFrame, first: int, last: int) -> DataFrame:
    """Distinct ``(query_id, vec_id)`` of the vectors in the probed buckets."""
    family = index.family
    keys = probe_keys(queries, family, first, last)
    on = ["table_id", "bins"]
    if index.parts:
        keys, on = keys.withColumn("part", key_part(F.col("bins"), family, index.parts)), [*on, "part"]
    small = _few(queries.select("query_id"), row_budget(16 * (family.num_functions + 8) * (last - first) * len(family.tables)))
    keys = F.broadcast(keys) if small else keys.hint("merge")
    met = [layer.join(keys, on).select("query_id", "vec_id") for layer in index.layers]
    return reduce(DataFrame.unionByName, met).distinct()


def knn_probed(
    index: LshIndex,
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    metric: Metric = L2,
    rounds: Sequence[int] = ROUNDS,
) -> DataFrame:
    """``k`` answers ``(query_id, vec_id, distance, rank)`` for every query, ties by id.

    They are the nearest of the candidates of the rounds that a query needed, or of all vectors where no round
    gave ``k`` candidates.  Rounds are as many as ``rounds`` has entries, however many queries there are.
    """
    dimension = index.params.dimension
    whole = Asked.of(queries)
    asked = whole.df
    pending, found, done = asked, None, 0
    for last in rounds:
        met = probed_candidates(index, pending, done, last)
        found = cut_lineage(met if found is None else found.unionByName(met).distinct())
        enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select("query_id")
        pending, done = cut_lineage(asked.join(enough, "query_id", "left_anti")), last
        if pending.isEmpty():
            break
    short = pending.select("query_id")
    near = measured(found.join(short, "query_id", "left_anti"), whole, vectors, dimension, metric)
    return _nearest(near, k, metric).unionByName(exact_knn_search(vectors, pending, k, dimension, metric))
