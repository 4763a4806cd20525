"""Radius and nearest-neighbour search for whole frames of queries.

Queries are ``(query_id, qv)`` and vectors ``(vec_id, v)``, both with unique ids.  Each
operator picks between a plan that moves only the query side (when a size check shows
that it can be broadcast) and a salted shuffle join that no hot bucket, hot vector or
hot query can overload.  Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vicinal.functions.hashing import matrix
from vicinal.functions.vectors import L2, MEASURED_NUMBERS, Metric
from vicinal.operators.index import LshIndex, table_keys
from vicinal.plans.sizing import (
    BROADCAST_BYTES,
    cut_lineage,
    fits,
    fits_bytes,
    row_budget,
    share,
    width_of,
    work_path,
)
from vicinal.plans.skew import salted_join, segmented_lists, spread
from vicinal.sources.pivot_store import CELL, Cells, cells_of, nearest_pivot
from vicinal.sources.vector_store import buckets_of

#: Rows of one (hot key, segment) pair in a salted join.
SALT_CAP = 100_000

#: Bytes of one block of vectors or queries.
BLOCK_BYTES = 32 * 1024 * 1024

#: Queries of one signature that go through the salted join as one row.
LIST_QUERIES = 4096

#: Wanted vectors that are looked up by their ids themselves.
LITERAL_IDS = 200

#: Rows of either side measured in one matrix product.
TILE = 1024

#: Queries of one list that a vector carries to a block at a time.
SLICE = 1024

#: Matches of one tile of queries that are held until they are put in order.
HELD_HITS = 1 << 20

#: Cells of a grid for each core, where there are enough rows for them.
CELLS_A_CORE = 3

#: Queries from which on it is counted how many pairs share a bucket.
COUNTED_QUERIES = 4096

#: Share of all pairs that may meet in buckets, a pair counted in each table where it meets; beyond it, listing the pairs
#: costs more than passing all of them.
CROWDED = 0.02

#: Slots in which the buckets of a table are counted.
SLOTS = 1 << 14

_HITS = "query_id {}, vec_id {}, distance DOUBLE"


def _row_hash(c: str) -> Column:
    return F.xxhash64(c)


def _few(queries: DataFrame, rows: int) -> bool:
    """True when the queries may be broadcast: by their number and, as ids may be long
    strings and vectors of any length, by their measured bytes."""
    return fits(queries, rows) and fits_bytes(queries)


@dataclass(frozen=True)
class Asked:
    """Queries ``(query_id, qv)`` as a written table, worked out and measured once for all steps of a search."""

    df: DataFrame
    rows: int
    id_bytes: int
    bytes: int

    @classmethod
    def of(cls, queries: DataFrame | Asked, *kept: str) -> Asked:
        """``queries``, with further columns that the table is to keep."""
        if isinstance(queries, cls):
            return queries
        df = cut_lineage(_identified(queries.select("query_id", "qv", *kept), "query_id"))
        ids, vectors = (F.coalesce(F.sum(width_of(df, c)), F.lit(0)) for c in ("query_id", "qv"))
        rows, id_bytes, vector_bytes = df.agg(F.count(F.lit(1)), ids, vectors).first()
        return cls(df, rows, id_bytes, id_bytes + vector_bytes)

    def ids_fit(self, rows: int) -> bool:
        return self.rows <= rows and self.id_bytes <= BROADCAST_BYTES

    def fit(self, rows: int) -> bool:
        return self.rows <= rows and self.bytes <= BROADCAST_BYTES


def _identified(df: DataFrame, id_col: str) -> DataFrame:
    """``df`` whose ids are checked as they are read: a NULL id is an error in every plan."""
    kind = df.schema[id_col].dataType
    missing = F.raise_error(F.lit(f"NULL {id_col}")).cast(kind)
    return df.withColumn(id_col, F.when(F.col(id_col).isNull(), missing).otherwise(F.col(id_col)))


# -- candidates ------------------------------------------------------------------------


def candidates(
    index: LshIndex,
    queries: DataFrame | Asked,
    broadcast_rows: int | None = None,
    salt_cap: int = SALT_CAP,
) -> DataFrame:
    """Distinct ``(query_id, vec_id)`` of vectors that share a bucket with a query."""
    lists = candidate_lists(index, queries, broadcast_rows, salt_cap)
    return lists.select(F.explode("asked").alias("query_id"), "vec_id")


def candidate_lists(
    index: LshIndex,
    queries: DataFrame | Asked,
    broadcast_rows: int | None = None,
    salt_cap: int = SALT_CAP,
) -> DataFrame:
    """Candidates as ``(vec_id, asked)``, ``asked`` a list of queries; a vector may have several.

    Queries with one signature have the same candidates, so they go through the index as
    one.  A pair is emitted in the first table where it meets, so distinctness costs no
    shuffle.  With few queries the postings are streamed past their broadcast keys.
    """
    family = index.family
    asked = Asked.of(queries)
    signed = asked.df.select("query_id", family.signature(F.col("qv")).alias("q_sig"))
    on = ["table_id", "bins"] + (["part"] if index.parts else [])
    if broadcast_rows is None:
        row_bytes = 16 * (len(family.a) + family.num_functions + 8) * len(family.tables)
        broadcast_rows = row_budget(row_bytes)
    if asked.ids_fit(broadcast_rows):
        groups = signed.groupBy("q_sig").agg(F.collect_list("query_id").alias("asked"))
        keys = table_keys(groups, family, index.parts, "q_sig")
        if index.parts:
            # A filter on the key side lets Spark prune the partitions of the postings.
            keys = keys.filter(F.col("part") < index.parts)
        met = [layer.join(F.broadcast(keys), on).select("vec_id", "table_id", "sig", "q_sig", "asked") for layer in index.layers]
    else:
        own = _row_hash("query_id")
        groups = segmented_lists(signed, ["q_sig"], "query_id", LIST_QUERIES, own)
        groups = groups.withColumnRenamed("members", "asked")
        keys = table_keys(groups, family, index.parts, "q_sig")
        group_hash = F.xxhash64("q_sig", "segment")
        # The keys of the queries are read for both layers and for their own count.
        keys = cut_lineage(keys)
        met = [
            salted_join(layer, keys, on, _row_hash("vec_id"), group_hash, salt_cap, index.heavy).select(
                "vec_id", "table_id", "sig", "q_sig", "asked"
            )
            for layer in index.layers
        ]
    first = family.first_match(F.col("table_id"), F.col("sig"), F.col("q_sig"))
    return reduce(DataFrame.unionByName, met).filter(first).select("vec_id", "asked")


def measured(
    pairs: DataFrame,
    queries: DataFrame,
    vectors: DataFrame,
    dimension: int,
    metric: Metric = L2,
    within: tuple[float, bool] | None = None,
    broadcast_rows: int | None = None,
) -> DataFrame:
    """``(query_id, vec_id, distance)`` of given distinct pairs, vectors looked up by id."""
    lists = pairs.select("vec_id", F.array("query_id").alias("asked"))
    return _measured(lists, queries, vectors, dimension, metric, within, broadcast_rows)


def _measured(
    lists, queries, vectors, dimension, metric, within, broadcast_rows
) -> DataFrame:
    """Distances for ``(vec_id, asked)``; ``within = (radius, inclusive)`` keeps the near.

    Queries that fit are broadcast and each wanted vector is looked up once for all
    queries that want it; more queries meet the vectors in the tasks, block by block.
    """
    queries = Asked.of(queries)
    parts = buckets_of(vectors)
    vectors = vectors.select("vec_id", "v")
    rows = row_budget(8 * dimension + 64) if broadcast_rows is None else broadcast_rows
    if queries.fit(rows):
        asked = _asked_vectors(lists, vectors, parts is not None)
        block = queries.df.select("query_id", "qv").toArrow()
        return _measure_with_broadcast(asked, block, dimension, metric, within)
    return _measure_in_blocks(lists, queries, vectors, parts, dimension, metric, within)


def _asked_vectors(lists, vectors, stored: bool) -> DataFrame:
    """``(vec_id, v, asked)``: each wanted vector with the queries that want it.

    No list is longer than the queries, which fit a broadcast.  Ids are unique on both
    sides of the join.
    """
    lists = cut_lineage(lists.groupBy("vec_id").agg(F.flatten(F.collect_list("asked")).alias("asked")))
    if stored and fits(lists, LITERAL_IDS):
        # Of a table in buckets only those of the ids are opened, and row groups that may hold them.
        ids = [r.vec_id for r in lists.select("vec_id").collect()]
        vectors = vectors.filter(F.col("vec_id").isin(ids))
    (size,) = lists.agg(F.sum(64 + width_of(lists, "asked"))).first()
    # Long lists pack into small files: do not let their file size suggest a broadcast.
    small = (size or 0) <= BROADCAST_BYTES
    return vectors.join(F.broadcast(lists) if small else lists.hint("merge"), "vec_id").select("vec_id", "v", "asked")


def _hits_schema(asked: DataFrame) -> str:
    query_type = asked.schema["asked"].dataType.elementType.simpleString()
    return _HITS.format(query_type, asked.schema["vec_id"].dataType.simpleString())


def _list_hits(x, vec_ids, lists, q, query_ids, metric, within):
    """Record batches of the measured pairs of vectors ``x`` with the queries they list."""
    step = max(1, MEASURED_NUMBERS // x.shape[1])
    i = np.repeat(np.arange(len(x)), pc.list_value_length(lists).to_numpy())
    wanted = lists.flatten()
    for s in range(0, len(i), step):
        rows, ids = i[s : s + step], wanted.slice(s, step)
        j = pc.index_in(ids, value_set=query_ids).to_numpy()
        distance = metric.rows(x[rows], q[j])
        if within is not None:
            near = np.nonzero(metric.within(distance, *within))[0]
            rows, ids, distance = rows[near], ids.take(pa.array(near)), distance[near]
        yield pa.RecordBatch.from_arrays(
            [ids, vec_ids.take(pa.array(rows)), pa.array(distance, from_pandas=True)],
            names=["query_id", "vec_id", "distance"],
        )


def _measure_with_broadcast(asked: DataFrame, block: pa.Table, dimension, metric, within) -> DataFrame:
    """Measure each vector against the queries that want it, on Arrow batches."""
    schema = _hits_schema(asked)
    if not block.num_rows:
        return asked.sparkSession.createDataFrame([], schema)
    shared = share(asked.sparkSession, block.combine_chunks())

    def measure(batches):
        held = shared.value
        query_ids = held.column("query_id").combine_chunks()
        q = matrix(held.column("qv").combine_chunks(), dimension)
        for batch in batches:
            x, vec_ids = matrix(batch.column("v"), dimension), batch.column("vec_id")
            yield from _list_hits(x, vec_ids, batch.column("asked"), q, query_ids, metric, within)

    return asked.mapInArrow(measure, schema)


def _measure_in_blocks(lists, queries, vectors, parts, dimension, metric, within) -> DataFrame:
    """The same for any number of queries, which meet the vectors in the tasks and pass no driver.

    Queries are dealt into blocks by a hash.  The pairs go to their vectors once (a table in buckets stays in
    place for that), and each vector goes on to the blocks that want it, with its queries there.
    """
    spark = vectors.sparkSession
    rows = row_budget(8 * dimension, BLOCK_BYTES)
    # Half-full blocks on average leave room for the unevenness of the hash.
    blocks = max(1, -(-2 * queries.rows // rows))
    ways = max(1, -(-_cells(spark) // blocks))
    block = _dealt("query_id", blocks)
    pairs = lists.select(F.explode("asked").alias("query_id"), "vec_id").withColumn("block", block)
    sent = pairs.repartition("vec_id") if parts is None else pairs.repartition(parts, "vec_id")
    wanted = sent.groupBy("vec_id", "block").agg(F.collect_list("query_id").alias("asked"))
    met = vectors.join(wanted.hint("merge"), "vec_id")
    starts = F.sequence(F.lit(1), F.size("asked"), F.lit(SLICE))
    some = F.explode(F.transform(starts, lambda i: F.slice("asked", i, SLICE)))
    cell = (F.col("block") * ways + _dealt("vec_id", ways)).alias(CELL)
    passing = met.select(cell, "vec_id", "v", some.alias("asked"))
    way = F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))
    held = queries.df.select("query_id", "qv", block.alias("block"), way.alias("way")).select(
        (F.col("block") * ways + F.col("way")).alias(CELL), "query_id", "qv"
    )

    def hold(block):
        return block.column("query_id").combine_chunks(), matrix(block.column("qv").combine_chunks(), dimension)

    def measure(block, batch):
        x = matrix(batch.column("v"), dimension)
        return _list_hits(x, batch.column("vec_id"), batch.column("asked"), block[1], block[0], metric, within)

    hits = _meet(held, passing, blocks * ways, hold, measure, _hits_schema(passing))
    # Few pairs are near, and what reads them more than once need not work them out again.
    return hits if within is None else cut_lineage(hits)


def _cells(spark) -> int:
    return CELLS_A_CORE * spark.sparkContext.defaultParallelism


def _dealt(id_col: str, n: int) -> Column:
    return F.pmod(spread(_row_hash(id_col)), F.lit(n).cast("bigint")).cast("int")


def _meet(held: DataFrame, passing: DataFrame, cells: int, hold, measure, schema: str) -> DataFrame:
    """The rows of two frames in one cell, side by side: a task holds the first and lets the second pass in batches.

    The held rows of a cell are a block; the passing ones may be any number, as a sort lets them follow.
    """
    rows = held.withColumn("turn", F.lit(0)).unionByName(passing.withColumn("turn", F.lit(1)), allowMissingColumns=True)
    sides = rows.repartitionById(cells, F.col(CELL)).sortWithinPartitions(CELL, "turn")

    def run(batches):
        at, kept, block = None, [], None
        for batch in batches:
            cell, turn = batch.column(CELL).to_numpy(), batch.column("turn").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(2 * cell + turn)) + 1), len(cell)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if cell[a] != at:
                    at, kept, block = cell[a], [], None
                if not turn[a]:
                    kept.append(batch.slice(a, b - a))
                elif kept or block is not None:
                    if block is None:
                        block, kept = hold(pa.Table.from_batches(kept)), []
                    yield from measure(block, batch.slice(a, b - a))

    return sides.mapInArrow(run, schema)


# -- radius and k nearest --------------------------------------------------------------


def multifilter(
    vectors: DataFrame,
    queries: DataFrame,
    wanted: DataFrame,
    radius: float,
    dimension: int,
    metric: Metric = L2,
    inclusive: bool = False,
    **plan,
) -> DataFrame:
    """Of the wanted ``(query_id, vec_id)`` pairs, those within ``radius``; ids only."""
    known = wanted.join(queries.select("query_id"), "query_id", "left_semi")
    near = measured(known, queries, vectors, dimension, metric, (radius, inclusive), **plan)
    return near.select("query_id", "vec_id")


def _lsh_measured(index, vectors, queries, metric, within, broadcast_rows, salt_cap):
    queries = Asked.of(queries)
    if within is not None and metric.screen is not None and queries.rows >= COUNTED_QUERIES and _crowded(index, queries):
        return _grid_of_candidates(index, vectors, queries, within, metric)
    lists = candidate_lists(index, queries, broadcast_rows, salt_cap)
    dimension = index.params.dimension
    return _measured(lists, queries, vectors, dimension, metric, within, broadcast_rows)


def _crowded(index: LshIndex, queries: Asked) -> bool:
    """True when the buckets are so wide that more than a known share of all pairs meets in them.

    Counted over all postings and keys.  Buckets of one slot count as one, which adds 1 / ``SLOTS`` a table.
    """
    family = index.family
    signed = queries.df.select(family.signature(F.col("qv")).alias("sig"))
    slot = F.pmod(F.xxhash64("bins"), F.lit(SLOTS).cast("bigint")).alias("slot")

    def counted(keys, name):
        return keys.select("table_id", slot).groupBy("table_id", "slot").agg(F.count(F.lit(1)).alias(name))

    met = counted(index.whole, "stored").join(counted(table_keys(signed, family), "asked"), ["table_id", "slot"], "left")
    load = F.sum(F.col("stored").cast("double") * F.coalesce("asked", F.lit(0)))
    load, postings = met.agg(load, F.sum("stored")).first()
    return (load or 0) > CROWDED * queries.rows * (postings or 0) / len(family.tables)


def _grid_of_candidates(index: LshIndex, vectors: DataFrame, queries: Asked, within, metric: Metric) -> DataFrame:
    """The near candidates without a list of the candidates: every vector passes every query with its signature, and of
    the near pairs those remain whose signatures meet in a table."""
    family, dimension = index.family, index.params.dimension
    # Every vector has one posting in each table.
    signed = index.whole.filter(F.col("table_id") == 0).select("vec_id", "sig")
    held = vectors.select("vec_id", "v").join(signed.hint("merge"), "vec_id")
    asked = queries.df.select("query_id", "qv", family.signature(F.col("qv")).alias("sig"))
    schema = _HITS.format(
        asked.schema["query_id"].dataType.simpleString(), vectors.schema["vec_id"].dataType.simpleString()
    )
    rows = row_budget(8 * dimension, BLOCK_BYTES)
    return _grid(held, vectors.count(), replace(queries, df=asked), rows, within[0], dimension, within[1], metric, schema, family)


def radius_search(
    index: LshIndex,
    vectors: DataFrame,
    queries: DataFrame,
    radius: float = 20.0,
    inclusive: bool = False,
    metric: Metric = L2,
    broadcast_rows: int | None = None,
    salt_cap: int = SALT_CAP,
) -> DataFrame:
    """Approximate range search ``(query_id, vec_id, distance)``; strict by default."""
    within = (radius, inclusive)
    return _lsh_measured(index, vectors, queries, metric, within, broadcast_rows, salt_cap)


def knn_search(
    index: LshIndex,
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    metric: Metric = L2,
    broadcast_rows: int | None = None,
    salt_cap: int = SALT_CAP,
) -> DataFrame:
    """The ``k`` nearest candidates of every query, ties by id, with ``rank`` from 1.

    Spark limits each task to its own best ``k`` per query before the shuffle, so a
    query with a great many candidates does not swamp one task.
    """
    near = _lsh_measured(index, vectors, queries, metric, None, broadcast_rows, salt_cap)
    order = W.partitionBy("query_id").orderBy(metric.nearest_first(F.col("distance")), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def knn_single(
    index: LshIndex, vectors: DataFrame, query: DataFrame, k: int = 10, metric: Metric = L2
) -> DataFrame:
    """``k`` nearest candidates of a one-row query frame by a distributed top-k."""
    near = _lsh_measured(index, vectors, query, metric, None, None, SALT_CAP)
    return (
        near.orderBy(metric.nearest_first(F.col("distance")), "vec_id")
        .limit(k)
        .select("vec_id", "distance")
    )


# -- exact scan ------------------------------------------------------------------------


def exact_radius_search(
    vectors: DataFrame,
    queries: DataFrame | Asked,
    radius: float,
    dimension: int,
    inclusive: bool = True,
    metric: Metric = L2,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Exhaustive range search ``(query_id, vec_id, distance)``; inclusive by default.

    A query frame of one block is broadcast and the vectors, which stay in place, are scanned once.  More queries meet the
    vectors in a grid of tasks that hold a block of vectors each, past which the queries come block by block; neither side
    passes the driver, and only matches leave the tasks.  Of a
    table that is laid out by pivots (``load_pivot_vectors``) and measured by L2, each round of one block of queries reads
    only the cells that a query of its block can reach, and within them measures only those queries.
    """
    cells = cells_of(vectors) if metric.name == L2.name else None
    vectors = _identified(vectors.select("vec_id", "v", *([CELL] if cells else [])), "vec_id")
    asked = queries if isinstance(queries, Asked) else None
    queries = _identified((queries if asked is None else asked.df).select("query_id", "qv"), "query_id")
    schema = _HITS.format(
        queries.schema["query_id"].dataType.simpleString(),
        vectors.schema["vec_id"].dataType.simpleString(),
    )
    rows = row_budget(8 * dimension, block_bytes)
    scan = partial(_scan_round, vectors, cells, radius, dimension, inclusive, metric, schema)
    if _few(queries, rows) if asked is None else asked.fit(rows):
        return scan(queries)[0]
    if cells is not None:
        return _rounds(queries, cells, rows, scan, schema)
    asked = Asked.of(queries) if asked is None else asked
    return _grid(vectors, vectors.count(), asked, rows, radius, dimension, inclusive, metric, schema)


def _grid(vectors, stored, queries, rows, radius, dimension, inclusive, metric, schema, family=None) -> DataFrame:
    """All matches, each of the ``stored`` vectors and each query side by side in one cell of a grid.

    Copies grow with the number of blocks of the other side only: a query goes to every block of vectors, a
    vector to the few columns that give all cores work.  With a ``family`` both sides have a ``sig``, and of the matches
    those remain whose signatures meet in one of its tables.
    """
    spark = vectors.sparkSession
    down = max(1, -(-stored // row_budget(8 * dimension, BLOCK_BYTES)))
    blocks = -(-2 * queries.rows // rows)
    across = max(1, min(blocks, -(-_cells(spark) // down)))

    def copies(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("copy")

    held = vectors.select(*vectors.columns, copies(across)).select(
        (_dealt("vec_id", down) * across + F.col("copy")).alias(CELL), *vectors.columns
    )
    signed = ["query_id", "qv"] if family is None else ["query_id", "qv", "sig"]
    passing = queries.df.select(*signed, copies(down)).select(
        (F.col("copy") * across + _dealt("query_id", across)).alias(CELL), *signed
    )

    def bins(signatures):
        return signatures.flatten().to_numpy().reshape(len(signatures), -1)

    def hold(block):
        # Matches of a query come in the order of their ids: tables of them pack these by their small gaps.
        block = block.sort_by("vec_id").combine_chunks().to_batches()[0]
        x = matrix(block.column("v"), dimension)
        return block.column("vec_id"), x, None if family is None else bins(block.column("sig"))

    def measure(block, batch):
        vec_ids, x, x_bins = block
        for s in range(0, len(batch), rows):
            some = batch.slice(s, rows)
            q = matrix(some.column("qv"), dimension)
            meet = None if family is None else partial(family.meet, x_bins, bins(some.column("sig")))
            yield from _hits_by_query(vec_ids, x, some.column("query_id"), q, radius, inclusive, metric, meet)

    return _meet(held, passing, down * across, hold, measure, schema)


def _hits_by_query(vec_ids: pa.Array, x, query_ids: pa.Array, q, radius, inclusive, metric, meet=None):
    """Record batches of the pairs of two blocks within ``radius``, those of one query together: tables of many
    matches stay small, as what they say of a query repeats from row to row.  Of pairs of row numbers those count that ``meet``."""

    def ordered(found):
        i, j, distance = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(j, kind="stable")
        return pa.RecordBatch.from_arrays(
            [query_ids.take(pa.array(j[order])), vec_ids.take(pa.array(i[order])), pa.array(distance[order])],
            names=["query_id", "vec_id", "distance"],
        )

    for t in range(0, len(q), TILE):
        found, n = [], 0
        for s in range(0, len(x), TILE):
            i, j, distance = metric.near(x[s : s + TILE], q[t : t + TILE], radius, inclusive)
            i, j = i + s, j + t
            if meet is not None:
                both = meet(i, j)
                i, j, distance = i[both], j[both], distance[both]
            found.append((i, j, distance))
            n += len(i)
            if n >= HELD_HITS:
                yield ordered(found)
                found, n = [], 0
        if n:
            yield ordered(found)


def _scan_round(vectors, cells, radius, dimension, inclusive, metric, schema, queries):
    """The matches of one block of queries and what was shared for them."""
    block = queries.toArrow().combine_chunks()
    if not block.num_rows:
        return queries.sparkSession.createDataFrame([], schema), []
    sent = [share(queries.sparkSession, block)]
    if cells is None:
        return vectors.mapInArrow(partial(_scan, sent[0], radius, dimension, inclusive, metric), schema), sent
    reached = cells.reached(matrix(block.column("qv").combine_chunks(), dimension), radius)
    wanted = {int(c): np.flatnonzero(r) for c, r in zip(cells.ids, reached.T) if r.any()}
    # A list of partitions: the files of the other cells are not opened.
    near = vectors.filter(F.col(CELL).isin(list(wanted)))
    sent.append(share(queries.sparkSession, wanted))
    return near.mapInArrow(partial(_scan_cells, *sent, radius, dimension, inclusive, metric), schema), sent


def _scan(shared, radius, dimension, inclusive, metric, batches):
    held = shared.value
    query_ids = held.column("query_id").combine_chunks()
    q = matrix(held.column("qv").combine_chunks(), dimension)
    for batch in batches:
        x = matrix(batch.column("v"), dimension)
        yield from _hits_by_query(batch.column("vec_id"), x, query_ids, q, radius, inclusive, metric)


def _scan_cells(shared, wanted, radius, dimension, inclusive, metric, batches):
    held = shared.value
    query_ids = held.column("query_id").combine_chunks()
    q = matrix(held.column("qv").combine_chunks(), dimension)
    for batch in batches:
        cell = batch.column(CELL).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(cell)) + 1), len(cell)]
        for a, b in zip(edges, edges[1:]):
            if a < b:
                few, part = wanted.value[int(cell[a])], batch.slice(a, b - a)
                x = matrix(part.column("v"), dimension)
                yield from _hits_by_query(part.column("vec_id"), x, query_ids.take(pa.array(few)), q[few], radius, inclusive, metric)


def _rounds(queries: DataFrame, cells: Cells, rows: int, scan, schema: str) -> DataFrame:
    """Blocks of about ``rows`` queries, one after the other; queries of neighbouring pivots share a block."""
    queries = cut_lineage(queries.withColumn("at", nearest_pivot(F.col("qv"), cells.pivots)["pivot"]))
    at = F.col("at")
    counts = {r.at: r.n for r in queries.groupBy("at").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = work_path(queries.sparkSession, "hits")
    queries.sparkSession.createDataFrame([], schema).write.parquet(found)
    for group, parts in _blocks(counts, rows):
        some = queries.filter(at.isin(group))
        for i in range(parts):
            dealt = some.filter(F.pmod(spread(_row_hash("query_id")), F.lit(parts)) == i)
            hits, sent = scan(dealt.select("query_id", "qv"))
            hits.write.mode("append").parquet(found)
            for value in sent:
                value.unpersist()
    return queries.sparkSession.read.schema(schema).parquet(found)


def _blocks(counts: dict[int, int], rows: int) -> list[tuple[list[int], int]]:
    """Pivots whose queries make up a block, and in how many blocks the queries of a crowded pivot are dealt.

    Dealt blocks are half full on average, to leave room for the unevenness of the hash.
    """
    found, group, held = [], [], 0
    for pivot, n in sorted(counts.items()):
        if n > rows:
            found.append(([pivot], -(-2 * n // rows)))
            continue
        if held + n > rows:
            found.append((group, 1))
            group, held = [], 0
        group, held = [*group, pivot], held + n
    return [*found, (group, 1)] if group else found


# -- recall ----------------------------------------------------------------------------


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``(query_id, exact_count, found_count, recall)`` for every query with exact answers."""
    hits = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("found_count"))
    truth = exact.groupBy("query_id").agg(F.count(F.lit(1)).alias("exact_count"))
    return truth.join(hits, "query_id", "left").select(
        "query_id",
        "exact_count",
        F.coalesce("found_count", F.lit(0)).alias("found_count"),
        (F.coalesce("found_count", F.lit(0)) / F.col("exact_count")).alias("recall"),
    )
