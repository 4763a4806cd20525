"""Vectors laid out by distance to pivots, so that a search can pass over most of them.

Every vector belongs to its nearest pivot and, there, to a band of distances from it.  Pivot and band are
a cell, which is a partition of the table; the least and the largest distance of each cell are stored.  By the
triangle inequality a query at distance ``d`` from the pivot has no neighbour within ``r`` in a cell
that lies wholly nearer than ``d - r`` or farther than ``d + r``.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.functions.hashing import matrix
from vicinal.functions.vectors import MEASURED_NUMBERS
from vicinal.sources.index_store import next_build, publish, published

CELL = "cell"
LAYOUT_SCHEMA = "dimension INT, id_type STRING, number BIGINT, build STRING"
PIVOTS_SCHEMA = "pivot INT, v ARRAY<DOUBLE>"
CELLS_SCHEMA = "cell INT, pivot INT, lo DOUBLE, hi DOUBLE, n BIGINT"


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of every vector to every pivot, from differences."""
    found = np.empty((len(x), len(pivots)))
    step = max(1, MEASURED_NUMBERS // max(1, x.shape[1]))
    for s in range(0, len(x), step):
        for j, p in enumerate(pivots):
            gap = x[s : s + step] - p
            found[s : s + step, j] = np.sqrt(np.einsum("nd,nd->n", gap, gap))
    return found


def nearest_pivot(v: Column, pivots: np.ndarray) -> Column:
    """``STRUCT<pivot, distance>`` of the nearest pivot of a vector."""
    dimension = pivots.shape[1]

    @F.arrow_udf("struct<pivot:int,distance:double>")
    def nearest(vectors: pa.Array) -> pa.Array:
        found = distances(matrix(vectors, dimension), pivots)
        at = found.argmin(1) if len(found) else np.zeros(0, np.int64)
        own = found[np.arange(len(at)), at]
        return pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(own)], ["pivot", "distance"])

    return nearest(v)


def save_pivot_vectors(vectors: DataFrame, path: str, pivots: int = 64, bands: int = 8, sample: int = 4096) -> None:
    """Write ``(vec_id, v)`` by cells, as a new build that the last step publishes.

    Pivots are chosen far apart (each the farthest from those before it) out of ``sample`` vectors with the lowest hash
    of their id; the edges of bands are quantiles of the distances.  Neither choice changes any result.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("vec_id", "v")
    drawn = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()
    if not drawn.num_rows:
        raise ValueError("there are no vectors to lay out")
    number, build = next_build(spark, f"{path}/layout")
    folder = f"{path}/builds/{build}"
    dimension = len(drawn.column("v")[0])
    chosen = _far_apart(matrix(drawn.column("v").combine_chunks(), dimension), pivots)
    placed = vectors.withColumn("near", nearest_pivot(F.col("v"), chosen)).select("vec_id", "v", "near.*")
    share = [(b + 1) / bands for b in range(bands - 1)]
    edges = placed.groupBy("pivot").agg(F.percentile_approx("distance", share, 1000).alias("edges"))
    # One row a pivot: as many as were asked for.
    table = {r.pivot: r.edges for r in edges.collect()}
    edge = F.create_map(*(F.lit(x) for p, e in sorted(table.items()) for x in (p, e)))
    band = F.size(F.filter(edge[F.col("pivot")], lambda e: e < F.col("distance")))
    celled = placed.withColumn(CELL, (F.col("pivot") * bands + band).cast("int"))
    laid_out = celled.hint("rebalance", CELL).sortWithinPartitions(CELL, "distance")
    laid_out.write.mode("overwrite").partitionBy(CELL).parquet(f"{folder}/vectors")
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    written = spark.read.schema(f"pivot INT, distance DOUBLE, {CELL} INT").parquet(f"{folder}/vectors")
    cells = written.groupBy(CELL).agg(
        F.first("pivot").alias("pivot"), F.min("distance").alias("lo"), F.max("distance").alias("hi"), F.count(F.lit(1)).alias("n")
    )
    cells.coalesce(1).write.mode("overwrite").parquet(f"{folder}/cells")
    rows = [(i, p.tolist()) for i, p in enumerate(chosen)]
    spark.createDataFrame(rows, PIVOTS_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/pivots")
    publish(spark, f"{path}/layout", (dimension, id_type, number, build), LAYOUT_SCHEMA, number, build)


def _far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows (fewer, if the others are equal to them), each the farthest from those before it."""
    chosen = [0]
    gap = distances(x, x[:1])[:, 0]
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def load_pivot_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``(vec_id, v, cell)``; where pivots and cells are stored rides along as column metadata."""
    layout = published(spark, f"{path}/layout", LAYOUT_SCHEMA)
    folder = f"{path}/builds/{layout['build']}"
    rows = spark.read.schema(f"vec_id {layout['id_type']}, v ARRAY<DOUBLE>, {CELL} INT").parquet(f"{folder}/vectors")
    cell = F.col(CELL).alias(CELL, metadata={"pivots": folder})
    return rows.select("vec_id", "v", cell)


class Cells:
    """Pivots and cells of a loaded table: as many numbers as it has cells, whatever its size is."""

    def __init__(self, spark: SparkSession, folder: str):
        found = spark.read.schema(PIVOTS_SCHEMA).parquet(f"{folder}/pivots").orderBy("pivot").collect()
        self.pivots = np.array([r.v for r in found])
        cells = spark.read.schema(CELLS_SCHEMA).parquet(f"{folder}/cells").orderBy(CELL).collect()
        self.ids = np.array([r.cell for r in cells])
        self.pivot = np.array([r.pivot for r in cells])
        self.lo, self.hi = np.array([r.lo for r in cells]), np.array([r.hi for r in cells])
        self.n = np.array([r.n for r in cells])

    def reached(self, q: np.ndarray, radius: float) -> np.ndarray:
        """Whether a query may have a neighbour within ``radius`` in a cell, by (query, cell).

        The margin is far above the rounding error of a distance.
        """
        d = distances(q, self.pivots)[:, self.pivot]
        margin = radius + 1e-9 * (1 + d + self.hi)
        return (d - self.hi <= margin) & (self.lo - d <= margin)


def cells_of(vectors: DataFrame) -> Cells | None:
    """Cells of a table from ``load_pivot_vectors``, None for any other frame."""
    if CELL not in vectors.columns:
        return None
    folder = json.loads(vectors.schema[CELL].json()).get("metadata", {}).get("pivots")
    return None if folder is None else Cells(vectors.sparkSession, folder)
