"""Vectors as a table laid out for look-ups by id.

Rows lie in buckets of a hash of the id and are sorted by it within a file.  A search that has worked
out few candidate ids reads only their buckets and, there, the row groups that may hold them; one with
many candidates sends these to the buckets.  The vectors themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.sources.index_store import next_build, publish, published

LAYOUT_SCHEMA = "parts INT, id_type STRING, number BIGINT, build STRING"


def save_vectors(vectors: DataFrame, path: str, parts: int = 256) -> None:
    """Write ``(vec_id, v)`` in ``parts`` buckets of the id, as a new build that the last step publishes."""
    spark = vectors.sparkSession
    number, build = next_build(spark, f"{path}/layout")
    laid_out = vectors.select("vec_id", "v").repartition(parts, "vec_id")
    (
        laid_out.write.bucketBy(parts, "vec_id")
        .sortBy("vec_id")
        .format("parquet")
        .option("path", f"{path}/builds/{build}")
        .option("parquet.bloom.filter.enabled#vec_id", "true")
        .saveAsTable(_name(build))
    )
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    publish(spark, f"{path}/layout", (parts, id_type, number, build), LAYOUT_SCHEMA, number, build)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``(vec_id, v)``; the number of buckets rides along as column metadata."""
    layout = published(spark, f"{path}/layout", LAYOUT_SCHEMA)
    name = _name(layout["build"])
    if not spark.catalog.tableExists(name):
        # The catalog of this session does not know the files yet; they stay where they are.
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (vec_id {layout['id_type']}, v ARRAY<DOUBLE>) USING parquet"
            f" CLUSTERED BY (vec_id) SORTED BY (vec_id) INTO {layout['parts']} BUCKETS"
            f" LOCATION '{path}/builds/{layout['build']}'"
        )
    return spark.table(name).select("vec_id", F.col("v").alias("v", metadata={"buckets": layout["parts"]}))


def _name(build: str) -> str:
    return f"vectors_{build}"


def buckets_of(vectors: DataFrame) -> int | None:
    """Number of buckets of a loaded vector table, None for any other frame."""
    return vectors.schema["v"].metadata.get("buckets")
