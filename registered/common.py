"""Shared inputs of the registered queries, once for Spark and once as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.functions.hashing import HashFamily
from vicinal.functions.vectors import as_vector
from vicinal.operators.index import IndexParams

DIMENSION = 64
# Settings of the collision model (``vicinal.operators.tuning``) for the planted queries, which lie 0.16 from a vector:
# by it they are found with a chance of 0.97 and 0.98, at 0.13 % and 0.02 % of all pairs.
PARAMS = IndexParams(DIMENSION, num_functions=10, num_tables=15, bin_length=1.5, seed=7)
SIGN_PARAMS = IndexParams(DIMENSION, 16, 15, 1.0, seed=7, kind="sign")
RADIUS = 1.2


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", as_vector("embedding").alias("v"))


def moved(v: Column, vec_id: Column) -> Column:
    """A vector close to ``v`` (at a distance of about 0.16)."""
    return F.transform(v, lambda x, i: x + F.lit(0.01) * ((vec_id * 31 + i * 17) % 7 - 3))


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query near every stored vector."""
    return vectors(spark, sf_dir).select(
        F.col("vec_id").alias("query_id"), moved(F.col("v"), F.col("vec_id")).alias("qv")
    )


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits)


# -- the same in SQL -------------------------------------------------------------------

EMB = "emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
QRY = (
    "qry AS (SELECT vec_id AS query_id, list_transform(v, lambda x, i: "
    "x + CAST(0.01 AS DOUBLE) * ((vec_id * 31 + (i - 1) * 17) % 7 - 3)) AS qv FROM emb)"
)
LEHMER = "(({} % 2147483647) * 48271) % 2147483647"


def planes_sql(family: HashFamily) -> str:
    rows = ", ".join(
        f"({i}, [{', '.join(repr(float(x)) for x in a)}]::DOUBLE[], "
        f"{0.0 if family.b is None else repr(float(family.b[i]))}::DOUBLE)"
        for i, a in enumerate(family.a)
    )
    return f"planes(fn, a, b) AS (VALUES {rows})"


def bin_sql(family: HashFamily, v: str) -> str:
    if family.b is None:
        return f"CASE WHEN list_dot_product({v}, a) > 0 THEN 1 ELSE 0 END"
    return f"CAST(floor((list_dot_product({v}, a) + b) / {float(family.bin_length)!r}::DOUBLE) AS BIGINT)"


def sig_sql(family: HashFamily, source: str, id_col: str, v_col: str, name: str) -> str:
    return (
        f"{name} AS (SELECT {id_col}, list({bin_sql(family, v_col)} ORDER BY fn) AS sig "
        f"FROM {source}, planes GROUP BY {id_col})"
    )


def tables_sql(family: HashFamily) -> str:
    groups = family.groups
    rows = ", ".join(
        f"({t}, {[f + 1 for f in groups[i] + groups[j]]})" for t, (i, j) in enumerate(family.tables)
    )
    return f"tables(table_id, slots) AS (VALUES {rows})"


def keys_sql(sig: str, id_col: str, name: str) -> str:
    return (
        f"{name} AS (SELECT {id_col}, table_id, list_transform(slots, lambda f: sig[f]) AS bins "
        f"FROM {sig}, tables)"
    )


def index_sql(family: HashFamily) -> str:
    """CTEs up to ``pkeys``, the bucket keys of all stored vectors."""
    return ", ".join(
        [
            EMB,
            planes_sql(family),
            tables_sql(family),
            sig_sql(family, "emb", "vec_id", "v", "psig"),
            keys_sql("psig", "vec_id", "pkeys"),
        ]
    )


def candidates_sql(family: HashFamily, qry: str = QRY) -> str:
    """CTEs up to ``cand``, the distinct candidate pairs."""
    return ", ".join(
        [
            index_sql(family),
            qry,
            sig_sql(family, "qry", "query_id", "qv", "qsig"),
            keys_sql("qsig", "query_id", "qkeys"),
            "cand AS (SELECT DISTINCT query_id, vec_id FROM qkeys JOIN pkeys USING (table_id, bins))",
        ]
    )


MEASURED = (
    "near AS (SELECT query_id, vec_id, list_distance(v, qv) AS d "
    "FROM cand JOIN emb USING (vec_id) JOIN qry USING (query_id))"
)


class Registry:
    """Query name -> Spark function, and -> SQL where SQL can express it."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def add(self, name: str, sql: str | None = None):
        def register(f):
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return register
