"""Size checks and shared-storage helpers used before a plan is chosen.

Nothing in this package is broadcast on a guess: a side is broadcast only after
``fits`` has shown that it holds at most a known number of rows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from itertools import count

from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Upper bound, in bytes, for any frame this package broadcasts.
BROADCAST_BYTES = 64 * 1024 * 1024


def row_budget(row_bytes: int, max_bytes: int = BROADCAST_BYTES) -> int:
    """Number of rows of ``row_bytes`` each that stay within ``max_bytes``."""
    return max(1, max_bytes // max(1, row_bytes))


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows.

    Spark reads partition after partition until it has seen one row too many, so a
    huge table is found too big after a few partitions.  The driver sees a row of one number
    for each row counted, ``max_rows + 1`` at most.
    """
    return not df.select(F.lit(1)).offset(max_rows).limit(1).collect()


def broadcast_if_fits(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` when its checked size allows, else leave the join to Spark."""
    return F.broadcast(df) if fits(df, max_rows) else df


def _width(c: Column, kind: T.DataType) -> Column:
    """Bytes of a value, 8 for anything of fixed size."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        width = F.octet_length(c)
    elif isinstance(kind, T.ArrayType) and not isinstance(
        kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)
    ):
        width = F.size(c) * 16
    elif isinstance(kind, T.ArrayType):
        element = F.transform(c, lambda x: _width(x, kind.elementType))
        width = F.aggregate(element, F.lit(0).cast("bigint"), lambda s, x: s + x)
    elif isinstance(kind, T.StructType):
        width = sum((_width(c[f.name], f.dataType) for f in kind.fields), F.lit(0))
    elif isinstance(kind, T.MapType):
        entry = T.StructType().add("key", kind.keyType).add("value", kind.valueType)
        width = _width(F.map_entries(c), T.ArrayType(entry))
    else:
        width = F.lit(8)
    return F.coalesce(width.cast("bigint"), F.lit(0)) + 8


def width_of(df: DataFrame, name: str) -> Column:
    """Bytes of a value of a column."""
    return _width(F.col(f"`{name}`"), df.schema[name].dataType)


def fits_bytes(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when all rows of ``df`` together take at most ``max_bytes``, by one sum."""
    whole = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    (total,) = df.agg(F.sum(whole)).first()
    return (total or 0) <= max_bytes


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if folder is None:
        folder = sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="vicinal-")
        sc.setCheckpointDir(folder)
    return folder


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_stage: ContextVar[tuple[str, Iterator[int], list[Broadcast]] | None] = ContextVar("stage", default=None)


@contextmanager
def staged_in(folder: str):
    """Let ``cut_lineage`` overwrite numbered tables in ``folder``.

    For work repeated without end, such as the batches of a stream: a repetition takes
    the place of the one before instead of leaving more tables behind, and what it
    shared with the executors is removed.
    """
    shared: list[Broadcast] = []
    token = _stage.set((folder, count(), shared))
    try:
        yield
    finally:
        _stage.reset(token)
        for value in shared:
            value.destroy()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more, on whatever storage it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settle(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """``build()`` as a written table.  All that was staged on the way is removed, also if it fails."""
    stage = _stage.get()
    path = work_path(spark, "stage") if stage is None else f"{stage[0]}/{next(stage[1])}"
    folder = work_path(spark, "scratch")
    try:
        with staged_in(folder):
            df = build()
            df.write.mode("overwrite").parquet(path)
    finally:
        remove(spark, folder)
    return spark.read.schema(df.schema).parquet(path)


def share(spark: SparkSession, value) -> Broadcast:
    """Send a value of checked size to the executors, for as long as ``staged_in`` lasts if
    that is in force."""
    sent, stage = spark.sparkContext.broadcast(value), _stage.get()
    if stage is not None:
        stage[2].append(sent)
    return sent


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder: worked out once, columnar, and
    safe if executors are lost.  Within ``settle`` a table goes when the whole is written; others
    stay until the folder is emptied."""
    spark, stage = df.sparkSession, _stage.get()
    path = work_path(spark, "stage") if stage is None else f"{stage[0]}/{next(stage[1])}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
