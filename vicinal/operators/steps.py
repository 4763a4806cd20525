"""Folds whose step is any function: the values of a key one after the other, in order.

Rows are sent to their key's task and sorted there by key and order (a secondary sort, which spills to
disk), and one pass carries a single accumulator a key from batch to batch.  Steps take arrays: the
first values of all keys of a batch are folded together, then the second ones, and so on, so that
Python is called as often as the longest key of a batch has values.

A step that need not be associative ties the values of one key to one task; its memory does not grow
with their number.  Where a key may hold a large share of all rows, use ``OrderedFold``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: ``f(keys, accumulators, values)`` of arrays; ``keys`` is one array, or a tuple of them.
Step = Callable[..., np.ndarray]


@dataclass(frozen=True)
class StepFold:
    """``z(keys, values)`` of the first values, then ``f(keys, accumulators, values)`` of each next one.

    Values come in ``order``, equal positions by value; ``returns`` is the Spark type of the accumulator (that of the
    value, if not told otherwise).  A NULL value is absent.  Arrays are numpy's own for numbers and booleans, else
    they hold Python objects; no accumulator may become NULL.
    """

    order: Sequence[str]
    f: Step
    z: Callable[..., np.ndarray] = lambda keys, values: values
    returns: str | None = None

    def apply(self, pairs: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
        """``keys, value``: the folded value of every key."""
        keys, order = list(keys), [f"_o{i}" for i in range(len(self.order))]
        rows = pairs.filter(F.col(value).isNotNull()).select(
            *keys, *(F.col(c).alias(o) for c, o in zip(self.order, order)), F.col(value).alias("_u")
        )
        kind = rows.schema["_u"].dataType if self.returns is None else _type(pairs, self.returns)
        dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order, "_u").select(*keys, "_u")
        return self._folded(dealt, keys, value, kind, False)

    def onto(self, base: DataFrame, pairs: DataFrame, keys: Sequence[str], old: str, value: str) -> DataFrame:
        """``keys, old``: every entry of ``base`` (of unique keys) after the steps of the pairs of its key.

        ``z`` is not used: the entry's value is the first accumulator.  An entry without a value stays as it is.
        """
        keys, order = list(keys), [f"_o{i}" for i in range(len(self.order))]
        empty = base.schema[old].dataType
        u = pairs.schema[value].dataType
        entries = base.select(
            *keys, F.lit(True).alias("_entry"), F.col(old).alias("_old"),
            *(F.lit(None).cast(pairs.schema[c].dataType).alias(o) for c, o in zip(self.order, order)),
            F.lit(None).cast(u).alias("_u"),
        )
        steps = pairs.filter(F.col(value).isNotNull()).select(
            *keys, F.lit(False).alias("_entry"), F.lit(None).cast(empty).alias("_old"),
            *(F.col(c).alias(o) for c, o in zip(self.order, order)), F.col(value).alias("_u"),
        )
        rows = entries.unionByName(steps).repartition(*keys)
        dealt = rows.sortWithinPartitions(*keys, F.desc("_entry"), *order, "_u").select(*keys, "_entry", "_old", "_u")
        return self._folded(dealt, keys, old, empty, True)

    def _folded(self, dealt: DataFrame, keys: list[str], value: str, kind: T.DataType, onto: bool) -> DataFrame:
        schema = T.StructType([*(dealt.schema[k] for k in keys), T.StructField(value, kind)])
        return dealt.mapInArrow(_pass(self.z, self.f, keys, to_arrow_schema(schema), onto), schema)


def _type(df: DataFrame, ddl: str) -> T.DataType:
    return df.limit(0).select(F.lit(None).cast(ddl).alias("x")).schema["x"].dataType


def _new_group(batch: pa.RecordBatch, keys: list[str], last: pa.RecordBatch | None) -> np.ndarray:
    """Whether each row has another key than the row before it."""
    changed = np.zeros(len(batch), bool)
    changed[0] = last is None
    for k in keys:
        x = batch.column(k)
        before = pa.concat_arrays([x[:1] if last is None else last.column(k), x[:-1]])
        equal = pc.fill_null(pc.equal(x, before), False).to_numpy(zero_copy_only=False)
        nulls = pc.and_(pc.is_null(x), pc.is_null(before)).to_numpy(zero_copy_only=False)
        changed |= ~(equal | nulls)
    return changed


def _array(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _pass(z, f, keys: list[str], schema: pa.Schema, onto: bool):
    def told(rows: pa.RecordBatch, found: list) -> pa.RecordBatch:
        columns = [rows.column(k).cast(schema.field(k).type) for k in keys]
        return pa.record_batch([*columns, pa.array(found, schema.types[-1])], schema=schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The key that is still open: its row, accumulator, whether that counts, and whether the key is in the result.
        carried = None
        for batch in batches:
            if not len(batch):
                continue
            new = _new_group(batch, keys, None if carried is None else carried[0])
            start, c = np.flatnonzero(new), 0 if carried is None else 1
            group = np.cumsum(new) - 1 + c
            rows = batch.select(keys).take(pa.array(start, pa.int64()))
            if c:
                rows = pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([carried[0].column(k), rows.column(k)]) for k in keys], names=keys
                )
            named, values, n = [_array(rows.column(k)) for k in keys], _array(batch.column("_u")), len(rows)
            acc, alive, shown = np.empty(n, object), np.ones(n, bool), np.ones(n, bool)
            if c:
                acc[0], alive[0], shown[0] = carried[1:]
            if onto:
                begun = batch.column("_old").take(pa.array(start, pa.int64())).to_pylist()
                shown[c:] = _array(batch.column("_entry"))[start]
                alive[c:] = shown[c:] & np.array([x is not None for x in begun], bool)
            else:
                begun = _listed(z(_pick(named, np.arange(c, n)), values[start])) if len(start) else []
            for i, x in enumerate(begun, c):
                acc[i] = x
            # The rank of a row is the number of steps of its key ahead of it; first rows are in already.
            rank = np.arange(len(batch)) - np.r_[np.full(c, -1), start].astype(np.int64)[group]
            order = np.argsort(rank, kind="stable")
            edges = np.searchsorted(rank[order], np.arange(1, int(rank.max()) + 2))
            live = _typed(acc, alive)
            for a, b in zip(edges, edges[1:]):
                here = order[a:b]
                here = here[alive[group[here]]]
                if len(here):
                    own = group[here]
                    stepped = np.asarray(f(_pick(named, own), live[own], values[here]))
                    if live.dtype != object:
                        live = live.astype(np.result_type(stepped, live), copy=False)
                    live[own] = stepped
            found = [x if known else None for x, known in zip(_listed(live), alive)]
            done = np.flatnonzero(shown[:-1])
            if len(done):
                yield told(rows.take(pa.array(done, pa.int64())), [found[i] for i in done])
            carried = rows.slice(n - 1, 1), found[-1], bool(alive[-1]), bool(shown[-1])
        if carried is not None and carried[3]:
            yield told(carried[0], [carried[1]])

    return fold


def _listed(found) -> list:
    found = np.asarray(found) if not isinstance(found, (list, np.ndarray)) else found
    return found.tolist() if isinstance(found, np.ndarray) else found


def _pick(named: list[np.ndarray], rows: np.ndarray):
    return named[0][rows] if len(named) == 1 else tuple(c[rows] for c in named)


def _typed(acc: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Accumulators as an array of their own kind where that is one of numpy's."""
    some = acc[alive].tolist()
    if not some or not all(isinstance(x, (bool, int, float)) for x in some):
        return acc
    found = np.zeros(len(acc), np.asarray(some).dtype)
    found[alive] = some
    return found
