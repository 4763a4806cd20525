"""Folds over all values of a key that stay bounded however many values one key has.

Every function of a fold may take the key ahead of its other arguments.

``AggregateFold`` is any built-in aggregate and combines before the shuffle.
``OrderedFold`` folds values in a stated order.  Its step must be associative, as in
``lift(x1) + lift(x2) + ...``: then runs of neighbouring values can be folded
anywhere and their results combined in order, and a key that owns a third of all rows
is shared by many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from inspect import signature

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.plans.sizing import cut_lineage, fits_bytes

#: Values of one key folded by one task at a time.
RUN_ROWS = 10_000


def _with_key(f: Callable[..., Column], arguments: int, key: Column) -> Callable[..., Column]:
    """``f`` of so many arguments, its key filled in if it asks for one."""
    try:
        takes = [p for p in signature(f).parameters.values() if p.default is p.empty]
    except (TypeError, ValueError):
        return f
    return (lambda *xs: f(key, *xs)) if len(takes) == arguments + 1 else f


def _key(keys: Sequence[str]) -> Column:
    return F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)


@dataclass(frozen=True)
class AggregateFold:
    """``agg(value)`` or ``agg(key, value)`` is a built-in aggregate, e.g. ``F.sum`` or ``F.max``.

    It may use the key inside the aggregate only.
    """

    agg: Callable[..., Column]

    def apply(self, pairs: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
        agg = _with_key(self.agg, 1, _key(keys))
        return pairs.groupBy(*keys).agg(agg(F.col(value)).alias(value))


@dataclass(frozen=True)
class OrderedFold:
    """Fold in ``order`` by ``merge(lift(first), lift(next))``, then ``finish``.

    ``order`` should be total within a key; equal positions are folded by value.  Floating-point
    results may differ in their last digits with the number of partitions, as runs are regrouped.
    """

    order: Sequence[str]
    merge: Callable[..., Column]
    lift: Callable[..., Column] = lambda value: value
    finish: Callable[..., Column] = lambda acc: acc
    run_rows: int = RUN_ROWS

    def apply(self, pairs: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
        keys = list(keys)
        order = [f"_o{i}" for i in range(len(self.order))]
        acc = pairs.select(
            *keys,
            *[F.col(c).alias(o) for c, o in zip(self.order, order)],
            _with_key(self.lift, 1, _key(keys))(F.col(value)).alias("_acc"),
        )
        hot = self._hot_keys(acc, keys)
        if hot.isEmpty():
            whole = self._folded(acc, keys, [*order, "_acc"])
        else:
            same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
            small = F.broadcast(hot) if fits_bytes(hot) else hot
            ordinary = self._folded(acc.join(small, same, "left_anti"), keys, [*order, "_acc"])
            (most,) = hot.agg(F.max("_n")).first()
            long = self._fold_long(acc.join(small, same, "left_semi"), keys, order, most)
            whole = ordinary.unionByName(long)
        finish = _with_key(self.finish, 1, _key(keys))
        return whole.select(*keys, finish(F.col("_acc")).alias(value))

    def _hot_keys(self, acc: DataFrame, keys: list[str]) -> DataFrame:
        """Keys with more values than one task folds at a time, counted ahead of the shuffle."""
        counts = acc.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > self.run_rows)
        return cut_lineage(counts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_n"))

    def _fold_long(self, acc: DataFrame, keys: list[str], order: list[str], bound: int) -> DataFrame:
        """Fold keys of ``bound`` values at most, in as many levels as that needs."""
        partitions = int(acc.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        limit = self.run_rows + partitions + 1
        while bound > limit:
            acc = self._fold_runs(acc, keys, order)
            order = ["_o0"]
            bound = -(-bound // self.run_rows) + partitions + 1
        return self._folded(acc, keys, [*order, "_acc"])

    def _fold_runs(self, acc: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
        """Sort by key and order over all tasks, then fold runs of neighbouring rows."""
        by = [*keys, *order, "_acc"]
        runs = (
            acc.repartitionByRange(*by)
            .sortWithinPartitions(*by)
            .withColumn("_pos", F.monotonically_increasing_id())
            .select(
                *keys,
                "_pos",
                (F.col("_pos") - F.pmod(F.col("_pos"), F.lit(self.run_rows))).alias("_o0"),
                "_acc",
            )
        )
        return self._folded(runs, keys, ["_pos", "_acc"], ["_o0"])

    def _folded(self, df: DataFrame, keys: list[str], order: list[str], run: Sequence[str] = ()) -> DataFrame:
        """One accumulator per group out of its few, sorted, accumulators."""
        sorted_runs = F.sort_array(F.collect_list(F.struct(*order)))
        group = [*keys, *run]
        merge = _with_key(self.merge, 2, _key(keys))
        steps = df.groupBy(*group).agg(sorted_runs.alias("_xs"))
        first = F.get(F.col("_xs"), F.lit(0))["_acc"]
        rest = F.slice("_xs", F.lit(2), F.size("_xs"))
        return steps.select(
            *group, F.aggregate(rest, first, lambda a, x: merge(a, x["_acc"])).alias("_acc")
        )
