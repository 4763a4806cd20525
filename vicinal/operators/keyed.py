"""Keyed tables: a DataFrame with unique key columns and one value column.

Look-ups, updates, deletes, joins, differences and keyed aggregation, all as ordinary
DataFrame plans.  A NULL value counts as an absent key in look-ups and for the other
side of a join.  User functions are Column functions; the key they see is the key
column, or a struct of the key columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.functions.vectors import L2, Metric
from vicinal.operators import search
from vicinal.operators.folds import AggregateFold, OrderedFold
from vicinal.operators.steps import StepFold
from vicinal.plans.sizing import cut_lineage, fits_bytes
from vicinal.plans.skew import segmented_lists

OLD, NEW = "_old", "_new"


def _key_list(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def last_wins(
    pairs: DataFrame, keys: str | Sequence[str], value: str, order: Sequence[str]
) -> DataFrame:
    """One row per key: the value at the highest ``order``, ties by the higher value."""
    position = F.struct(*order, value) if len(order) else F.struct(value)
    return pairs.groupBy(*_key_list(keys)).agg(F.max_by(value, position).alias(value))


def collect_lists(
    pairs: DataFrame,
    keys: str | Sequence[str],
    value: str,
    list_rows: int = 100_000,
    row_id: Column | None = None,
) -> DataFrame:
    """``(keys, segment, members)``: all values per key in sorted lists of limited length.

    The values of a longer list are dealt by ``row_id``, a BIGINT that should differ within a
    key, else by themselves.
    """
    return segmented_lists(pairs, _key_list(keys), value, list_rows, row_id)


@dataclass(frozen=True)
class KeyedTable:
    """``df`` holds the key columns and the value column; keys are unique.

    ``derived`` marks the result of an upsert, whose plan must not be read twice.
    """

    df: DataFrame
    keys: tuple[str, ...]
    value: str = "value"
    derived: bool = False

    # -- construction ------------------------------------------------------------------

    @classmethod
    def of(cls, df: DataFrame, keys: str | Sequence[str], value: str, trusted: bool = False) -> KeyedTable:
        """A frame whose keys are unique; pairs whose keys may repeat, on
        either side of an operation, go through ``from_pairs`` or ``fold``.

        One count of the keys alone makes sure of it, and a repeated key is an error.  ``trusted`` says
        that the keys are known to be unique (a primary key, the result of a grouping) and saves that.
        """
        keys = _key_list(keys)
        if not trusted:
            counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
            repeated = counts.filter(F.col("_n") > 1).limit(1).collect()
            if repeated:
                raise ValueError(f"key {tuple(repeated[0])[:-1]} stands {repeated[0]._n} times")
        return cls(df.select(*keys, value), tuple(keys), value)

    @classmethod
    def from_pairs(
        cls, pairs: DataFrame, keys: str | Sequence[str], value: str, order: Sequence[str]
    ) -> KeyedTable:
        """Table from pairs with repeated keys; the last value in ``order`` wins."""
        return cls(last_wins(pairs, keys, value, order), tuple(_key_list(keys)), value)

    @classmethod
    def fold(
        cls,
        pairs: DataFrame,
        keys: str | Sequence[str],
        value: str,
        how: AggregateFold | OrderedFold | StepFold,
    ) -> KeyedTable:
        """Table from pairs with all values of a key folded into one."""
        keys = _key_list(keys)
        return cls(how.apply(pairs, keys, value), tuple(keys), value)

    def create_using(self, pairs: DataFrame, value: str, order: Sequence[str]) -> KeyedTable:
        """Last-wins table of other pairs under this table's keys.

        Grouping leaves it hash-partitioned by the keys, ready to be joined to this one.
        """
        return KeyedTable(last_wins(pairs, self.keys, value, order), self.keys, value)

    def aggregate_using(
        self, pairs: DataFrame, value: str, agg: Callable[[Column], Column]
    ) -> KeyedTable:
        """Reduce other pairs by this table's keys; keys absent here are kept too."""
        return KeyedTable.fold(pairs, self.keys, value, AggregateFold(agg))

    # -- look-ups ------------------------------------------------------------------------

    def get(self, *key) -> DataFrame:
        """The entry of one key, if it has a value; the filter reaches the file scan."""
        found = self.df
        for name, part in zip(self.keys, key, strict=True):
            found = found.filter(F.col(name) == F.lit(part))
        return found.filter(F.col(self.value).isNotNull())

    def multiget(self, wanted: DataFrame) -> DataFrame:
        """Entries of the wanted keys that have a value; repeated requests count once."""
        present = self.df.filter(F.col(self.value).isNotNull())
        return present.join(self._requested(wanted), list(self.keys), "left_semi")

    def _requested(self, wanted: DataFrame) -> DataFrame:
        """Key rows: broadcast if few, so that the table is not shuffled; else distinct."""
        asked = wanted.select(*self.keys)
        return F.broadcast(asked) if fits_bytes(asked) else asked.distinct()

    def multifilter(
        self,
        queries: DataFrame,
        wanted: DataFrame,
        radius: float,
        dimension: int,
        metric: Metric = L2,
        inclusive: bool = False,
    ) -> DataFrame:
        """Of the wanted ``(query_id, key)`` pairs those whose vector is within ``radius``."""
        (key,) = self.keys
        vectors = self.df.select(F.col(key).alias("vec_id"), F.col(self.value).alias("v"))
        pairs = wanted.select("query_id", F.col(key).alias("vec_id")).distinct()
        near = search.multifilter(vectors, queries, pairs, radius, dimension, metric, inclusive)
        return near.withColumnRenamed("vec_id", key)

    def count(self) -> DataFrame:
        """Number of entries, as a one-row frame."""
        return self.df.agg(F.count(F.lit(1)).alias("count"))

    # -- maps and filters ------------------------------------------------------------------

    @property
    def key(self) -> Column:
        return F.col(self.keys[0]) if len(self.keys) == 1 else F.struct(*self.keys)

    def _with(self, df: DataFrame, value: Column) -> KeyedTable:
        shown = df.select(*self.keys, value.alias(self.value))
        return KeyedTable(shown, self.keys, self.value, self.derived)

    def map_values(self, f: Callable[[Column], Column]) -> KeyedTable:
        return self._with(self.df, f(F.col(self.value)))

    def map_entries(self, f: Callable[[Column, Column], Column]) -> KeyedTable:
        """Map values with the key in sight."""
        return self._with(self.df, f(self.key, F.col(self.value)))

    def filter(self, predicate: Callable[[Column, Column], Column]) -> KeyedTable:
        kept = self.df.filter(predicate(self.key, F.col(self.value)))
        return KeyedTable(kept, self.keys, self.value, self.derived)

    # -- updates -----------------------------------------------------------------------------

    def put(self, key: Sequence, value) -> KeyedTable:
        """Insert or replace one entry: one pass over the table, no shuffle."""
        spark, kinds = self.df.sparkSession, self.df.schema
        same = F.lit(True)
        for name, part in zip(self.keys, key, strict=True):
            same = same & F.col(name).eqNullSafe(F.lit(part))
        columns = [
            F.lit(part).cast(kinds[name].dataType).alias(name)
            for name, part in zip([*self.keys, self.value], [*key, value])
        ]
        added = spark.range(1).select(*columns)
        kept = self.df.filter(~same).unionByName(added)
        return KeyedTable(kept, self.keys, self.value, self.derived)

    def multiput(
        self,
        updates: KeyedTable,
        merge: Callable[[Column, Column, Column], Column] | None = None,
        z: Callable[[Column, Column], Column] | None = None,
    ) -> KeyedTable:
        """Upsert: ``merge(key, old, new)`` where a value exists, else ``z(key, new)``.

        Without ``merge`` the new value wins; without ``z`` it is stored as it is.
        Updates small enough to broadcast leave the table where it is: one pass changes
        old entries, another over the keys alone finds which updates are new.  On the result of
        an upsert, which would be worked out once for each pass, one full outer join runs
        instead, so that the plan of a chain grows by one join a step.
        """
        old, new, key = F.col(OLD), F.col(NEW), self.key
        inserted = new if z is None else z(key, new)
        updated = new if merge is None else merge(key, old, new)
        right = updates.df.select(
            *self._renamed(updates), F.col(updates.value).alias(NEW), F.lit(True).alias("_put")
        )
        names = list(self.keys)

        def settled(both: DataFrame) -> KeyedTable:
            value = F.when(F.col("_put").isNull(), old).when(old.isNull(), inserted)
            return replace(self._with(both, value.otherwise(updated)), derived=True)

        if self.derived:
            return settled(self._old().join(right, names, "full_outer"))
        right = cut_lineage(right)  # worked out once for the size check and both passes
        if not fits_bytes(right):
            return settled(self._old().join(right, names, "full_outer"))
        small = F.broadcast(right)
        present = self.df.select(*names).join(small, names, "left_semi")
        fresh = right.join(F.broadcast(present), names, "left_anti")
        fresh = fresh.withColumn(OLD, F.lit(None).cast(self.df.schema[self.value].dataType))
        kept = settled(self._old().join(small, names, "left"))
        return KeyedTable(kept.df.unionByName(settled(fresh).df), self.keys, self.value, True)

    def delete(self, doomed: DataFrame) -> KeyedTable:
        """Remove the given keys; absent ones are ignored."""
        kept = self.df.join(self._requested(doomed), list(self.keys), "left_anti")
        return KeyedTable(kept, self.keys, self.value, self.derived)

    # -- joins -------------------------------------------------------------------------------

    def _renamed(self, other: KeyedTable) -> list[Column]:
        return [F.col(theirs).alias(ours) for ours, theirs in zip(self.keys, other.keys, strict=True)]

    def _old(self) -> DataFrame:
        return self.df.select(*self.keys, F.col(self.value).alias(OLD))

    def _joined(self, other: KeyedTable, how: str) -> DataFrame:
        right = other.df.select(*self._renamed(other), F.col(other.value).alias(NEW))
        if how != "full_outer":
            right = right.filter(F.col(NEW).isNotNull())
        return self._old().join(right, list(self.keys), how)

    def full_outer_join(self, other: KeyedTable, f: Callable[..., Column]) -> KeyedTable:
        """All keys of both sides; ``f(key, ours, theirs)`` sees NULL for a missing side."""
        return self._with(self._joined(other, "full_outer"), f(self.key, F.col(OLD), F.col(NEW)))

    def left_join(self, other: KeyedTable, f: Callable[..., Column]) -> KeyedTable:
        """All keys of this table; ``f(key, ours, theirs or NULL)``."""
        return self._with(self._joined(other, "left"), f(self.key, F.col(OLD), F.col(NEW)))

    def inner_join(self, other: KeyedTable, f: Callable[..., Column]) -> KeyedTable:
        """Keys with a value on the other side; ``f(key, ours, theirs)``."""
        return self._with(self._joined(other, "inner"), f(self.key, F.col(OLD), F.col(NEW)))

    def update_join(
        self,
        pairs: DataFrame,
        value: str,
        how: AggregateFold | OrderedFold | StepFold,
        f: Callable[..., Column] | None = None,
    ) -> KeyedTable:
        """Keep every key; where ``pairs`` has it, the value becomes ``f(key, old, folded)``.

        Repeated keys of ``pairs`` are first folded into one, so applying them one after
        the other must equal applying their fold.  A ``StepFold`` does apply them one after the
        other, onto the old value, and takes no ``f``.
        """
        if isinstance(how, StepFold):
            return KeyedTable(how.onto(self.df, pairs, self.keys, self.value, value), self.keys, self.value)
        other = KeyedTable.fold(pairs, self.keys, value, how)
        old, new = F.col(OLD), F.col(NEW)
        both = self._joined(other, "left")
        keep = old.isNull() | new.isNull()
        return self._with(both, F.when(keep, old).otherwise(f(self.key, old, new)))

    def diff(self, other: KeyedTable) -> KeyedTable:
        """Entries of this table whose key has another value in ``other``."""
        both = self._joined(other, "inner")
        return self._with(both.filter(~F.col(OLD).eqNullSafe(F.col(NEW))), F.col(OLD))
