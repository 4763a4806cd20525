"""Keyed tables laid out by key: stored in buckets, joined and updated without moving them.

A stored table is one of Spark's own bucketed tables.  Joins, look-ups, updates and deletes
send the other side to the table's buckets; the table itself is never shuffled, however many steps
follow one another.  For that a table under change is held as two parts: the entries whose
keys lie in the buckets (``kept``), and the entries of new keys (``fresh``), whose size is
that of the updates.

An order-free digest of every bucket is stored beside a table.  The difference of two stored tables
compares digests first and reads only the buckets that differ.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.operators.folds import AggregateFold, OrderedFold
from vicinal.operators.keyed import NEW, OLD, KeyedTable, last_wins
from vicinal.operators.steps import StepFold
from vicinal.plans.sizing import fits_bytes, work_path

#: Files of a bucketed table carry the bucket's number ahead of their ending.
_BUCKET_FILE = re.compile(r"_(\d{5,})(?:\.[^/]*)?$")
#: Keys of a look-up that become literals of a filter, for which Spark reads only their buckets.
LITERAL_KEYS = 200
_DIGESTS = "_digests"


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    """The bucket in which Spark keeps a key."""
    return F.pmod(F.hash(*keys), F.lit(buckets))


def _digest(df: DataFrame, keys: Sequence[str], value: str, buckets: int) -> DataFrame:
    """``bucket, n, x, s``: number, exclusive or and sum of the hashes of a bucket's entries."""
    entry = df.select(bucket_of(keys, buckets).alias("bucket"), F.xxhash64(*keys, value, F.col(value).isNull()).alias("h"))
    return entry.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(20,0)")).alias("s")
    )


@dataclass(frozen=True)
class BucketedTable:
    """``kept`` holds entries in the buckets of a stored table, ``owned`` their keys, and ``fresh`` entries
    of other keys.  ``name`` is the stored table as long as nothing was changed."""

    kept: DataFrame
    owned: DataFrame
    keys: tuple[str, ...]
    value: str
    buckets: int
    fresh: DataFrame | None = None
    name: str | None = None

    # -- storage -----------------------------------------------------------------------------

    @classmethod
    def store(
        cls,
        pairs: DataFrame,
        keys: str | Sequence[str],
        value: str,
        name: str,
        order: Sequence[str] = (),
        buckets: int | None = None,
        path: str | None = None,
    ) -> BucketedTable:
        """Store pairs under a table name; of repeated keys the last value in ``order`` wins.

        The table has as many buckets as the session has shuffle partitions, if not told otherwise.  It lies
        below ``path``, or else in the shared folder.
        """
        spark, keys = pairs.sparkSession, [keys] if isinstance(keys, str) else list(keys)
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        unique = last_wins(pairs, keys, value, order).repartition(buckets, *keys)
        return cls._write([unique], spark, keys, value, buckets, name, path)

    @classmethod
    def _write(cls, parts, spark, keys, value, buckets, name, path) -> BucketedTable:
        path = path or work_path(spark, "bucketed")
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        for i, part in enumerate(parts):
            writer = part.select(*keys, value).write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet")
            writer.mode("overwrite" if i == 0 else "append").option("path", path).saveAsTable(name)
        properties = {"keys": ",".join(keys), "value": value, "buckets": str(buckets), "digests": f"{path}{_DIGESTS}"}
        told = ", ".join(f"'vicinal.{k}' = '{v}'" for k, v in properties.items())
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({told})")
        _digest(spark.table(name), keys, value, buckets).coalesce(1).write.mode("overwrite").parquet(properties["digests"])
        return cls.open(spark, name)

    @classmethod
    def open(cls, spark: SparkSession, name: str) -> BucketedTable:
        """A table stored under a name."""
        told = _properties(spark, name)
        df, keys = spark.table(name), told["keys"].split(",")
        return cls(df, df.select(*keys), tuple(keys), told["value"], int(told["buckets"]), name=name)

    def save(self, name: str, path: str | None = None) -> BucketedTable:
        """Store a changed table under another name: its kept part stays in its buckets, and the new
        entries alone are sent to theirs."""
        if name == self.name:
            raise ValueError("a table cannot be stored over itself")
        parts = [self.kept]
        if self.fresh is not None:
            parts.append(self.fresh.repartition(self.buckets, *self.keys))
        return self._write(parts, self.kept.sparkSession, self.keys, self.value, self.buckets, name, path)

    def digests(self) -> DataFrame:
        """``bucket, n, x, s`` of an unchanged stored table."""
        spark = self.kept.sparkSession
        return spark.read.parquet(_properties(spark, self.name)["digests"])

    def read_buckets(self, wanted: Sequence[int]) -> DataFrame:
        """The entries of some buckets of an unchanged stored table; no other file is opened."""
        spark, wanted = self.kept.sparkSession, set(wanted)
        found = [f for f in self.kept.inputFiles() if int(_BUCKET_FILE.search(f).group(1)) in wanted]
        reader = spark.read.schema(self.kept.schema)
        return reader.parquet(*found) if found else spark.createDataFrame([], self.kept.schema)

    # -- the whole ---------------------------------------------------------------------------

    @property
    def df(self) -> DataFrame:
        return self.kept if self.fresh is None else self.kept.unionByName(self.fresh)

    @property
    def key(self) -> Column:
        return F.col(self.keys[0]) if len(self.keys) == 1 else F.struct(*self.keys)

    def count(self) -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias("count"))

    def _each(self, change: Callable[[DataFrame], DataFrame]) -> BucketedTable:
        """The same change of the values of both parts."""
        fresh = None if self.fresh is None else change(self.fresh)
        return replace(self, kept=change(self.kept), fresh=fresh, name=None)

    def map_values(self, f: Callable[[Column], Column]) -> BucketedTable:
        return self._each(lambda df: df.select(*self.keys, f(F.col(self.value)).alias(self.value)))

    def map_entries(self, f: Callable[[Column, Column], Column]) -> BucketedTable:
        return self._each(lambda df: df.select(*self.keys, f(self.key, F.col(self.value)).alias(self.value)))

    def filter(self, predicate: Callable[[Column, Column], Column]) -> BucketedTable:
        left = self._each(lambda df: df.filter(predicate(self.key, F.col(self.value))))
        return replace(left, owned=left.kept.select(*self.keys))

    # -- look-ups ----------------------------------------------------------------------------

    def get(self, *key) -> DataFrame:
        """The entry of one key, if it has a value; one bucket is read."""
        found = self.df.filter(F.col(self.value).isNotNull())
        for name, part in zip(self.keys, key, strict=True):
            found = found.filter(F.col(name) == F.lit(part))
        return found

    def multiget(self, wanted: DataFrame) -> DataFrame:
        """Entries of the wanted keys that have a value; repeated requests count once.

        A few keys become a filter, for which Spark opens only their buckets and, as these are sorted,
        their row groups.  Others meet the table in its buckets.
        """
        asked = wanted.select(*self.keys)
        present = self.df.filter(F.col(self.value).isNotNull())
        if len(self.keys) == 1:
            few = asked.limit(LITERAL_KEYS + 1).collect()
            if len(few) <= LITERAL_KEYS:
                return present.filter(F.col(self.keys[0]).isin(sorted({r[0] for r in few if r[0] is not None})))
        few = fits_bytes(asked)
        return self._met(lambda df: df.filter(F.col(self.value).isNotNull()), F.broadcast(asked) if few else asked, "left_semi").df

    def _met(self, change: Callable[[DataFrame], DataFrame], right: DataFrame, how: str) -> BucketedTable:
        return self._each(lambda df: change(df).join(right, list(self.keys), how).select(*self.keys, self.value))

    # -- joins -------------------------------------------------------------------------------

    def _right(self, other: KeyedTable | BucketedTable, absent: bool = True) -> DataFrame:
        """The other side under this table's key names; entries without a value are absent keys."""
        names = [F.col(theirs).alias(ours) for ours, theirs in zip(self.keys, other.keys, strict=True)]
        right = other.df.select(*names, F.col(other.value).alias(NEW))
        return right.filter(F.col(NEW).isNotNull()) if absent else right

    def _old(self, df: DataFrame) -> DataFrame:
        return df.select(*self.keys, F.col(self.value).alias(OLD))

    def _shown(self, df: DataFrame, value: Column) -> DataFrame:
        return df.select(*self.keys, value.alias(self.value))

    def _joined(self, right: DataFrame, how: str, f: Callable[..., Column]) -> BucketedTable:
        return self._each(
            lambda df: self._shown(self._old(df).join(right, list(self.keys), how), f(self.key, F.col(OLD), F.col(NEW)))
        )

    def left_join(self, other: KeyedTable | BucketedTable, f: Callable[..., Column]) -> BucketedTable:
        """All keys of this table; ``f(key, ours, theirs or NULL)``."""
        return self._joined(self._right(other), "left", f)

    def inner_join(self, other: KeyedTable | BucketedTable, f: Callable[..., Column]) -> BucketedTable:
        """Keys with a value on the other side; ``f(key, ours, theirs)``."""
        joined = self._joined(self._right(other), "inner", f)
        return replace(joined, owned=joined.kept.select(*self.keys))

    def full_outer_join(self, other: KeyedTable | BucketedTable, f: Callable[..., Column]) -> BucketedTable:
        """All keys of both sides; ``f(key, ours, theirs)`` sees NULL for a missing side."""
        right = self._right(other, absent=False)
        value = f(self.key, F.col(OLD), F.col(NEW))
        kept = self._shown(self._old(self.kept).join(right, list(self.keys), "left"), value)
        return self._beside(kept, self._shown(self._beyond(right), value))

    def update_join(
        self,
        pairs: DataFrame,
        value: str,
        how: AggregateFold | OrderedFold | StepFold,
        f: Callable[..., Column] | None = None,
    ) -> BucketedTable:
        """Keep every key; where ``pairs`` has it, the value becomes ``f(key, old, folded)``.

        A ``StepFold`` applies the pairs one after the other, onto the old value; it sorts the entries and
        the pairs together, and so is the one operation that moves the table.
        """
        if isinstance(how, StepFold):
            return self._each(lambda df: how.onto(df, pairs, self.keys, self.value, value))
        folded = KeyedTable.fold(pairs, self.keys, value, how)
        keep = lambda k, old, new: F.when(old.isNull() | new.isNull(), old).otherwise(f(k, old, new))
        return self._joined(self._right(folded), "left", keep)

    def diff(self, other: KeyedTable | BucketedTable) -> DataFrame:
        """Entries of this table whose key has another value in ``other``.

        Two unchanged stored tables of as many buckets compare digests and read the buckets that differ only.
        """
        ours, theirs = self.df, self._right(other)
        if isinstance(other, BucketedTable) and self.name and other.name and self.buckets == other.buckets:
            mine, yours = self.digests(), other.digests().select("bucket", *(F.col(c).alias(f"_{c}") for c in "nxs"))
            same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_{c}")), "nxs", F.lit(True))
            wanted = [r.bucket for r in mine.join(yours, "bucket").filter(~same).select("bucket").collect()]
            ours = self.read_buckets(wanted)
            theirs = self._right(replace(other, kept=other.read_buckets(wanted)))
        both = self._old(ours).join(theirs, list(self.keys))
        return self._shown(both.filter(~F.col(OLD).eqNullSafe(F.col(NEW))), F.col(OLD))

    # -- updates -----------------------------------------------------------------------------

    def _beyond(self, right: DataFrame) -> DataFrame:
        """Entries of new keys beside the rows of ``right`` that are not in the buckets."""
        names = list(self.keys)
        outside = right.join(self.owned, names, "left_anti")
        if self.fresh is None:
            return outside.withColumn(OLD, F.lit(None).cast(self.kept.schema[self.value].dataType))
        return self._old(self.fresh).join(outside, names, "full_outer")

    def _beside(self, kept: DataFrame, fresh: DataFrame) -> BucketedTable:
        return replace(self, kept=kept, fresh=fresh, name=None)

    def multiput(
        self,
        updates: KeyedTable | BucketedTable,
        merge: Callable[[Column, Column, Column], Column] | None = None,
        z: Callable[[Column, Column], Column] | None = None,
    ) -> BucketedTable:
        """Upsert: ``merge(key, old, new)`` where a value exists, else ``z(key, new)``."""
        old, new, key = F.col(OLD), F.col(NEW), self.key
        inserted = new if z is None else z(key, new)
        updated = new if merge is None else merge(key, old, new)
        right = self._right(updates, absent=False).withColumn("_put", F.lit(True))
        value = F.when(F.col("_put").isNull(), old).when(old.isNull(), inserted).otherwise(updated)
        kept = self._shown(self._old(self.kept).join(right, list(self.keys), "left"), value)
        return self._beside(kept, self._shown(self._beyond(right), value))

    def delete(self, doomed: DataFrame) -> BucketedTable:
        """Remove the given keys; absent ones are ignored."""
        gone, names = doomed.select(*self.keys), list(self.keys)
        left = self._each(lambda df: df.join(gone, names, "left_anti"))
        return replace(left, owned=self.owned.join(gone, names, "left_anti"))


def _properties(spark: SparkSession, name: str) -> dict[str, str]:
    rows = spark.sql(f"SHOW TBLPROPERTIES {name}").collect()
    return {r.key.removeprefix("vicinal."): r.value for r in rows if r.key.startswith("vicinal.")}
