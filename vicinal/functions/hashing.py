"""Locality sensitive hash families and the bucket keys composed from them.

``k`` hash functions per table and at most ``L`` tables are served by only
``(k/2) * m`` drawn functions: function ``i`` belongs to group ``i % m`` and every pair
of groups is one table.  Two vectors share a bucket of some table exactly when at
least two of the ``m`` groups agree on them.

All bins of a vector (its *signature*) come from one matrix product per Arrow batch;
``signature_expr`` is the same in built-in expressions.  Groups, tables and keys are
then plain column look-ups into the signature, without lambdas or shuffles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.functions.vectors import dot

# Modulus 2^31 - 5 and multiplier bound 2^29 of the linear key hash,
# base and mask of the string hash.
KEY_HASH_MODULUS = 2147483643
KEY_HASH_MULTIPLIER_BOUND = 536870912
STRING_HASH_BASE = 31
STRING_HASH_MASK = 2147483647

FUNCTIONS_SCHEMA = "fn INT, grp INT, a ARRAY<DOUBLE>, b DOUBLE"


def num_groups(num_tables: int) -> int:
    """``m`` such that ``m * (m - 1) / 2`` tables come closest to ``num_tables`` from below."""
    return (1 + math.isqrt(8 * (num_tables + 1))) // 2


def matrix(vectors: pa.Array, dimension: int) -> np.ndarray:
    """Arrow lists as an ``(n, dimension)`` block; other lengths or NULL numbers are errors."""
    lengths = pc.list_value_length(vectors)
    if len(vectors) and not pc.all(pc.equal(lengths, dimension)).as_py():
        raise ValueError(f"expected vectors of {dimension} numbers, got {pc.unique(lengths)}")
    block = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), dimension)
    if not np.isfinite(block).all():
        raise ValueError("vectors must hold finite numbers only")
    return block


@dataclass(frozen=True, eq=False)
class HashFamily:
    """Drawn hash functions; the same seed gives the same family on every run."""

    num_functions: int
    num_tables: int
    dimension: int
    bin_length: float
    a: np.ndarray  # (half_k * m, dimension)
    b: np.ndarray | None  # (half_k * m,); None for the sign family

    def __post_init__(self):
        if self.num_functions < 2 or self.num_functions % 2:
            raise ValueError("num_functions must be even and at least 2")
        if self.num_tables < 1 or self.dimension < 1 or not self.bin_length > 0:
            raise ValueError("num_tables, dimension and bin_length must be positive")
        if self.a.shape != (self.half_k * self.m, self.dimension):
            raise ValueError(f"functions of shape {self.a.shape} do not match the parameters")

    @classmethod
    def draw(
        cls,
        num_functions: int,
        num_tables: int,
        dimension: int,
        bin_length: float,
        seed: int,
        kind: str = "pstable",
    ) -> HashFamily:
        """Gaussian directions and, for ``pstable``, independent offsets in [0, bin_length)."""
        if kind not in ("pstable", "sign"):
            raise ValueError(f"unknown hash family {kind!r}")
        rows = (num_functions // 2) * num_groups(num_tables)
        directions, offsets = np.random.SeedSequence(seed).spawn(2)
        a = np.random.default_rng(directions).standard_normal((rows, dimension))
        b = np.random.default_rng(offsets).random(rows) * bin_length if kind == "pstable" else None
        return cls(num_functions, num_tables, dimension, bin_length, a, b)

    @property
    def kind(self) -> str:
        return "sign" if self.b is None else "pstable"

    @property
    def m(self) -> int:
        return num_groups(self.num_tables)

    @property
    def half_k(self) -> int:
        return self.num_functions // 2

    @property
    def groups(self) -> list[list[int]]:
        """Function numbers of each group."""
        return [list(range(g, self.half_k * self.m, self.m)) for g in range(self.m)]

    @property
    def tables(self) -> list[tuple[int, int]]:
        """Group pair of each table, in lexicographic order."""
        return list(combinations(range(self.m), 2))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (i, i % self.m, [float(x) for x in self.a[i]], None if self.b is None else float(self.b[i]))
            for i in range(len(self.a))
        ]
        return spark.createDataFrame(rows, FUNCTIONS_SCHEMA)

    # -- signature: one bin per function ------------------------------------------------

    def signature(self, v: Column) -> Column:
        """``ARRAY<BIGINT>`` of all bins, one matrix product per Arrow batch."""
        a, b, width, dimension = self.a, self.b, self.bin_length, self.dimension
        count = len(a)

        @F.arrow_udf("array<bigint>")
        def bins(vectors: pa.Array) -> pa.Array:
            if vectors.null_count:
                raise ValueError("vectors must not be NULL")
            projections = matrix(vectors, dimension) @ a.T
            if b is None:
                found = (projections > 0).astype(np.int64)
            else:
                found = np.floor((projections + b) / width).astype(np.int64)
            offsets = np.arange(0, found.size + 1, count, dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))

        return bins(v)

    def signature_expr(self, v: Column) -> Column:
        """The same bins in built-in expressions, for single values and small frames."""
        if self.b is None:
            return F.array(*[sign_bin(v, F.lit(a.tolist())) for a in self.a])
        return F.array(
            *[
                pstable_bin(v, F.lit(a.tolist()), F.lit(float(b)), self.bin_length)
                for a, b in zip(self.a, self.b)
            ]
        )

    # -- groups, tables and keys out of a signature --------------------------------------

    def group_bins(self, sig: Column) -> Column:
        """``ARRAY<ARRAY<BIGINT>>``: the bins of each group."""
        return F.array(*[F.array(*[F.get(sig, F.lit(f)) for f in group]) for group in self.groups])

    def expand_tables(self, df: DataFrame, sig: str = "sig") -> DataFrame:
        """One row per table with ``table_id`` and ``bins``, read off the signature."""
        members = self.groups
        chosen = [members[i] + members[j] for i, j in self.tables]
        table_id = F.col("table_id")
        slots = [F.get(_ints(column), table_id) for column in zip(*chosen)]
        kept = df.columns
        return df.select("*", F.explode(_ints(range(len(chosen)))).alias("table_id")).select(
            *kept, "table_id", F.array(*[F.get(F.col(sig), s) for s in slots]).alias("bins")
        )

    def meet(self, ours: np.ndarray, theirs: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether rows ``i`` of one block of signatures and ``j`` of another share a bucket of some table."""
        agreeing = np.zeros(len(i), np.int64)
        for members in self.groups:
            agree = np.ones(len(i), bool)
            for f in members:
                agree &= ours[i, f] == theirs[j, f]
            agreeing += agree
        return agreeing > 1

    def first_match(self, table_id: Column, ours: Column, theirs: Column) -> Column:
        """True in just one of the tables in which two signatures meet: the first.

        A pair met in the table of groups (i, j) met earlier exactly when another group
        below j agrees too.  Keeping only first meetings makes candidates distinct
        without any shuffle.
        """
        lower = F.get(_ints(i for i, _ in self.tables), table_id)
        upper = F.get(_ints(j for _, j in self.tables), table_id)
        earlier = F.lit(False)
        for g, members in enumerate(self.groups[:-1]):
            agree = F.lit(True)
            for f in members:
                agree = agree & (F.get(ours, F.lit(f)) == F.get(theirs, F.lit(f)))
            earlier = earlier | ((F.lit(g) < upper) & (F.lit(g) != lower) & agree)
        return ~earlier


def _ints(values) -> Column:
    """Array literal of ints, handed to the JVM in one piece."""
    return F.expr(f"array({','.join(str(int(x)) for x in values)})")


# -- single hash functions as column expressions -----------------------------------------


def pstable_bin(v: Column, a: Column, b: Column, bin_length: float) -> Column:
    """``floor((a . v + b) / bin_length)`` as BIGINT."""
    return F.floor((dot(a, v) + b) / F.lit(float(bin_length)))


def sign_bin(v: Column, a: Column) -> Column:
    """1 if ``v`` lies strictly on the positive side of the hyperplane of ``a``, else 0."""
    return F.when(dot(a, v) > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def key_multipliers(length: int, seed: int) -> list[int]:
    """Seeded multipliers of the linear key hash."""
    rng = np.random.default_rng(seed)
    return [int(x) for x in rng.integers(1, KEY_HASH_MULTIPLIER_BOUND, size=length)]


def compact_key(bins: Column, multipliers: list[int]) -> Column:
    """Linear hash of a list of bins into one BIGINT in [0, 2^31 - 5).

    Bins are reduced before they are multiplied, so no product leaves BIGINT.
    """
    modulus = F.lit(KEY_HASH_MODULUS).cast("bigint")
    total = F.lit(0).cast("bigint")
    for i, multiplier in enumerate(multipliers):
        term = F.pmod(F.get(bins, F.lit(i)), modulus) * F.lit(multiplier).cast("bigint")
        total = total + F.pmod(term, modulus)
    return F.pmod(total, modulus)


def bucket_partition(key: Column, num_partitions: int) -> Column:
    """Partition number of a compact key, always in [0, num_partitions)."""
    return F.pmod(key, F.lit(num_partitions).cast("bigint")).cast("int")


def string_key_hash(key: Column) -> Column:
    """Base-31 string hash kept to 31 bits."""
    mask = F.lit(STRING_HASH_MASK).cast("bigint")
    return F.aggregate(
        F.filter(F.split(key, ""), lambda c: c != ""),
        F.lit(0).cast("bigint"),
        lambda h, c: (h * STRING_HASH_BASE + F.ascii(c)).bitwiseAND(mask),
    )
