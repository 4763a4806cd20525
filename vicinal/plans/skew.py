"""Exact handling of hot keys: split lists and two-sided salted joins.

A hot key never meets a single task here.  Keys whose row count exceeds a cap are
found with a partially aggregated count; their rows are dealt over
``ceil(count / cap)`` segments by a hash of a row id, and the other side of a join
is copied to each of those segments.  All other keys have one segment and are
neither copied nor moved more than in a plain join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.plans.sizing import cut_lineage, fits, fits_bytes

# Multiplier and modulus of the "minimal standard" Lehmer generator (public constants).
LEHMER_MULTIPLIER = 48271
LEHMER_MODULUS = 2147483647

#: Heavy keys are few (at most rows / cap); this many may be broadcast, if their bytes allow.
HEAVY_KEY_ROWS = 100_000

#: Copies of each heavy key where they are too many to broadcast: its rows look them up from
#: as many tasks.
HEAVY_COPIES = 64


def spread(row_id: Column) -> Column:
    """Well mixed non-negative BIGINT from a BIGINT id, in plain arithmetic."""
    modulus = F.lit(LEHMER_MODULUS).cast("bigint")
    return F.pmod(F.pmod(row_id.cast("bigint"), modulus) * LEHMER_MULTIPLIER, modulus)


def heavy_keys(
    df: DataFrame, keys: Sequence[str], cap: int, name: str, load: Column | None = None
) -> DataFrame:
    """Keys with a load (rows, if not told otherwise) above ``cap`` and the number of
    segments each one needs."""
    return (
        df.groupBy(*keys)
        .agg((F.count(F.lit(1)) if load is None else load).alias("n"))
        .filter(F.col("n") > cap)
        .select(*keys, F.ceil(F.col("n") / cap).cast("bigint").alias(name))
    )


def add_segment(
    df: DataFrame, keys: Sequence[str], row_id: Column, cap: int, load: Column | None = None
) -> DataFrame:
    """Add ``segment``: 0 for ordinary keys, a hashed segment number for hot ones."""
    heavy = _settled(heavy_keys(df, keys, cap, "n_segments", load))
    if heavy is None:
        return df.withColumn("segment", F.lit(0).cast("bigint"))
    segment = F.pmod(spread(row_id), F.coalesce("n_segments", F.lit(1)))
    return _look_up(df, heavy, keys, row_id).withColumn("segment", segment).drop("n_segments")


def _settled(heavy: DataFrame) -> DataFrame | None:
    """Heavy keys worked out once, None when there are none."""
    heavy = cut_lineage(heavy)
    return None if fits(heavy, 0) else heavy


def _look_up(df: DataFrame, heavy: DataFrame, keys: Sequence[str], row_id: Column) -> DataFrame:
    """``df`` with the columns of its key in ``heavy``, NULL for an ordinary one.

    Any number of heavy keys will do: those that cannot be broadcast are copied, and the
    rows of a key meet them dealt over the copies, so that no key is met by one task.
    """
    if fits(heavy, HEAVY_KEY_ROWS) and fits_bytes(heavy):
        return df.join(F.broadcast(heavy), list(keys), "left")
    copies = F.sequence(F.lit(0).cast("bigint"), F.lit(HEAVY_COPIES - 1).cast("bigint"))
    dealt = df.withColumn("_copy", F.pmod(spread(row_id), F.lit(HEAVY_COPIES).cast("bigint")))
    copied = heavy.withColumn("_copy", F.explode(copies))
    return dealt.join(copied.hint("merge"), [*keys, "_copy"], "left").drop("_copy")


def segmented_lists(
    df: DataFrame, keys: Sequence[str], member: str, cap: int, row_id: Column | None = None
) -> DataFrame:
    """``(keys, segment, members)`` with about ``cap`` members per row at most.

    The union of a key's segments is its whole list; no group is collected unbounded.
    ``row_id`` tells the rows of a key apart.  Without one, equal members are counted
    first and a member that occurs very often is cut into runs of at most ``cap``.
    """
    keys = list(keys)
    if row_id is not None:
        dealt = add_segment(df, keys, row_id, cap)
        members = F.collect_list(member)
    else:
        counted = df.groupBy(*keys, member).agg(F.count(F.lit(1)).alias("n"))
        last = F.ceil(F.col("n") / cap).cast("bigint") - 1
        runs = counted.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("run"))
        weight = F.least(F.lit(cap), F.col("n") - F.col("run") * cap).cast("int")
        runs = runs.select(*keys, member, "run", weight.alias("weight"))
        dealt = add_segment(runs, keys, F.xxhash64(member, "run"), cap, F.sum("weight"))
        repeated = F.array_repeat(member, F.col("weight"))
        members = F.flatten(F.collect_list(F.when(F.col(member).isNotNull(), repeated)))
    return dealt.groupBy(*keys, "segment").agg(F.sort_array(members).alias("members"))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_id: Column,
    right_id: Column | None,
    cap: int,
    left_heavy: DataFrame | None = None,
) -> DataFrame:
    """Inner equi-join on ``keys`` that splits hot keys of both sides, exactly.

    ``right_id=None`` declares ``keys`` unique on the right, so that only the left
    is measured.  Each pair of rows meets in exactly one (left, right) segment.  ``left_heavy``
    (``keys, n``) are known large keys of the left, which then is not counted; a key missed there
    is not split, and no row depends on it.
    """
    keys = list(keys)
    if left_heavy is None:
        heavy = heavy_keys(left, keys, cap, "nl")
    else:
        heavy = left_heavy.filter(F.col("n") > cap).select(*keys, F.ceil(F.col("n") / cap).cast("bigint").alias("nl"))
    if right_id is None:
        heavy = heavy.withColumn("nr", F.lit(1).cast("bigint"))
    else:
        heavy = heavy.join(heavy_keys(right, keys, cap, "nr"), keys, "full_outer").select(
            *keys,
            F.coalesce("nl", F.lit(1)).cast("bigint").alias("nl"),
            F.coalesce("nr", F.lit(1)).cast("bigint").alias("nr"),
        )
    heavy = _settled(heavy)
    if heavy is None:
        return left.join(right.hint("merge"), keys)
    one = F.lit(1).cast("bigint")
    nl, nr = F.coalesce("nl", one), F.coalesce("nr", one)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    salted_left = (
        _look_up(left, heavy, keys, left_id)
        .withColumn("sl", F.pmod(spread(left_id), nl))
        .withColumn("sr", every(nr))
        .drop("nl", "nr")
    )
    own = F.lit(0).cast("bigint") if right_id is None else F.pmod(spread(right_id), nr)
    salted_right = (
        _look_up(right, heavy, keys, F.lit(0) if right_id is None else right_id)
        .withColumn("sr", own)
        .withColumn("sl", every(nl))
        .drop("nl", "nr")
    )
    # Both sides are known to be big; packed file sizes must not suggest a broadcast.
    return salted_left.join(salted_right.hint("merge"), [*keys, "sl", "sr"]).drop("sl", "sr")
