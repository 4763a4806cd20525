"""Tables in buckets: the same results as plain keyed tables, and the table never moves."""

import uuid

import pytest
from pyspark.sql import functions as F

from vicinal.operators.bucketed import BucketedTable
from vicinal.operators.folds import AggregateFold
from vicinal.operators.keyed import KeyedTable
from vicinal.operators.steps import StepFold


def name():
    return f"t_{uuid.uuid4().hex}"


def stored(df, key="k", value="v", buckets=8, order=()):
    return BucketedTable.store(df, key, value, name(), order, buckets)


def rows(table):
    df = table.df if hasattr(table, "df") else table
    return sorted(map(tuple, df.collect()), key=str)


def scans_moved(df):
    """Whether the rows of each bucketed scan of the plan pass an exchange.

    The right side of an anti or semi join passes on no rows of its own.
    """
    found, above = [], []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        text = line.lstrip(" :+-*")
        depth = len(line) - len(text)
        above = [a for a in above if a[0] < depth]
        above.append((depth, text, "+- " in line[:depth]))
        if "Bucketed: true" in line:
            moved = False
            for (_, node, _), (_, _, last) in zip(above[-2::-1], above[:0:-1]):
                if node.startswith(("SortMergeJoin", "ShuffledHashJoin")) and ("LeftAnti" in node or "LeftSemi" in node) and last:
                    break
                moved |= "Exchange" in node.split(" ")[0]
            found.append(moved)
    return found


@pytest.fixture(scope="module")
def base(spark):
    return spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 1.5).alias("v"))


@pytest.fixture(scope="module")
def other(spark):
    return KeyedTable.of(spark.range(900, 1150).select(F.col("id").alias("x"), F.when(F.col("id") % 7 != 0, F.col("id") * 1.0).alias("u")), "x", "u")


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def both(k, a, b):
    return F.coalesce(a, F.lit(-1.0)) + F.coalesce(b, F.lit(-2.0)) + k


JOINS = {
    "left": lambda t, o: t.left_join(o, both),
    "inner": lambda t, o: t.inner_join(o, both),
    "outer": lambda t, o: t.full_outer_join(o, both),
    "upsert": lambda t, o: t.multiput(o),
    "merge": lambda t, o: t.multiput(o, merge=lambda k, a, b: a + b, z=lambda k, b: b - k),
    "update": lambda t, o: t.update_join(o.df.withColumnRenamed("x", "k"), "u", AggregateFold(F.sum), lambda k, a, b: a - b),
    "delete": lambda t, o: t.delete(o.df.select(F.col("x").alias("k"))),
    "diff": lambda t, o: t.diff(o),
    "multiget": lambda t, o: t.multiget(o.df.select(F.col("x").alias("k"))),
}


@pytest.mark.parametrize("how", JOINS)
def test_joins_equal_plain_ones_and_do_not_move_the_table(spark, base, other, no_broadcast, how):
    plain = KeyedTable.of(base, "k", "v")
    table = stored(base)
    found = JOINS[how](table, other)
    assert rows(found) == rows(JOINS[how](plain, other))
    df = found.df if isinstance(found, BucketedTable) else found
    if how == "multiget":  # the wanted keys are few enough to be broadcast
        assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
    else:
        moved = scans_moved(df)
        assert moved and not any(moved)


def test_chains_leave_the_table_in_place(spark, base, no_broadcast):
    table, plain = stored(base), KeyedTable.of(base, "k", "v")
    for i in range(4):
        ids = spark.range(990 + i, 1010 + 2 * i)
        more = KeyedTable.of(ids.select(F.col("id").alias("k"), F.lit(float(i)).alias("u")), "k", "u")
        gone = spark.range(995, 1000 + i).select(F.col("id").alias("k"))
        table = table.multiput(more, merge=lambda k, a, b: a * 2 + b).delete(gone).left_join(more, both)
        plain = plain.multiput(more, merge=lambda k, a, b: a * 2 + b).delete(gone).left_join(more, both)
    assert rows(table) == rows(plain)
    assert not any(scans_moved(table.df))
    kept = table.filter(lambda k, v: k % 2 == 0).map_values(lambda v: v + 1).map_entries(lambda k, v: v + k)
    assert rows(kept) == rows(plain.filter(lambda k, v: k % 2 == 0).map_values(lambda v: v + 1).map_entries(lambda k, v: v + k))
    assert kept.count().first()[0] == len(rows(kept))


def test_two_stored_tables_meet_without_any_exchange(spark, base, no_broadcast):
    ours, theirs = stored(base), stored(base.withColumn("v", F.col("v") + 1))
    plan = ours.inner_join(theirs, both).df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Bucketed: true") == 2


def test_repeated_keys_are_settled_when_stored(spark):
    pairs = spark.createDataFrame([(1, 2.0, 1), (1, 5.0, 0), (2, None, 3), (2, 7.0, 1), (None, 1.0, 0)], "k int, v double, o int")
    table = stored(pairs, order=["o"])
    assert rows(table) == sorted([(1, 2.0), (2, None), (None, 1.0)], key=str)
    assert rows(table.get(1)) == [(1, 2.0)] and rows(table.get(2)) == []
    assert rows(table.multiget(spark.createDataFrame([(1,), (1,), (2,), (9,), (None,)], "k int"))) == [(1, 2.0)]
    assert rows(stored(pairs.limit(0))) == []


def test_one_bucket_is_read_for_one_key(spark, base):
    table = stored(base, buckets=16)
    # The plan tells its buckets only where the scan keeps them apart; they are chosen either way.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        plan = table.get(5)._jdf.queryExecution().executedPlan().toString()
        few = table.multiget(spark.range(3).select(F.col("id").alias("k")))
        assert "SelectedBucketsCount: 1 out of 16" in plan
        chosen = few._jdf.queryExecution().executedPlan().toString().split("SelectedBucketsCount: ")[1]
        assert int(chosen.split(" ")[0]) <= 3
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert rows(few) == [(0, 0.0), (1, 1.5), (2, 3.0)]


def test_saving_a_changed_table(spark, base, other):
    table = stored(base).multiput(other)
    again = table.save(name())
    assert rows(again) == rows(table)
    assert not any(scans_moved(table.kept)) and again.buckets == 8
    assert rows(BucketedTable.open(spark, again.name)) == rows(table)
    assert rows(again.multiput(other).diff(again)) == []
    with pytest.raises(ValueError):
        again.save(again.name)


def test_diff_reads_only_buckets_that_differ(spark):
    df = spark.range(100_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    changed = df.withColumn("v", F.when(F.col("k") == 4711, -1).otherwise(F.col("v")))
    ours, theirs = stored(df, buckets=50), stored(changed, buckets=50)
    found = ours.diff(theirs)
    assert rows(found) == [(4711, 9422)]
    assert len(found.inputFiles()) == 2
    assert rows(ours.diff(stored(df, buckets=50))) == []
    assert rows(ours.diff(stored(changed, buckets=7))) == [(4711, 9422)]


def test_composite_keys(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("a"), (F.col("id") / 10).cast("int").alias("b"), F.col("id").alias("v"))
    table = stored(df, ["a", "b"])
    plain = KeyedTable.of(df, ["a", "b"], "v")
    some = KeyedTable.of(df.filter("v % 3 = 0").withColumn("b", F.col("b") + 5), ["a", "b"], "v")
    assert rows(table.multiput(some)) == rows(plain.multiput(some))
    assert rows(table.get(3, 2)) == [(3, 2, 23)]
    assert rows(table.multiget(some.df)) == rows(plain.multiget(some.df))


def test_a_repeated_key_is_an_error(spark):
    pairs = spark.createDataFrame([(1, 2.0), (1, 5.0), (2, 1.0)], "k int, v double")
    with pytest.raises(ValueError, match="stands 2 times"):
        KeyedTable.of(pairs, "k", "v")
    assert KeyedTable.of(pairs, "k", "v", trusted=True).count().first()[0] == 3


# -- folds of any step -------------------------------------------------------------------


def _halved(a, x):
    return a / 2 - x if a > 100 else abs(a - x) + 10


def _fold(values, z=lambda v: v):
    acc = z(values[0])
    for x in values[1:]:
        acc = _halved(acc, x)
    return acc


def _step(k, a, x):
    import numpy as np

    return np.where(a > 100, a / 2 - x, np.abs(a - x) + 10)


@pytest.mark.parametrize("batch", [3, 10_000])
def test_steps_equal_a_loop(spark, batch):
    import random

    rng = random.Random(batch)
    pairs = [(rng.choice([None, 1, 2, 3, 4, 5]), i, rng.choice([None, 1.0, 40.0, 250.0])) for i in range(300)]
    pairs += [(9, 0, 5.0), (10, 0, None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        fold = StepFold(["o"], _step, z=lambda k, v: v + 1)
        table = KeyedTable.fold(spark.createDataFrame(pairs, "k int, o int, v double").repartition(4), "k", "v", fold)
        found = {r.k: r.v for r in table.df.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    lists = {}
    for k, _, v in sorted(pairs, key=lambda p: p[1]):
        if v is not None:
            lists.setdefault(k, []).append(v)
    assert found == {k: _fold(v, lambda x: x + 1) for k, v in lists.items()}


@pytest.mark.parametrize("batch", [2, 10_000])
def test_steps_onto_a_table(spark, batch):
    base = spark.createDataFrame([(1, 100.0), (2, None), (3, 7.0), (4, 1.0)], "k int, v double")
    pairs = spark.createDataFrame(
        [(1, 3, 5.0), (1, 1, 90.0), (1, 2, None), (2, 1, 4.0), (3, 1, 250.0), (3, 2, 1.0), (3, 3, 2.0), (8, 1, 1.0), (8, 2, 2.0)],
        "k int, o int, u double",
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        updated = KeyedTable.of(base, "k", "v").update_join(pairs, "u", StepFold(["o"], _step))
        found = {r.k: r.v for r in updated.df.collect()}
        in_buckets = {r.k: r.v for r in stored(base).update_join(pairs, "u", StepFold(["o"], _step)).df.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == in_buckets == {1: _fold([100.0, 90.0, 5.0]), 2: None, 3: _fold([7.0, 250.0, 1.0, 2.0]), 4: 1.0}


def test_steps_of_texts_and_other_types(spark):
    import numpy as np

    pairs = spark.createDataFrame([(1, "x", i, c) for i, c in enumerate("abcd")] + [(1, "y", 0, "z")], "a int, b string, o int, v string")

    def longer(keys, acc, v):
        return np.array([f"({s}{x}{b})" for s, x, b in zip(acc, v, keys[1])], object)

    told = KeyedTable.fold(pairs, ["a", "b"], "v", StepFold(["o"], longer))
    assert rows(told) == [(1, "x", "(((abx)cx)dx)"), (1, "y", "z")]
    counts = StepFold(["o"], lambda k, acc, v: acc + 1, z=lambda k, v: np.ones(len(v), np.int64), returns="bigint")
    assert rows(KeyedTable.fold(pairs, ["a", "b"], "v", counts)) == [(1, "x", 4), (1, "y", 1)]
    assert KeyedTable.fold(pairs.limit(0), "a", "v", counts).df.collect() == []


def test_a_million_values_of_one_key(spark):
    pairs = spark.range(1_000_000).select(F.lit(1).alias("k"), "id", (F.col("id") % 300).cast("double").alias("v"))
    found = KeyedTable.fold(pairs, "k", "v", StepFold(["id"], _step)).df.first().v
    acc = 0.0
    for i in range(1, 1_000_000):
        acc = _halved(acc, float(i % 300))
    assert found == acc
