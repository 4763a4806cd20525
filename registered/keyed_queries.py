"""Registered queries: keyed tables."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from registered.common import LEHMER, Registry, read, rounded
from vicinal.operators.bucketed import BucketedTable
from vicinal.operators.folds import AggregateFold, OrderedFold
from vicinal.operators.keyed import KeyedTable, collect_lists
from vicinal.operators.steps import StepFold

R = Registry()
# A third never ends in decimals, so no result sits on the edge between two roundings.
DECAY, STEP = 0.9, 1 / 3
LINE_ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"]


def orders(spark, sf_dir):
    return KeyedTable.of(read(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice", trusted=True)


def customers(spark, sf_dir):
    return KeyedTable.of(read(spark, sf_dir, "customer"), "c_custkey", "c_acctbal", trusted=True)


def shown(table: KeyedTable, value: str = "value", digits: int = 4):
    """Key and value columns under fixed names, prices rounded."""
    return table.df.select(*table.keys, rounded(table.value, digits).alias(value))


# -- maps, filters, look-ups -------------------------------------------------------------


@R.add(
    "keyed_filter",
    "SELECT o_orderkey, round(o_totalprice, 4) AS value FROM orders WHERE o_totalprice > o_orderkey * 10",
)
def keyed_filter(spark, sf_dir):
    return shown(orders(spark, sf_dir).filter(lambda k, v: v > k * 10))


@R.add("map_values", "SELECT o_orderkey, round(o_totalprice * 2 + 1, 4) AS value FROM orders")
def map_values(spark, sf_dir):
    return shown(orders(spark, sf_dir).map_values(lambda v: v * 2 + 1))


@R.add("map_values_with_key", "SELECT o_orderkey, round(o_totalprice + o_orderkey, 4) AS value FROM orders")
def map_entries(spark, sf_dir):
    return shown(orders(spark, sf_dir).map_entries(lambda k, v: v + k))


@R.add("keyed_count", "SELECT count(*) AS count FROM orders")
def count(spark, sf_dir):
    return orders(spark, sf_dir).count()


@R.add("keyed_get", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey = 7")
def get(spark, sf_dir):
    return customers(spark, sf_dir).get(7)


_RETURNED = "SELECT l_orderkey AS o_orderkey FROM lineitem WHERE l_returnflag = 'R'"


def _returned(spark, sf_dir):
    """Order keys with returned lines, repeated, and as many absent keys."""
    lines = read(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R")
    key = F.col("l_orderkey")
    return lines.select(key.alias("o_orderkey")).union(lines.select(-1 - key))


@R.add(
    "keyed_multiget",
    f"SELECT o_orderkey, round(o_totalprice, 4) AS value FROM orders WHERE o_orderkey IN ({_RETURNED})",
)
def multiget(spark, sf_dir):
    table = orders(spark, sf_dir)
    found = table.multiget(_returned(spark, sf_dir))
    return found.select("o_orderkey", rounded(table.value, 4).alias("value"))


@R.add(
    "keyed_delete",
    f"SELECT o_orderkey, round(o_totalprice, 4) AS value FROM orders WHERE o_orderkey NOT IN ({_RETURNED})",
)
def delete(spark, sf_dir):
    return shown(orders(spark, sf_dir).delete(_returned(spark, sf_dir)))


# -- construction and folds ----------------------------------------------------------------


@R.add(
    "keyed_last_wins",
    f"""SELECT l_orderkey, round(l_extendedprice, 4) AS value FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey
      ORDER BY {", ".join(c + " DESC" for c in LINE_ORDER)}, l_extendedprice DESC) = 1""",
)
def last_wins(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    return shown(KeyedTable.from_pairs(lines, "l_orderkey", "l_extendedprice", LINE_ORDER))


@R.add(
    "keyed_last_wins_composite",
    """SELECT conv_id, turn, text FROM conversations
    QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY role DESC, text DESC) = 1""",
)
def last_wins_composite(spark, sf_dir):
    talk = read(spark, sf_dir, "conversations")
    return KeyedTable.from_pairs(talk, ["conv_id", "turn"], "text", ["role"]).df


@R.add(
    "keyed_create",
    """SELECT o_custkey AS c_custkey, round(o_totalprice, 4) AS value FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey
      ORDER BY o_orderdate DESC, o_orderkey DESC, o_totalprice DESC) = 1""",
)
def create(spark, sf_dir):
    pairs = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    made = customers(spark, sf_dir).create_using(pairs, "o_totalprice", ["o_orderdate", "o_orderkey"])
    return shown(made)


@R.add(
    "keyed_aggregate",
    "SELECT user_id AS c_custkey, round(sum(value), 4) AS value FROM events GROUP BY user_id",
)
def aggregate(spark, sf_dir):
    pairs = read(spark, sf_dir, "events").withColumnRenamed("user_id", "c_custkey")
    return shown(customers(spark, sf_dir).aggregate_using(pairs, "value", F.sum))


@R.add(
    "keyed_collect_list",
    """SELECT l_orderkey, CAST(0 AS BIGINT) AS segment,
      string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS members
    FROM lineitem GROUP BY l_orderkey""",
)
def collect_list(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    lists = collect_lists(lines, "l_orderkey", "l_partkey")
    members = F.array_join(F.col("members").cast("array<string>"), ",")
    return lists.select("l_orderkey", "segment", members.alias("members"))


LIST_ROWS = 3


@R.add(
    "keyed_collect_list_split",
    f"""WITH sized AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
    dealt AS (SELECT l_orderkey, l_partkey, CASE WHEN n > {LIST_ROWS}
      THEN ({LEHMER.format("l_suppkey")}) % CAST(ceil(n / {LIST_ROWS}) AS BIGINT) ELSE 0 END AS segment FROM sized)
    SELECT l_orderkey, CAST(segment AS BIGINT) AS segment,
      string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS members
    FROM dealt GROUP BY l_orderkey, segment""",
)
def collect_list_split(spark, sf_dir):
    """Lists so short that most keys are dealt over several, by a given column."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    lists = collect_lists(lines, "l_orderkey", "l_partkey", LIST_ROWS, F.col("l_suppkey"))
    members = F.array_join(F.col("members").cast("array<string>"), ",")
    return lists.select("l_orderkey", "segment", members.alias("members"))


@R.add(
    "keyed_fold_builtin",
    "SELECT l_orderkey, round(max(l_extendedprice), 4) AS value FROM lineitem GROUP BY l_orderkey",
)
def fold_builtin(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    return shown(KeyedTable.fold(lines, "l_orderkey", "l_extendedprice", AggregateFold(F.max)))


def decayed(order, decay):
    """Ordered fold ``acc * decay + value``, kept associative as (scale, offset)."""
    return OrderedFold(
        order=order,
        lift=lambda v: F.struct(F.lit(decay).alias("scale"), v.alias("offset")),
        merge=lambda a, x: F.struct(
            (a["scale"] * x["scale"]).alias("scale"),
            (a["offset"] * x["scale"] + x["offset"]).alias("offset"),
        ),
    )


@R.add(
    "keyed_fold",
    f"""WITH placed AS (SELECT user_id, value,
      count(*) OVER (PARTITION BY user_id) - row_number() OVER (PARTITION BY user_id ORDER BY ts) AS after FROM events)
    SELECT user_id, round(sum(value * pow({DECAY}::DOUBLE, after)), 4) AS value FROM placed GROUP BY user_id""",
)
def fold(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", "ts", "value")
    folded = KeyedTable.fold(events, "user_id", "value", decayed(["ts"], DECAY))
    return shown(folded.map_values(lambda acc: acc["offset"]))


# -- updates ---------------------------------------------------------------------------------


@R.add(
    "keyed_put",
    """SELECT c_custkey, CASE WHEN c_custkey = 5 THEN 999.5 ELSE c_acctbal END AS c_acctbal FROM customer
    UNION ALL SELECT -1, 12.25""",
)
def put(spark, sf_dir):
    return customers(spark, sf_dir).put([5], 999.5).put([-1], 12.25).df


_UPDATES = """upd AS (
  SELECT o_orderkey AS k, o_totalprice * 1.1::DOUBLE AS u FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT -1 - o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P')"""


def _updates(spark, sf_dir):
    """New prices for finished orders, and new keys for pending ones."""
    o = read(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    known = o.filter(F.col("o_orderstatus") == "F").select("o_orderkey", (price * 1.1).alias("u"))
    fresh = o.filter(F.col("o_orderstatus") == "P").select(-1 - F.col("o_orderkey"), price)
    # Old keys are not negative and new ones are.
    return KeyedTable.of(known.union(fresh), "o_orderkey", "u", trusted=True)


def _upsert_sql(z, f):
    return f"""WITH {_UPDATES} SELECT coalesce(o_orderkey, k) AS o_orderkey, round(CASE
      WHEN k IS NULL THEN o_totalprice WHEN o_totalprice IS NULL THEN {z} ELSE {f} END, 4) AS value
    FROM orders FULL JOIN upd ON o_orderkey = k"""


@R.add("keyed_upsert", _upsert_sql("u", "u"))
def upsert(spark, sf_dir):
    return shown(orders(spark, sf_dir).multiput(_updates(spark, sf_dir)))


@R.add("keyed_upsert_merge", _upsert_sql("u", "o_totalprice + u + k"))
def upsert_merge(spark, sf_dir):
    table = orders(spark, sf_dir)
    return shown(table.multiput(_updates(spark, sf_dir), merge=lambda k, old, new: old + new + k))


@R.add("keyed_upsert_fold", _upsert_sql("u * 10 + k", "o_totalprice - u / 2"))
def upsert_fold(spark, sf_dir):
    table = orders(spark, sf_dir)
    return shown(
        table.multiput(
            _updates(spark, sf_dir),
            merge=lambda k, old, new: old - new / 2,
            z=lambda k, new: new * 10 + k,
        )
    )


@R.add(
    "keyed_upsert_repeated_keys",
    f"""WITH ranked AS (SELECT l_orderkey AS k, l_extendedprice AS u, row_number() OVER (PARTITION BY l_orderkey
      ORDER BY {", ".join(f"{c} DESC" for c in LINE_ORDER)}, l_extendedprice DESC) AS i FROM lineitem)
    SELECT o_orderkey, round(CASE WHEN k IS NULL THEN o_totalprice ELSE o_totalprice - u END, 4) AS value
    FROM orders LEFT JOIN (SELECT * FROM ranked WHERE i = 1) ON o_orderkey = k""",
)
def upsert_repeated(spark, sf_dir):
    """Updates whose keys repeat: the last line of an order counts."""
    lines = read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    last = KeyedTable.from_pairs(lines, "o_orderkey", "l_extendedprice", LINE_ORDER)
    return shown(orders(spark, sf_dir).multiput(last, merge=lambda k, old, new: old - new))


CHAIN = 5


@R.add(
    "keyed_upsert_chain",
    f"""SELECT o_orderkey, round(o_totalprice + {" + ".join(
        f"CASE WHEN o_custkey % {CHAIN} = {i} THEN o_orderkey + {i} ELSE 0 END" for i in range(CHAIN))}, 4) AS value
    FROM orders UNION ALL SELECT -1 - i, i::DOUBLE FROM range({CHAIN}) AS t(i)""",
)
def upsert_chain(spark, sf_dir):
    """Upserts one after the other, each with a new key."""
    table, o = orders(spark, sf_dir), read(spark, sf_dir, "orders")
    for i in range(CHAIN):
        known = o.filter(F.col("o_custkey") % CHAIN == i).select("o_orderkey", (F.col("o_orderkey") + i).cast("double").alias("u"))
        fresh = spark.range(1).select(F.lit(-1 - i).cast("bigint"), F.lit(float(i)))
        updates = KeyedTable.of(known.union(fresh), "o_orderkey", "u", trusted=True)
        table = table.multiput(updates, merge=lambda k, old, new: old + new)
    return shown(table)


@R.add(
    "keyed_fold_with_key",
    """SELECT l_orderkey, CAST(sum(l_linenumber * 2 + l_orderkey % 7) AS BIGINT) AS value FROM lineitem GROUP BY l_orderkey""",
)
def fold_with_key(spark, sf_dir):
    """A fold whose first step sees the key."""
    lines = read(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("bigint"))
    fold = OrderedFold(LINE_ORDER, merge=lambda a, b: a + b, lift=lambda k, u: u * 2 + k % 7)
    table = KeyedTable.fold(lines.withColumn("u", F.col("l_linenumber")), "l_orderkey", "u", fold)
    return table.df.select("l_orderkey", F.col("u").alias("value"))


# -- joins -----------------------------------------------------------------------------------


def _spending(spark, sf_dir):
    pairs = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return KeyedTable.fold(pairs, "c_custkey", "o_totalprice", AggregateFold(F.sum))


_SPENDING = "spent AS (SELECT o_custkey AS k, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey)"


@R.add(
    "keyed_full_outer_join",
    f"""WITH {_SPENDING}, shifted AS (SELECT k + 100 AS k, s FROM spent)
    SELECT coalesce(c_custkey, k) AS c_custkey, round(coalesce(c_acctbal, -1) + coalesce(s, -2), 4) AS value
    FROM customer FULL JOIN shifted ON c_custkey = k""",
)
def full_outer(spark, sf_dir):
    spent = _spending(spark, sf_dir).df.withColumn("c_custkey", F.col("c_custkey") + 100)
    other = KeyedTable.of(spent, "c_custkey", "o_totalprice", trusted=True)
    joined = customers(spark, sf_dir).full_outer_join(
        other, lambda k, a, b: F.coalesce(a, F.lit(-1)) + F.coalesce(b, F.lit(-2))
    )
    return shown(joined)


@R.add(
    "keyed_left_join",
    """SELECT doc_id, n_chars * 10 + coalesce(quality, -1) AS value
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def left_join(spark, sf_dir):
    documents = KeyedTable.of(read(spark, sf_dir, "documents"), "doc_id", "n_chars")
    labels = KeyedTable.of(read(spark, sf_dir, "labels"), "doc_id", "quality")
    joined = documents.left_join(labels, lambda k, a, b: a * 10 + F.coalesce(b, F.lit(-1)))
    return joined.df.select("doc_id", F.col(joined.value).alias("value"))


@R.add(
    "keyed_inner_join",
    f"""WITH {_SPENDING} SELECT c_custkey, round(c_acctbal + s / 100 + c_custkey, 4) AS value
    FROM customer JOIN spent ON c_custkey = k""",
)
def inner_join(spark, sf_dir):
    joined = customers(spark, sf_dir).inner_join(
        _spending(spark, sf_dir), lambda k, a, b: a + b / 100 + k
    )
    return shown(joined)


@R.add(
    "keyed_update_join",
    """WITH s AS (SELECT l_orderkey AS k, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey, round(o_totalprice + coalesce(q, 0), 4) AS value FROM orders LEFT JOIN s ON o_orderkey = k""",
)
def update_join(spark, sf_dir):
    pairs = read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    updated = orders(spark, sf_dir).update_join(
        pairs, "l_quantity", AggregateFold(F.sum), lambda k, old, new: old + new
    )
    return shown(updated)


@R.add(
    "keyed_update_join_ordered",
    f"""WITH placed AS (SELECT l_orderkey AS k, l_extendedprice AS u, count(*) OVER (PARTITION BY l_orderkey) AS n,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}, l_extendedprice) AS i FROM lineitem),
    s AS (SELECT k, max(n) AS n, sum(u * pow({STEP}::DOUBLE, n - i)) AS q FROM placed GROUP BY k)
    SELECT o_orderkey, round(CASE WHEN k IS NULL THEN o_totalprice
      ELSE o_totalprice * pow({STEP}::DOUBLE, n) + q END, 4) AS value
    FROM orders LEFT JOIN s ON o_orderkey = k""",
)
def update_join_ordered(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), *LINE_ORDER, "l_extendedprice"
    )
    updated = orders(spark, sf_dir).update_join(
        lines,
        "l_extendedprice",
        decayed(LINE_ORDER, STEP),
        lambda k, old, new: old * new["scale"] + new["offset"],
    )
    return shown(updated)


_OURS = "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END"
_THEIRS = """CASE WHEN o_orderpriority = '1-URGENT' THEN NULL
  WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END"""


@R.add(
    "keyed_diff",
    f"""WITH both_sides AS (SELECT o_orderkey, {_OURS} AS a, {_THEIRS} AS b FROM orders WHERE o_orderstatus <> 'P')
    SELECT o_orderkey, round(a, 4) AS value FROM both_sides WHERE b IS NOT NULL AND a IS DISTINCT FROM b""",
)
def diff(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    price, priority = F.col("o_totalprice"), F.col("o_orderpriority")
    ours = o.select("o_orderkey", F.when(priority != "5-LOW", price).alias("v"))
    changed = F.when(F.col("o_orderstatus") == "F", price + 1).otherwise(price)
    theirs = o.filter(F.col("o_orderstatus") != "P").select(
        "o_orderkey", F.when(priority != "1-URGENT", changed).alias("v")
    )
    table = KeyedTable.of(ours, "o_orderkey", "v", trusted=True)
    return shown(table.diff(KeyedTable.of(theirs, "o_orderkey", "v", trusted=True)))


# -- tables in buckets -----------------------------------------------------------------------


def in_buckets(df, key, value, order=()):
    """``df`` as a stored table of its own."""
    return BucketedTable.store(df, key, value, f"keyed_{uuid.uuid4().hex}", order, buckets=8)


@R.add(
    "keyed_join_bucketed",
    f"""WITH {_SPENDING},
    last AS (SELECT o_custkey AS k, max_by(o_totalprice, struct_pack(a := o_orderdate, b := o_orderkey)) AS p
      FROM orders GROUP BY o_custkey),
    joined AS (SELECT l.k, l.p + coalesce(c.c_acctbal, 0) AS v FROM last l LEFT JOIN customer c ON c.c_custkey = l.k),
    outer_joined AS (SELECT coalesce(j.k, s.k) AS k, coalesce(j.v, -1) + coalesce(s.s, -2) / 100 AS v
      FROM joined j FULL JOIN (SELECT k + 100 AS k, s FROM spent) s ON j.k = s.k)
    SELECT k AS o_custkey, round(v, 4) AS value FROM outer_joined""",
)
def join_bucketed(spark, sf_dir):
    """Last prices, in buckets: a left join and an outer one, the table staying where it is."""
    table = in_buckets(read(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", ["o_orderdate", "o_orderkey"])
    spent = _spending(spark, sf_dir)
    shifted = KeyedTable(spent.df.withColumn("c_custkey", F.col("c_custkey") + 100), spent.keys, spent.value)
    joined = table.left_join(customers(spark, sf_dir), lambda k, a, b: a + F.coalesce(b, F.lit(0.0)))
    joined = joined.full_outer_join(shifted, lambda k, a, b: F.coalesce(a, F.lit(-1.0)) + F.coalesce(b, F.lit(-2.0)) / 100)
    return shown(joined)


def _puts(lo, hi):
    return " + ".join(f"CASE WHEN o.o_custkey % {CHAIN} >= {i} THEN o.o_orderkey % 100 + {i} ELSE 0 END" for i in range(lo, hi))


@R.add(
    "keyed_upsert_bucketed",
    f"""SELECT o.o_orderkey, round(CASE WHEN o.o_custkey % 11 = 3 THEN 0 ELSE {_puts(0, 2)}
        + CASE WHEN o.o_orderkey % 3 <> 0 THEN o.o_totalprice ELSE 0 END END + {_puts(2, CHAIN)}, 4) AS value
    FROM orders o WHERE o.o_custkey % 11 <> 3 OR o.o_custkey % {CHAIN} >= 2""",
)
def upsert_bucketed(spark, sf_dir):
    """A third of all keys is not stored: upserts change old keys and add new ones, step by step, with a delete
    between two of them.  A key deleted and put again starts anew."""
    o = read(spark, sf_dir, "orders")
    table = in_buckets(o.filter(F.col("o_orderkey") % 3 != 0), "o_orderkey", "o_totalprice")
    for i in range(CHAIN):
        some = o.filter(F.col("o_custkey") % CHAIN >= i)
        added = some.select("o_orderkey", (F.col("o_orderkey") % 100 + i).cast("double").alias("u"))
        table = table.multiput(KeyedTable.of(added, "o_orderkey", "u", trusted=True), merge=lambda k, old, new: old + new)
        if i == 1:
            table = table.delete(o.filter(F.col("o_custkey") % 11 == 3).select("o_orderkey"))
    return shown(table)


@R.add(
    "keyed_diff_stored",
    """SELECT o_orderkey, round(o_totalprice, 4) AS value FROM orders
    WHERE o_orderkey IN (SELECT min(o_orderkey) FROM orders GROUP BY o_orderstatus)""",
)
def diff_stored(spark, sf_dir):
    """Two stored tables that differ in few keys: only the buckets of these are read."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    changed = o.groupBy("o_orderstatus").agg(F.min("o_orderkey").alias("o_orderkey")).select("o_orderkey", F.lit(1.0).alias("by"))
    table = BucketedTable.store(o, "o_orderkey", "o_totalprice", f"keyed_{uuid.uuid4().hex}", buckets=64)
    added = table.left_join(KeyedTable.of(changed, "o_orderkey", "by", trusted=True), lambda k, a, b: a + F.coalesce(b, F.lit(0.0)))
    other = added.save(f"keyed_{uuid.uuid4().hex}")
    return table.diff(other).select("o_orderkey", rounded("o_totalprice", 4).alias("value"))


# -- folds of any step -------------------------------------------------------------------------


@R.add(
    "keyed_fold_stepwise",
    """SELECT user_id, round(list_reduce(list(value::DOUBLE ORDER BY ts, event_id, value),
      lambda a, x: CASE WHEN a > 100 THEN a / 3 - x ELSE abs(a - x) + 10 END), 4) AS value
    FROM events WHERE value IS NOT NULL GROUP BY user_id""",
)
def fold_stepwise(spark, sf_dir):
    """A step that depends on the accumulator's size, so that runs cannot be folded apart."""
    fold = StepFold(["ts", "event_id"], f=lambda k, a, x: np.where(a > 100, a / 3 - x, np.abs(a - x) + 10))
    events = read(spark, sf_dir, "events").withColumn("value", F.col("value").cast("double"))
    return shown(KeyedTable.fold(events, "user_id", "value", fold))


@R.add(
    "keyed_update_join_stepwise",
    f"""WITH s AS (SELECT l_orderkey AS k, list(l_extendedprice ORDER BY {", ".join(LINE_ORDER)}, l_extendedprice) AS us
      FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey, round(CASE WHEN us IS NULL THEN o_totalprice
      ELSE list_reduce(list_prepend(o_totalprice, us), lambda a, u: CASE WHEN u > a THEN a / 3 ELSE a - u / 2 END) END, 4) AS value
    FROM orders LEFT JOIN s ON o_orderkey = k""",
)
def update_join_stepwise(spark, sf_dir):
    """Lines are applied to their order one after the other."""
    lines = read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    fold = StepFold(LINE_ORDER, f=lambda k, a, u: np.where(u > a, a / 3, a - u / 2))
    return shown(orders(spark, sf_dir).update_join(lines, "l_extendedprice", fold))
