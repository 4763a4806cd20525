import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vicinal.functions import hashing
from vicinal.functions.hashing import HashFamily, num_groups


def frame(spark, x):
    return spark.createDataFrame(
        [(i, [float(c) for c in row]) for i, row in enumerate(x)], "vec_id BIGINT, v ARRAY<DOUBLE>"
    )


def signatures(df, family):
    return {r[0]: r[1] for r in df.select("vec_id", family.signature(F.col("v"))).collect()}


def test_group_count_rule():
    for tables in range(1, 2000):
        m = num_groups(tables)
        assert m == math.floor((1 + math.sqrt(8 * (tables + 1))) / 2)
        assert m * (m - 1) // 2 <= tables
    assert [num_groups(n) for n in (1, 3, 10, 200)] == [2, 3, 5, 20]


def test_bad_parameters():
    for k, tables, width in [(1, 10, 1.0), (5, 10, 1.0), (4, 0, 1.0), (4, 10, 0.0)]:
        with pytest.raises(ValueError):
            HashFamily.draw(k, tables, 8, width, 1)
    with pytest.raises(ValueError, match="unknown"):
        HashFamily.draw(4, 10, 8, 1.0, 1, kind="other")


def test_seed_reproduces_the_family():
    a, b, c = (HashFamily.draw(4, 10, 8, 2.0, s) for s in (5, 5, 6))
    assert (a.a == b.a).all() and (a.b == b.b).all() and not (a.a == c.a).all()
    assert ((a.b >= 0) & (a.b < 2.0)).all()


def test_groups_and_tables():
    family = HashFamily.draw(4, 10, 8, 1.0, 1)
    assert family.groups == [[0, 5], [1, 6], [2, 7], [3, 8], [4, 9]]
    assert family.tables == list(combinations(range(5), 2))


@pytest.mark.parametrize("kind", ["pstable", "sign"])
def test_signature_is_floor_or_sign_of_projection(spark, kind):
    family = HashFamily.draw(4, 10, 6, 0.7, 9, kind)
    x = np.vstack([np.random.default_rng(1).standard_normal((50, 6)) * 3, np.zeros((1, 6))])
    df = frame(spark, x)
    got = signatures(df, family)
    projected = x @ family.a.T
    wanted = np.floor((projected + family.b) / 0.7) if kind == "pstable" else projected > 0
    assert [got[i] for i in range(len(x))] == wanted.astype(int).tolist()
    expr = {r[0]: r[1] for r in df.select("vec_id", family.signature_expr(F.col("v"))).collect()}
    assert expr == got


def test_exact_bin_edges(spark):
    family = HashFamily(2, 1, 1, 0.5, np.array([[1.0], [2.0]]), np.array([0.0, 0.25]))
    got = signatures(frame(spark, [[0.5], [0.499], [-0.5], [-0.001], [0.0]]), family)
    assert [got[i] for i in range(5)] == [[1, 2], [0, 2], [-1, -2], [-1, 0], [0, 0]]


def test_sign_of_zero_is_zero(spark):
    family = HashFamily(2, 1, 2, 1.0, np.array([[1.0, 0.0], [0.0, -1.0]]), None)
    assert signatures(frame(spark, [[0.0, 5.0], [2.0, -1.0]]), family) == {0: [0, 0], 1: [1, 1]}


@pytest.mark.parametrize("row", [[1.0], [1.0, float("nan")], [1.0, float("inf")]])
def test_bad_vectors_are_errors(spark, row):
    family = HashFamily.draw(2, 1, 2, 1.0, 1)
    with pytest.raises(PySparkException, match="vectors"):
        frame(spark, [row]).select(family.signature(F.col("v"))).collect()


def test_null_vector_is_an_error(spark):
    family = HashFamily.draw(2, 1, 2, 1.0, 1)
    df = spark.createDataFrame([(None,)], "v ARRAY<DOUBLE>")
    with pytest.raises(PySparkException, match="must not be NULL"):
        df.select(family.signature(F.col("v"))).collect()


def test_keys_groups_and_compact_keys(spark):
    family = HashFamily.draw(4, 10, 3, 0.5, 2)
    x = np.random.default_rng(4).standard_normal((20, 3)) * 100
    df = frame(spark, x).select("vec_id", family.signature(F.col("v")).alias("sig"))
    multipliers = hashing.key_multipliers(4, 3)
    assert multipliers == hashing.key_multipliers(4, 3)
    keyed = family.expand_tables(df).select(
        "*",
        family.group_bins(F.col("sig")).alias("groups"),
        hashing.compact_key(F.col("bins"), multipliers).alias("key"),
        hashing.bucket_partition(hashing.compact_key(F.col("bins"), multipliers), 7).alias("part"),
    )
    found = keyed.collect()
    assert len(found) == 20 * 10
    for r in found:
        i, j = family.tables[r["table_id"]]
        groups = [[r["sig"][f] for f in g] for g in family.groups]
        assert r["groups"] == groups and r["bins"] == groups[i] + groups[j]
        key = sum(b * m for b, m in zip(r["bins"], multipliers)) % hashing.KEY_HASH_MODULUS
        assert r["key"] == key and r["part"] == key % 7


def test_compact_key_of_huge_bins_does_not_overflow(spark):
    bins = [2**62, -(2**62), 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(bins,)], "bins ARRAY<BIGINT>")
    multipliers = [hashing.KEY_HASH_MULTIPLIER_BOUND - 1] * 4
    (got,) = df.select(hashing.compact_key(F.col("bins"), multipliers)).first()
    assert got == sum(b * m for b, m in zip(bins, multipliers)) % hashing.KEY_HASH_MODULUS


def test_string_key_hash(spark):
    def by_hand(s):
        h = 0
        for c in s:
            h = (h * 31 + ord(c)) & 0x7FFFFFFF
        return h

    words = ["", "a", "Customer#000000001", "žluť", "x" * 500]
    df = spark.createDataFrame([(w,) for w in words], "w STRING")
    got = [r[0] for r in df.select(hashing.string_key_hash(F.col("w"))).collect()]
    assert got == [by_hand(w) for w in words]
