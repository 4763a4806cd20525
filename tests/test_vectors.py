import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vicinal.functions import vectors as vf


def rows(spark, *pairs):
    data = [(list(map(float, a)), list(map(float, b))) for a, b in pairs]
    return spark.createDataFrame(data, "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>")


def value(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_measures(spark):
    df = rows(spark, ([1, 2, 3], [4, 5, 6]), ([0, 0, 0], [1, 2, 2]), ([1, 0], [1, 0]), ([0], [0]))
    a, b = F.col("a"), F.col("b")
    assert value(df, vf.dot(a, b)) == [32.0, 0.0, 1.0, 0.0]
    assert value(df, vf.l2(a, b)) == pytest.approx([math.sqrt(27), 3.0, 0.0, 0.0])
    cos = value(df, vf.cosine(a, b))
    assert cos[0] == pytest.approx(32 / math.sqrt(14 * 77)) and cos[1:] == [None, 1.0, None]
    tan = value(df, vf.tanimoto(a, b))
    assert tan[0] == pytest.approx(32 / (14 + 77 - 32)) and tan[1:] == [0.0, 1.0, None]


def test_unequal_lengths_are_an_error(spark):
    df = rows(spark, ([1, 2], [1, 2, 3]))
    with pytest.raises(PySparkException, match="unequal length"):
        df.select(vf.l2(F.col("a"), F.col("b"))).collect()


def test_null_vector_gives_null(spark):
    df = spark.createDataFrame([(None, [1.0])], "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>")
    assert value(df, vf.l2(F.col("a"), F.col("b"))) == [None]


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("1   2.5   -3e2", [1.0, 2.5, -300.0]),
        ("   1      2   ", [1.0, 2.0]),
        ("1   abc", None),
        ("", None),
        ("      ", None),
        (None, None),
        ("1 2   3", None),
    ],
)
def test_parse_vector(spark, text, wanted):
    df = spark.createDataFrame([(text,)], "t STRING")
    assert value(df, vf.parse_vector(F.col("t"))) == [wanted]


def test_parse_line_rejects_bad_numbers(spark):
    df = spark.createDataFrame([("1   x",)], "t STRING")
    with pytest.raises(PySparkException):
        df.select(vf.parse_line(F.col("t"))).collect()


def test_dense_to_sparse(spark):
    df = rows(spark, ([0, 1.5, 0, -2], []), ([0, 0], []), ([], []))
    got = value(df, vf.dense_to_sparse(F.col("a")))
    assert [tuple(r) for r in got] == [(4, [1, 3], [1.5, -2.0]), (2, [], []), (0, [], [])]


@pytest.mark.parametrize("metric", [vf.L2, vf.COSINE, vf.TANIMOTO, vf.DOT], ids=lambda m: m.name)
@pytest.mark.parametrize("inclusive", [True, False])
def test_blocks_agree_with_expressions(spark, metric, inclusive):
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((40, 5)), rng.standard_normal((7, 5))
    q[0] = x[0]
    x[1] = 0
    pairs = [(x[i], q[j]) for i in range(40) for j in range(7)]
    exact = value(rows(spark, *pairs), metric.expr(F.col("a"), F.col("b")))
    radius = float(np.median([d for d in exact if d is not None]))
    i, j, d = metric.near(x, q, radius, inclusive)
    found = dict(zip((i * 7 + j).tolist(), d.tolist()))
    wanted = {n: d for n, d in enumerate(exact) if d is not None and metric.within(d, radius, inclusive)}
    # The median itself may fall on either side of an open bound by one rounding.
    on_edge = {n for n, d in enumerate(exact) if d is not None and abs(d - radius) < 1e-12}
    assert set(found) - on_edge == set(wanted) - on_edge
    assert all(found[n] == pytest.approx(wanted[n]) for n in set(found) & set(wanted))


def test_l2_screen_keeps_exact_duplicates_at_radius_zero():
    x = np.full((3, 64), 1e6) + np.arange(3)[:, None]
    i, j, d = vf.L2.near(x, x[1:2].copy(), 0.0, True)
    assert (i.tolist(), j.tolist(), d.tolist()) == ([1], [0], [0.0])
