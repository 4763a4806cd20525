"""Vector expressions and metrics.

Vectors are ``ARRAY<DOUBLE>``.  Everything on columns is a built-in expression; a
``Metric`` also carries the same formula for a block of vectors against a block of
queries, which the exact scan evaluates on Arrow batches inside the tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: numbers of a text vector are separated by exactly three spaces.
SEPARATOR = " {3}"

#: Numbers held at once while survivors of a screen are measured.
MEASURED_NUMBERS = 1 << 22


def as_vector(c: Column | str) -> Column:
    """Any numeric array as ``ARRAY<DOUBLE>``."""
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def parse_line(text: Column) -> Column:
    """Strict parse of a stored line: a token that is no number is an error."""
    return F.transform(F.split(text, SEPARATOR), lambda x: F.trim(x).cast("double"))


def parse_vector(text: Column) -> Column:
    """Lenient parse of a query message: blank tokens dropped, NULL if malformed."""
    tokens = F.filter(F.split(text, SEPARATOR), lambda x: F.trim(x) != "")
    numbers = F.transform(tokens, lambda x: F.trim(x).try_cast("double"))
    return F.when((F.size(numbers) > 0) & F.forall(numbers, lambda x: x.isNotNull()), numbers)


def dense_to_sparse(v: Column) -> Column:
    """``STRUCT<size, indices, vals>`` holding the non-zero components."""
    hits = F.filter(
        F.transform(v, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"] != 0
    )
    return F.struct(
        F.size(v).alias("size"),
        F.transform(hits, lambda s: s["i"]).alias("indices"),
        F.transform(hits, lambda s: s["x"]).alias("vals"),
    )


def _pairwise(a: Column, b: Column, term: Callable[[Column, Column], Column]) -> Column:
    total = F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, x: s + x)
    unequal = F.raise_error(
        F.concat(F.lit("vectors of unequal length: "), F.size(a), F.lit(" and "), F.size(b))
    )
    return F.when(F.size(a) != F.size(b), unequal.cast("double")).otherwise(total)


def dot(a: Column, b: Column) -> Column:
    """Inner product; vectors of unequal length are an error."""
    return _pairwise(a, b, lambda x, y: x * y)


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(_pairwise(a, b, lambda x, y: (x - y) * (x - y)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL when a vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def tanimoto(a: Column, b: Column) -> Column:
    """Tanimoto similarity, the real-valued Jaccard coefficient; NULL for two zero vectors."""
    return F.try_divide(dot(a, b), dot(a, a) + dot(b, b) - dot(a, b))


def _l2_block(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    # Differences, not the |x|^2 + |q|^2 - 2xq expansion: no cancellation for close pairs.
    return np.sqrt(np.stack([np.einsum("nd,nd->n", x - row, x - row) for row in q], axis=1))


def _l2_rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    gap = x - y
    return np.sqrt(np.einsum("nd,nd->n", gap, gap))


def _l2_near(x: np.ndarray, q: np.ndarray, radius: float, inclusive: bool):
    # One matrix product screens all pairs with a margin far above its rounding error;
    # the survivors are measured again from differences, so the result is exact.  Only a
    # pair shown to be far is dropped: one whose squares overflow (NaN) is measured.
    with np.errstate(over="ignore", invalid="ignore"):
        squares = (x * x).sum(1)[:, None] + (q * q).sum(1)[None, :]
        far = squares - 2.0 * (x @ q.T) > radius * radius + 1e-9 * (squares + 1.0)
    i, j = np.nonzero(~far)
    distance = np.empty(len(i))
    step = max(1, MEASURED_NUMBERS // x.shape[1])
    for s in range(0, len(i), step):
        distance[s : s + step] = _l2_rows(x[i[s : s + step]], q[j[s : s + step]])
    keep = distance <= radius if inclusive else distance < radius
    return i[keep], j[keep], distance[keep]


def _dot_rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("nd,nd->n", x, y)


def _ratio(above: np.ndarray, below: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(below == 0, np.nan, above / below)


def _cosine_block(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return _ratio(x @ q.T, np.sqrt(np.outer(_dot_rows(x, x), _dot_rows(q, q))))


def _cosine_rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _ratio(_dot_rows(x, y), np.sqrt(_dot_rows(x, x) * _dot_rows(y, y)))


def _unit(x: np.ndarray) -> np.ndarray:
    # Vectors whose squares come near the bounds of the numbers become NaN: their pairs are all measured.
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        squares = _dot_rows(x, x)
        safe = (squares > 1e-140) & (squares < 1e140)
        return x / np.where(safe, np.sqrt(squares), np.where(squares == 0, 1, np.nan))[:, None]


def _cosine_near(x: np.ndarray, q: np.ndarray, radius: float, inclusive: bool):
    # As for L2: one product screens all pairs with a margin, the survivors are measured pair by pair.
    i, j = np.nonzero(~(_unit(x) @ _unit(q).T < radius - 1e-9))
    measure = np.empty(len(i))
    step = max(1, MEASURED_NUMBERS // x.shape[1])
    with np.errstate(over="ignore"):
        for s in range(0, len(i), step):
            measure[s : s + step] = _cosine_rows(x[i[s : s + step]], q[j[s : s + step]])
    keep = measure >= radius if inclusive else measure > radius
    return i[keep], j[keep], measure[keep]


def _tanimoto_block(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    xq = x @ q.T
    return _ratio(xq, _dot_rows(x, x)[:, None] + _dot_rows(q, q)[None, :] - xq)


def _tanimoto_rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    xy = _dot_rows(x, y)
    return _ratio(xy, _dot_rows(x, x) + _dot_rows(y, y) - xy)


@dataclass(frozen=True)
class Metric:
    """A named measure with its ordering, so that "near" never means the wrong end.

    ``expr`` is the formula on columns, ``rows`` on two blocks row by row, ``block`` on
    every row of one block against every row of another; undefined values are NaN.
    """

    name: str
    expr: Callable[[Column, Column], Column]
    rows: Callable[[np.ndarray, np.ndarray], np.ndarray]
    block: Callable[[np.ndarray, np.ndarray], np.ndarray]
    smaller_is_nearer: bool = True
    screen: Callable | None = None

    def within(self, measure, radius: float, inclusive: bool):
        """Predicate "at least as near as ``radius``" on a Column or a numpy array."""
        if self.smaller_is_nearer:
            return measure <= radius if inclusive else measure < radius
        return measure >= radius if inclusive else measure > radius

    def near(self, x: np.ndarray, q: np.ndarray, radius: float, inclusive: bool):
        """Row numbers and measure of the pairs of two blocks that lie within ``radius``."""
        if self.screen is not None:
            return self.screen(x, q, radius, inclusive)
        measure = self.block(x, q)
        i, j = np.nonzero(self.within(measure, radius, inclusive))
        return i, j, measure[i, j]

    def nearest_first(self, measure: Column) -> Column:
        return measure.asc_nulls_last() if self.smaller_is_nearer else measure.desc_nulls_last()


L2 = Metric("l2", l2, _l2_rows, _l2_block, screen=_l2_near)
COSINE = Metric("cosine", cosine, _cosine_rows, _cosine_block, smaller_is_nearer=False, screen=_cosine_near)
TANIMOTO = Metric("tanimoto", tanimoto, _tanimoto_rows, _tanimoto_block, smaller_is_nearer=False)
DOT = Metric("dot", dot, _dot_rows, lambda x, q: x @ q.T, smaller_is_nearer=False)
