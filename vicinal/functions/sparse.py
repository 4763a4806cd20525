"""Sparse vectors ``STRUCT<size, indices, vals>`` in measures and hashes.

A dense hash plane of a large dimension would be held in full for each function.  Here its entries
are numbers that follow from the seed, the function and the dimension alone, so that only those a batch of
vectors touches are ever worked out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A prime below 2**31, so that products of two residues fit a BIGINT.
PRIME = 2147483647
#: Multipliers of the counter that entries are drawn from; part of the family.
FUNCTION_FACTOR, DIMENSION_FACTOR, FIRST_FACTOR, SECOND_FACTOR = 1103515245, 69069 * 16807, 1664525, 22695477


def plane_entries(seed: int, functions: np.ndarray, dimensions: np.ndarray) -> np.ndarray:
    """Gaussian numbers by function (rows) and dimension (columns)."""
    f, d = np.asarray(functions, np.int64)[:, None], np.asarray(dimensions, np.int64)[None, :]
    h = ((f + 1) % PRIME * FUNCTION_FACTOR % PRIME + (d + 1) % PRIME * DIMENSION_FACTOR % PRIME + seed) % PRIME
    h = (h * h % PRIME * FIRST_FACTOR + h) % PRIME
    first = (h * h % PRIME * SECOND_FACTOR + h) % PRIME
    second = (first * first % PRIME * FIRST_FACTOR + first) % PRIME
    # Two uniform numbers make a Gaussian one (the public Box-Muller transform).
    u, v = (first + 0.5) / PRIME, (second + 0.5) / PRIME
    return np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)


def _parts(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, index and value of every stored number, and the sizes; unequal lists are an error."""
    if vectors.null_count:
        raise ValueError("sparse vectors must not be NULL")
    size, indices, vals = (pc.struct_field(vectors, n) for n in ("size", "indices", "vals"))
    n = pc.list_value_length(indices)
    if not n.equals(pc.list_value_length(vals)):
        raise ValueError("indices and values of unequal length")
    row = np.repeat(np.arange(len(vectors)), n.to_numpy(zero_copy_only=False))
    index, value = indices.flatten().to_numpy(zero_copy_only=False), vals.flatten().to_numpy(zero_copy_only=False)
    size = size.to_numpy(zero_copy_only=False)
    if len(index) and not (np.isfinite(value).all() and (index >= 0).all() and (index < size[row]).all()):
        raise ValueError("sparse vectors must hold finite numbers at indices below their size")
    return row, index.astype(np.int64), value, size


@F.arrow_udf(T.DoubleType())
def _dot(a: pa.Array, b: pa.Array) -> pa.Array:
    (row, i, x, n), (other, j, y, m) = _parts(a), _parts(b)
    if not np.array_equal(n, m):
        raise ValueError("sparse vectors of unequal size")
    width = int(n.max()) + 1 if len(n) else 1
    left, right = row * width + i, other * width + j
    by = np.argsort(right, kind="stable")
    at = np.searchsorted(right[by], left)
    met = at < len(right)
    met[met] = right[by][at[met]] == left[met]
    return pa.array(np.bincount(row[met], x[met] * y[by][at[met]], len(n)).astype(float))


def sparse_dot(a: Column, b: Column) -> Column:
    """Inner product over the indices that both hold; vectors of unequal size are an error."""
    return _dot(a, b)


def _square(a: Column) -> Column:
    return F.aggregate(a["vals"], F.lit(0.0), lambda s, x: s + x * x)


def sparse_l2(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    # Rounding may leave a tiny negative number for equal vectors.
    return F.sqrt(F.greatest(F.lit(0.0), _square(a) + _square(b) - 2 * sparse_dot(a, b)))


def sparse_cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL when a vector is zero."""
    return F.try_divide(sparse_dot(a, b), F.sqrt(_square(a) * _square(b)))


def sparse_tanimoto(a: Column, b: Column) -> Column:
    """Tanimoto similarity; NULL for two zero vectors."""
    met = sparse_dot(a, b)
    return F.try_divide(met, _square(a) + _square(b) - met)


def _projections(vectors: pa.Array, seed: int, count: int) -> np.ndarray:
    row, index, value, size = _parts(vectors)
    found = np.zeros((len(size), count))
    # A part of the stored numbers at a time: as many plane entries are held as that part has indices.
    for s in range(0, len(index), 1 << 16):
        here = slice(s, s + (1 << 16))
        used, column = np.unique(index[here], return_inverse=True)
        planes = plane_entries(seed, np.arange(count), used)
        for f in range(count):
            found[:, f] += np.bincount(row[here], value[here] * planes[f, column], len(size))
    return found


def sign_signature(v: Column, seed: int, count: int) -> Column:
    """``ARRAY<BIGINT>``: 1 where a sparse vector lies strictly on the positive side of a plane, else 0."""

    @F.arrow_udf("array<bigint>")
    def bins(vectors: pa.Array) -> pa.Array:
        return _lists((_projections(vectors, seed, count) > 0).astype(np.int64))

    return bins(v)


def pstable_signature(v: Column, seed: int, count: int, bin_length: float) -> Column:
    """``ARRAY<BIGINT>`` of p-stable bins; offsets are drawn like plane entries, uniformly."""
    rng = np.random.default_rng([seed, 1])
    offsets = rng.random(count) * bin_length

    @F.arrow_udf("array<bigint>")
    def bins(vectors: pa.Array) -> pa.Array:
        return _lists(np.floor((_projections(vectors, seed, count) + offsets) / bin_length).astype(np.int64))

    return bins(v)


def _lists(found: np.ndarray) -> pa.Array:
    ends = np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))


def entry_sql(seed: int, f: str, d: str) -> str:
    """A plane entry as DuckDB SQL of the numbers of function and dimension."""
    h = f"((({f}) + 1)::BIGINT % {PRIME} * {FUNCTION_FACTOR} % {PRIME} + (({d}) + 1)::BIGINT % {PRIME} * {DIMENSION_FACTOR} % {PRIME} + {seed}) % {PRIME}"
    step = lambda x, factor: f"list_transform([{x}], lambda h: (h * h % {PRIME} * {factor} + h) % {PRIME})[1]"
    first = step(step(h, FIRST_FACTOR), SECOND_FACTOR)
    pair = f"list_transform([{first}], lambda a: [a, (a * a % {PRIME} * {FIRST_FACTOR} + a) % {PRIME}])[1]"
    return f"list_transform([{pair}], lambda p: sqrt(-2 * ln((p[1] + 0.5) / {PRIME})) * cos(2 * pi() * (p[2] + 0.5) / {PRIME}))[1]"
