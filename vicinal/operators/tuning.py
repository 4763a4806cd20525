"""Settings of an index worked out from a model of its collisions.

Two vectors at distance ``c`` share a p-stable bin of length ``w`` with a chance that has a closed form, and
two at an angle share a sign with 1 - angle / pi.  All functions of a group agree with its power, and a pair is a
candidate when two groups of ``m`` do.  With the distances of a sample of pairs this gives the share of all pairs
that become candidates; the settings that make it least, at the recall asked for, are chosen.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.functions.hashing import matrix
from vicinal.operators.index import IndexParams

_ERF = np.vectorize(math.erf, otypes=[float])


def pstable_collision(distance: np.ndarray, bin_length: float) -> np.ndarray:
    """Chance that one p-stable function puts two vectors at a distance into one bin."""
    distance = np.asarray(distance, float)
    t = bin_length / np.maximum(distance, 1e-12 * bin_length)
    below = (1 + _ERF(-t / math.sqrt(2))) / 2
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * t) * (1 - np.exp(-t * t / 2))


def sign_collision(angle: np.ndarray) -> np.ndarray:
    """Chance that one hyperplane leaves two vectors at an angle on one side."""
    return 1 - np.asarray(angle, float) / math.pi


def candidate_chance(collision: np.ndarray, num_functions: int, groups: int) -> np.ndarray:
    """Chance that at least two of the groups agree, given that of one function."""
    g = np.asarray(collision, float) ** (num_functions // 2)
    return 1 - (1 - g) ** groups - groups * g * (1 - g) ** (groups - 1)


@dataclass(frozen=True)
class Tuned:
    """Settings, and what the model expects of them: the ``recall`` of a pair at the stated distance, and the share of
    all pairs that become candidates (``load``)."""

    params: IndexParams
    recall: float
    load: float


def sampled_pairs(vectors: DataFrame, dimension: int, kind: str = "pstable", sample: int = 1000) -> np.ndarray:
    """Distances (angles for ``sign``) of all pairs of a sample of vectors, those with the lowest hash of their id."""
    drawn = vectors.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(sample).select("v").toArrow()
    x = matrix(drawn.column("v").combine_chunks(), dimension)
    if kind == "sign":
        unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
        found = np.arccos(np.clip(unit @ unit.T, -1, 1))
    else:
        square = (x * x).sum(1)
        found = np.sqrt(np.maximum(0, square[:, None] + square[None, :] - 2 * x @ x.T))
    return found[np.triu_indices(len(x), 1)]


def tune(
    pairs: np.ndarray,
    distance: float,
    dimension: int,
    recall: float = 0.95,
    kind: str = "pstable",
    max_tables: int = 28,
    functions: Sequence[int] = (2, 4, 6, 8, 10, 12, 16, 20, 24),
    seed: int = 0,
) -> Tuned:
    """The settings of least load that find a pair at ``distance`` (an angle for ``sign``) with the ``recall``.

    ``pairs`` are distances as ``sampled_pairs`` gives them.  A table costs storage, so that one more is
    taken only if it lowers the load by a tenth.
    """
    spread = np.quantile(pairs, (np.arange(400) + 0.5) / 400)
    best: Tuned | None = None
    for m in range(3, (1 + math.isqrt(1 + 8 * max_tables)) // 2 + 1):
        for k in functions:
            widths = [1.0] if kind == "sign" else distance * np.geomspace(1, 64, 49)
            for w in widths:
                near = sign_collision(distance) if kind == "sign" else pstable_collision(distance, w)
                found = float(candidate_chance(near, k, m))
                if found < recall:
                    continue
                far = sign_collision(spread) if kind == "sign" else pstable_collision(spread, w)
                load = float(candidate_chance(far, k, m).mean())
                fewer_tables = best is not None and best.params.num_tables < m * (m - 1) // 2
                if best is None or load < best.load * (0.9 if fewer_tables else 1):
                    best = Tuned(IndexParams(dimension, k, m * (m - 1) // 2, float(w), seed, kind), found, load)
                if kind != "sign":
                    break  # a longer bin only raises the load
    if best is None:
        raise ValueError(f"no settings of at most {max_tables} tables reach a recall of {recall}")
    return best
