"""Hard negatives by maximum inner product, pruned coordinate by coordinate.

All vectors lie sorted by length, and every run of them that a task reads is a bucket with one sorted
list of unit values for each coordinate.  An inner product that an anchor still asks for gives the least cosine
that a vector of the bucket must have, and a cosine gives the range in which its value on each coordinate
lies.  The ranges on the anchor's focus coordinates (its largest) are cut out of the sorted lists and
intersected; only what is left is multiplied out, in whole numbers.  Buckets whose longest
vector is too short are passed over.  The vectors stay where they are: anchors come to them in
blocks of limited size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinal.plans.sizing import cut_lineage, share, work_path
from vicinal.plans.skew import spread

_LONG = (-(2**63), 2**63 - 1)


@dataclass(frozen=True)
class Settings:
    """Best ``positives`` of an anchor, best ``negatives`` for each of them, whose score is ``low`` to ``high``
    percent of the positive's; ``focus`` coordinates are looked up in ``bucket`` vectors; ``block`` anchors
    meet the vectors at a time."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    focus: int = 3
    bucket: int = 4096
    block: int = 4096


SETTINGS = Settings()


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact; beyond the range of a BIGINT they end at its ends."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    peak = (np.abs(a).max(initial=0) + 1) * (np.abs(b).max(initial=0) + 1) * a.shape[1]
    if peak < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b).T, *_LONG).astype(np.int64)


def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at length one (zero rows stay), and their lengths."""
    length = np.linalg.norm(v, axis=1)
    return v / np.where(length > 0, length, 1)[:, None], length


class Bucket:
    """Vectors of one dimension with their sorted coordinate lists."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        self.ids, self.labels, self.v = ids, labels, v
        self.unit, length = _unit(v)
        self.longest, self.shortest = length.max(), length.min()
        self.order = np.argsort(self.unit, axis=0)
        self.lists = np.take_along_axis(self.unit, self.order, 0)

    def candidates(self, anchors: Anchors, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """``(anchors, members)`` that may reach the ``least`` products; members None are all of them."""
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = least / (anchors.length * np.where(least > 0, self.longest, self.shortest))
        # Where nothing is known (zero vectors, lengths out of range) all members are candidates.
        unknown = ~np.isfinite(cosine) | (cosine <= -1)
        live = unknown | (cosine <= 1 + 1e-9)
        if self.longest * anchors.length.max(initial=0) < np.inf:
            live &= (least <= 0) | (anchors.length * self.longest * (1 + 1e-9) >= least)
        angle = np.arccos(np.clip(np.where(unknown, -1, cosine), -1, 1))[:, None]
        low = np.cos(np.minimum(np.pi, anchors.angles + angle)) - 1e-9
        high = np.cos(np.maximum(0, anchors.angles - angle)) + 1e-9
        begin, end = np.zeros(low.shape, np.int64), np.zeros(low.shape, np.int64)
        for f in np.unique(anchors.focus):
            here = anchors.focus == f
            begin[here] = np.searchsorted(self.lists[:, f], low[here], "left")
            end[here] = np.searchsorted(self.lists[:, f], high[here], "right")
        if low.shape[1]:
            narrow = np.argmin(end - begin, axis=1)
            width = (end - begin)[np.arange(len(low)), narrow]
            whole = unknown | (width >= len(self.ids))
        else:
            whole = np.ones(len(low), bool)
        for i in np.flatnonzero(live & ~whole):
            k = narrow[i]
            found = self.order[begin[i, k] : end[i, k], anchors.focus[i, k]]
            for j, f in enumerate(anchors.focus[i]):
                if j != k and len(found):
                    value = self.unit[found, f]
                    found = found[(value >= low[i, j]) & (value <= high[i, j])]
            if len(found):
                yield np.array([i]), found
        all_of_them = np.flatnonzero(live & whole)
        for a in range(0, len(all_of_them), 256):
            yield all_of_them[a : a + 256], None


class Anchors:
    """A block of anchors of one dimension with their focus coordinates."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, focus: int):
        self.ids, self.labels, self.v = ids, labels, v
        unit, self.length = _unit(v)
        self.focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :focus]
        self.angles = np.arccos(np.clip(np.take_along_axis(unit, self.focus, 1), -1, 1))


def _arrays(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and vectors of runs of rows, apart by dimension."""
    for a in range(0, len(batch), size):
        part = batch.slice(a, size)
        ids, labels = (part.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
        lists = part.column("v")
        dimension = np.diff(lists.offsets.to_numpy())
        flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(dimension)]
        for d in np.unique(dimension):
            rows = np.flatnonzero(dimension == d)
            yield ids[rows], labels[rows], flat[at[rows][:, None] + np.arange(d)]


class _Best:
    """The best few of what an anchor was shown: higher scores first, ties by smaller id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> float:
        """What a score must reach to be taken."""
        return float(self.scores[-1]) if len(self.scores) == self.k else -np.inf

    def show(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.scores) == self.k:
            taken = scores >= self.scores[-1]
            scores, ids = scores[taken], ids[taken]
        if len(scores):
            scores, ids = np.r_[self.scores, scores], np.r_[self.ids, ids]
            best = np.lexsort((ids, ~scores))[: self.k]
            self.scores, self.ids = scores[best], ids[best]


def _meet(batches, size: int, blocks: dict[int, Anchors], least: Callable, show: Callable) -> None:
    """Show every anchor the scores of the candidates of all buckets."""
    for batch in batches:
        for ids, labels, v in _arrays(batch, size):
            anchors = blocks.get(v.shape[1])
            if anchors is None:
                continue
            bucket = Bucket(ids, labels, v)
            for rows, members in bucket.candidates(anchors, least(anchors)):
                at = slice(None) if members is None else members
                scores = products(anchors.v[rows], v[at])
                for i, s in zip(rows, scores):
                    show(anchors, int(i), s, ids[at], labels[at])


def _anchor_blocks(rows: list, focus: int) -> dict[int, Anchors]:
    found: dict[int, list] = {}
    for r in rows:
        found.setdefault(len(r[2]), []).append(r)
    return {
        d: Anchors(np.array([r[0] for r in some], np.int64), np.array([r[1] for r in some]), np.array([r[2] for r in some], float).reshape(len(some), d), focus)
        for d, some in found.items()
    }


def _positives(block: Broadcast, settings: Settings):
    """Best rows of an anchor's own label."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _anchor_blocks(block.value, settings.focus)
        best = {a: _Best(settings.positives) for anchors in blocks.values() for a in anchors.ids.tolist()}

        def least(anchors):
            return np.array([best[a].least for a in anchors.ids.tolist()])

        def show(anchors, i, scores, ids, labels):
            mine = (labels == anchors.labels[i]) & (ids != anchors.ids[i])
            best[int(anchors.ids[i])].show(scores[mine], ids[mine])

        _meet(batches, settings.bucket, blocks, least, show)
        told = [(a, p, s) for a, b in best.items() for p, s in zip(b.ids.tolist(), b.scores.tolist())]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(told, columns=["anchor_id", "positive_id", "positive_score"]).astype("int64"))

    return find


def _negatives(block: Broadcast, chosen: Broadcast, settings: Settings):
    """Best rows of other labels within the band of each positive's score."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A negative score has an empty band.
        best = {
            a: [(p, s, -(-settings.low * s // 100), settings.high * s // 100, _Best(settings.negatives)) for p, s in some if s >= 0]
            for a, some in chosen.value.items()
        }
        best = {a: some for a, some in best.items() if some}
        blocks = _anchor_blocks([r for r in block.value if r[0] in best], settings.focus)

        def least(anchors):
            return np.array([min(max(float(low), b.least) for _, _, low, _, b in best[a]) for a in anchors.ids.tolist()])

        def show(anchors, i, scores, ids, labels):
            other = labels != anchors.labels[i]
            scores, ids = scores[other], ids[other]
            for _, _, low, high, b in best[int(anchors.ids[i])]:
                inside = (scores >= low) & (scores <= high)
                b.show(scores[inside], ids[inside])

        _meet(batches, settings.bucket, blocks, least, show)
        told = [
            (a, p, n, s, t)
            for a, some in best.items()
            for p, s, _, _, b in some
            for n, t in zip(b.ids.tolist(), b.scores.tolist())
        ]
        names = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(told, columns=names).astype("int64"))

    return find


def _ranked(found: DataFrame, group: list[str], score: str, member: str, k: int) -> DataFrame:
    """The best ``k`` of each group, numbered; every task brings no more than so many."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), member))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def by_length(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, v`` written in order of falling length, one row an id.

    Rows without an id, label or vector, or with a component that is null or not finite, take no part.  Of the rows of
    one id that with the least label, then vector, does.  Equal lengths are parted by id.
    """
    sound = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    rows = vectors.select("vec_id", "label", "v").dropna().filter(sound)
    again = cut_lineage(rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("vec_id"))
    if not again.isEmpty():
        repeated = rows.join(again.hint("merge"), "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
        rows = rows.join(again.hint("merge"), "vec_id", "left_anti").unionByName(repeated.select("vec_id", "r.label", "r.v"))
    order = [F.desc("size"), F.asc("vec_id")]
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    sized = rows.withColumn("size", size)
    return cut_lineage(sized.repartitionByRange(*order).sortWithinPartitions(*order).drop("size"))


def mine(vectors: DataFrame, is_anchor: Column, settings: Settings = SETTINGS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` holds ``vec_id, label, v`` with whole numbers as components.  A score is the inner product with the
    anchor.  For the best rows of an anchor's own label (not itself) it gives the best rows of other labels whose score
    lies within the stated percentages of the positive's.  Ties go to the smaller id; a negative positive score has an
    empty band.  Vectors of another length than the anchor's are not compared with it.  Empty tables give no row.
    """
    spark = vectors.sparkSession
    table = by_length(vectors)
    anchors = cut_lineage(table.filter(is_anchor))
    blocks = -(-anchors.count() // settings.block)
    found = work_path(spark, "negatives")
    schema = "anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint"
    spark.createDataFrame([], schema).write.parquet(found)
    # An anchor is a stated query: a block of them meets all vectors, and one after the other do.
    for i in range(blocks):
        mine_here = F.pmod(spread(F.col("vec_id")), F.lit(blocks)) == i
        rows = [(r.vec_id, r.label, r.v) for r in anchors.filter(mine_here).collect()]
        block = share(spark, rows)
        near = table.mapInArrow(_positives(block, settings), "anchor_id bigint, positive_id bigint, positive_score bigint")
        chosen: dict[int, list] = {}
        for r in _ranked(near, ["anchor_id"], "positive_score", "positive_id", settings.positives).collect():
            chosen.setdefault(r.anchor_id, []).append((r.positive_id, r.positive_score))
        positives = share(spark, chosen)
        table.mapInArrow(_negatives(block, positives, settings), schema).write.mode("append").parquet(found)
        block.unpersist()
        positives.unpersist()
    ranked = _ranked(spark.read.schema(schema).parquet(found), ["anchor_id", "positive_id"], "negative_score", "negative_id", settings.negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: Labels of every so manieth vector are moved on by one, as a stated disturbance.
MOVED, LABELS, SCALE, EACH = 7, 10, 256, 100


def negatives_report(embeddings: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """``mine`` over a table ``vec_id, embedding, label``: components become ``floor(256 x)``, the labels of ids divisible
    by 7 are moved on by one, and anchors are the ids divisible by 100."""
    moved = F.when(F.col("vec_id") % MOVED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    # A component that is not finite must stay so, that its row takes no part: floor gives a BIGINT.
    whole = F.transform(
        "embedding",
        lambda x: F.when(F.abs(x.cast("double")) < 2.0**53, F.floor(x.cast("double") * SCALE).cast("double")).otherwise(
            x.cast("double") * SCALE
        ),
    )
    vectors = embeddings.select("vec_id", moved.alias("label"), whole.alias("v"))
    return mine(vectors, F.col("vec_id") % EACH == 0, settings)


#: The same over the whole table ``embeddings``, for DuckDB.
SQL = f"""
WITH rows AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % {MOVED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % {EACH} = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {SETTINGS.positives})
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND {SETTINGS.low} * positive_score <= 100 * score AND 100 * score <= {SETTINGS.high} * positive_score
QUALIFY rank <= {SETTINGS.negatives}
"""
