"""Pack tokenised documents into as few full sequences as possible: minimum bin slack.

What a sequence can hold depends on lengths alone, and there are no more different lengths than
tokens in a sequence.  So the documents are counted by length, and the search runs on that table: the
longest length left opens a sequence, a subset-sum over the others (one bit a sum) finds the fullest
combination, and it is taken as often as all its lengths last.  Every piece then finds its place
from its length and its number among the pieces of that length, without meeting the others.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinal.llm.frames import small_side
from vicinal.plans.sizing import cut_lineage, share


@dataclass(frozen=True)
class Settings:
    """``capacity`` tokens a sequence at most; ``end`` is the id after each document."""

    capacity: int = 2048
    end: int = 0
    #: Bytes of ids in one Arrow batch.
    batch_bytes: int = 4_000_000


SETTINGS = Settings()

# -- tokens ------------------------------------------------------------------------------

_ENCODERS: dict = {}


def encoder(ranks: bytes, pattern: str):
    """The byte-pair encoder of a vocabulary file (a line a token: base64 and rank), one a worker."""
    import tiktoken

    key = (hash(ranks), pattern)
    if key not in _ENCODERS:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[key]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document of ``n`` ids; the first may be shorter."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((a, capacity) for a in range(first, n, capacity))]


def pieces(docs: DataFrame, ranks: bytes, pattern: str, settings: Settings = SETTINGS) -> DataFrame:
    """``doc_id, piece, start, length, ids, task, nth`` of all documents.

    ``ids`` are little-endian unsigned 32-bit numbers; ``nth`` numbers the pieces of one length within a ``task``.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]
        + [("ids", pa.binary()), ("task", pa.int64()), ("nth", pa.int64())]
    )
    vocabulary = share(docs.sparkSession, ranks)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary.value, pattern).encode_to_numpy, np.array([settings.end], "<u4")
        task, seen, rows, held = TaskContext.get().partitionId(), Counter(), [], 0

        def told() -> pa.RecordBatch:
            return pa.record_batch([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                ids = np.concatenate([encode(text, disallowed_special=()).astype("<u4"), end])
                for i, (start, length) in enumerate(cuts(len(ids), settings.capacity)):
                    raw = ids[start : start + length].tobytes()
                    rows.append((doc_id, i, start, length, raw, task, seen[length]))
                    seen[length] += 1
                    held += len(raw)
                if held > settings.batch_bytes:
                    yield told()
                    rows, held = [], 0
        if rows:
            yield told()

    return docs.select("doc_id", "text").mapInArrow(
        cut, "doc_id bigint, piece int, start bigint, length bigint, ids binary, task bigint, nth bigint"
    )


# -- minimum bin slack -------------------------------------------------------------------


def fullest(left: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length together come nearest to ``room`` without exceeding it.

    The sums that can be reached are the bits of one number.  A length that is left often enters
    in portions of 1, 2, 4, …, and longer lengths are preferred among equally full combinations.
    """
    sums, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in left if x <= room and left[x]), reverse=True):
        copies, portion = min(left[length], room // length), 1
        while copies:
            portion = min(portion, copies)
            steps.append((length, portion, sums))
            sums |= sums << (length * portion) & mask
            copies -= portion
            portion *= 2
        if sums >> room & 1:
            break
    total, chosen = sums.bit_length() - 1, Counter()
    for length, portion, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] += portion
            total -= length * portion
    return chosen


def bin_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """``(times, [(length, copies), …])``: which combinations fill how many sequences each.

    Every sequence opens with the longest length left, so that no long piece remains for the end.
    """
    left = {length: n for length, n in counts.items() if n}
    plan = []
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = fullest(left, capacity - longest)
        left[longest] += 1
        chosen[longest] += 1
        times = min(left[length] // n for length, n in chosen.items())
        plan.append((times, sorted(chosen.items(), reverse=True)))
        for length, n in chosen.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
    return plan


def places(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length the combinations that use it: number of the first piece, copies a sequence, first
    sequence, and offset of the first copy."""
    seen, found, sequence = Counter(), {}, 0
    for times, chosen in plan:
        offset = 0
        for length, n in chosen:
            found.setdefault(length, []).append((seen[length], n, sequence, offset))
            seen[length] += n * times
            offset += n * length
        sequence += times
    return {length: np.array(rows, np.int64) for length, rows in found.items()}


def _placed(table):
    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        length, number = length.to_numpy(), number.to_numpy()
        found = np.zeros((len(length), 2), np.int64)
        order = np.argsort(length, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
            if len(rows):
                one = table.value[int(length[rows[0]])]
                first, copies, sequence, offset = one[np.searchsorted(one[:, 0], number[rows], "right") - 1].T
                turn, copy = np.divmod(number[rows] - first, copies)
                found[rows, 0] = sequence + turn
                found[rows, 1] = offset + copy * length[rows]
        return pd.DataFrame(found, columns=["sequence_id", "offset"])

    return place


def pack(docs: DataFrame, ranks: bytes, pattern: str, settings: Settings = SETTINGS) -> DataFrame:
    """``doc_id, piece, start, length, ids, sequence_id, offset`` of all documents (``doc_id, text``).

    A null or empty text is its end id alone.  Documents longer than a sequence are cut; all others
    stay whole.  Equal rows and rows without an id are packed each on its own; an empty table gives no piece.  Strings
    that look like special tokens are ordinary text.
    """
    spark = docs.sparkSession
    staged = cut_lineage(pieces(docs, ranks, pattern, settings))
    counted = cut_lineage(staged.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    begin = cut_lineage(counted.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin")))
    # One row a length: as many as a sequence has tokens, whatever the number of documents is.
    lengths = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    place = _placed(share(spark, places(bin_plan(lengths, settings.capacity))))
    numbered = staged.join(small_side(begin), ["length", "task"]).withColumn("number", F.col("begin") + F.col("nth"))
    return numbered.withColumn("at", place("length", "number")).select(
        "doc_id", "piece", "start", "length", "ids", "at.sequence_id", "at.offset"
    )


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids, doc_ids, lengths``: the packed sequences themselves, pieces in order.

    A sequence has no more pieces than tokens, so that none of its lists grows with the data.
    """
    part = F.struct("offset", "doc_id", "length", "ids")
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    ids = F.aggregate("parts.ids", F.lit(b""), lambda a, x: F.concat(a, x))
    total = F.aggregate("parts.length", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select(
        "sequence_id",
        total.alias("n_tokens"),
        ids.alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"),
        F.col("parts.length").alias("lengths"),
    )


def pack_report(docs: DataFrame, ranks: bytes, pattern: str, settings: Settings = SETTINGS) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of all pieces."""
    packed = pack(docs, ranks, pattern, settings)
    return packed.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )
