"""Find documents that hold benchmark items, also with other numbers, names and units.

Texts become sequences of canonical tokens: lower-case words, and typed placeholders
for numbers, names and units.  Windows of such tokens are joined by hash to those of the
benchmark.  Aligned windows must then fill the placeholders consistently: one value of the item
always becomes one value of the document.  Windows without a changed value count in any case.

Whether a capital makes a name cannot be told for sure, so that a text is read in several ways: with names,
with capitalised words at the head of a sentence as names too, and with names as plain words.  Windows of too few
literal words are compared word for word, with their numbers and names as they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.frames import small_side
from vicinal.llm.tokens import ALNUM, Words, byte_class, chunks, grams, hash_series, lowered, split_words
from vicinal.plans.sizing import cut_lineage

#: Canonical tokens of a window.  An item with fewer is one window of its own length, ...
WINDOW = 8
#: ... unless it has fewer than this many tokens, which ordinary text would hold by chance.
SHORTEST = 5
#: Literal words of a window at least; one of placeholders mostly is found only as it stands.
LITERALS = 4
#: Item windows that make a leak: this many (13 tokens in a row), or half of the item's.
LEAK = 6
#: Slots of the filter that a task tests windows with ahead of the join: a bitmap of 512 KiB at most.
SLOTS = 1 << 22

# Words taken for units after a number.
UNITS = (
    "cm m km mm inch inches foot feet yard yards mile miles g kg mg gram grams pound pounds ton tons "
    "s second seconds minute minutes hour hours day days week weeks month months year years percent "
    "dollar dollars euro euros cent cents liter liters litre litres ml degrees"
).split()

_ENDERS = byte_class(b".!?:;\n\r\"()[]")
_NUMBER, _NAME, _UNIT, _AS_IT_STANDS = hash_series(41, 4)


def _hash_of(words: list[str]) -> np.ndarray:
    texts = pa.array(words)
    return np.concatenate([split_words(d, at, ALNUM).hashes() for _, d, at in chunks(texts)])


_UNIT_HASHES = np.sort(_hash_of(UNITS))


def _starts_with_digit(words: Words) -> np.ndarray:
    first = words.data[words.begin]
    return (first >= 48) & (first <= 57)


def _glued(words: Words, member: np.ndarray, between: bytes) -> tuple[Words, np.ndarray]:
    """``words`` with neighbouring members, parted by one byte of ``between``, as one; and the first
    word of each that is left."""
    glue = np.zeros(len(words.begin), bool)
    if len(glue) > 1:
        gap = words.end[:-1]
        glue[1:] = member[1:] & member[:-1] & (words.begin[1:] == gap + 1) & (words.owner[1:] == words.owner[:-1])
        glue[1:] &= byte_class(between)[words.data[np.minimum(gap, len(words.data) - 1)]]
    first = np.flatnonzero(~glue)
    last = np.append(first[1:], len(glue)) - 1
    kept = np.concatenate([[0], np.cumsum(~glue)])
    return Words(words.data, words.text_at, words.begin[first], words.end[last] if len(first) else words.end, kept[words.word_at]), first


def numbers_joined(words: Words) -> Words:
    """``words`` in which a number such as 1,200 or 2.5 is one word."""
    return _glued(words, _starts_with_digit(words), b",.")[0] if len(words.begin) else words


def canonical(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word, which words are numbers or units, which are names, and which may be one.

    A number begins with a digit.  A name begins with a capital and goes on without one; at the head of
    a sentence such a word only may be one.  A unit is a unit word after a number.
    """
    data, begin, end = words.data, words.begin, words.end
    hashed = words.hashes(lowered(data))
    if not len(begin):
        none = np.zeros(0, bool)
        return hashed, none, none, none
    first = data[begin]
    second = np.where(end - begin > 1, data[np.minimum(begin + 1, len(data) - 1)], 0)
    third = np.where(end - begin > 2, data[np.minimum(begin + 2, len(data) - 1)], 0)
    wide = first == 0xC3
    capital = ((first >= 65) & (first <= 90)) | (wide & (second >= 0x80) & (second <= 0x9E))
    after = np.where(wide, third, second)
    head = np.zeros(len(begin), bool)
    head[words.word_at[:-1][np.diff(words.word_at) > 0]] = True
    enders = np.concatenate([[0], np.cumsum(_ENDERS[data])])
    head[1:] |= enders[begin[1:]] > enders[end[:-1]]
    number = _starts_with_digit(words)
    unit = np.zeros(len(begin), bool)
    unit[1:] = number[:-1] & (words.owner[1:] == words.owner[:-1])
    at = np.searchsorted(_UNIT_HASHES, hashed[unit])
    unit[unit] = _UNIT_HASHES[np.minimum(at, len(_UNIT_HASHES) - 1)] == hashed[unit]
    named = capital & ~((after >= 65) & (after <= 90)) & ~unit
    return np.select([number, unit], [_NUMBER, _UNIT], hashed), number | unit, named & ~head, named & head


class Reading:
    """A text's tokens with some words as names; ``at`` is the word at which each token begins."""

    def __init__(self, words: Words, hashed: np.ndarray, hole: np.ndarray, name: np.ndarray):
        self.words, self.at = _glued(words, name, b" ")
        self.name, self.hole = name[self.at], (hole | name)[self.at]
        self.value = np.where(self.name, _NAME, hashed[self.at])
        self.left = self.words.left
        self.holes_before = np.concatenate([[0], np.cumsum(self.hole)])

    def windows(self, k: int, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First token of each window of ``k``, its hash, and whether it has enough literals."""
        gram, whole = grams(self.value, self.left, k)
        if own and k < WINDOW:
            whole = whole & (np.diff(self.words.word_at)[self.words.owner] == k)
        start = np.flatnonzero(whole)
        literal = k - (self.holes_before[start + k] - self.holes_before[start])
        return start, gram[start], literal >= min(LITERALS, k - 1)

    def slots(self, start: int, k: int) -> list[str]:
        data, begin, end = self.words.data, self.words.begin, self.words.end
        return [
            data[begin[i] : end[i]].tobytes().decode(errors="replace").lower() for i in range(start, start + k) if self.hole[i]
        ]


def template_windows(words: Words, lengths: list[int], own: bool = False):
    """``(length, places, hashes, slots)`` of all windows (``own``: shorter ones than ``WINDOW`` only where
    they are all of a text); ``slots(i)`` are the values of the placeholders of the
    ``i``-th one.  A place is the word at which a window begins.

    With names, all windows of enough literals; with words at heads as names too, those that have one;
    with names as plain words, those that have one; and those of too few literals as they stand.
    """
    raw = words.hashes(lowered(words.data))
    hashed, hole, name, maybe = canonical(words)
    nothing = np.zeros(len(hashed), bool)
    named, both, plain = (Reading(words, hashed, hole, x) for x in (name, name | maybe, nothing))
    stands = Reading(words, raw ^ _AS_IT_STANDS, nothing, nothing)
    names = [np.concatenate([[0], np.cumsum(x)]) for x in (name, maybe)]
    for k in lengths:
        sparse = np.zeros(len(hashed), bool)
        for reading, wanted in ((named, None), (both, names[1]), (plain, names[0])):
            start, gram, enough = reading.windows(k, own)
            if reading is not plain:
                sparse[reading.at[start[~enough]]] = True
            if wanted is not None:
                begin, end = reading.at[start], np.append(reading.at, len(hashed))[start + k]
                enough &= wanted[end] > wanted[begin]
            start = start[enough]
            yield k, reading.at[start], gram[enough].view(np.int64), lambda i, r=reading, s=start, k=k: r.slots(int(s[i]), k)
        # Also where the plain words of a window, whatever is joined in it, are too few.
        whole = np.flatnonzero(stands.left >= k)
        for x in (hole | name, hole | name | maybe):
            before = np.concatenate([[0], np.cumsum(x)])
            sparse[whole[k - (before[whole + k] - before[whole]) < min(LITERALS, k - 1)]] = True
        start, gram, _ = stands.windows(k, own)
        here = sparse[start]
        yield k, start[here], gram[here].view(np.int64), lambda i: []


def _windows(columns: list[str], lengths: list[int] | None, bitmap: np.ndarray | None):
    """Rows of windows: of every text, or of those windows only that the bitmap lets pass.

    Without given lengths a text that is shorter than a window gives one of its own length.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, at in chunks(batch.column("text")):
                words = numbers_joined(split_words(data, at, ALNUM))
                owner = words.owner
                tried = lengths or list(range(SHORTEST, WINDOW + 1))
                rows, places, values, slots, widths = [], [], [], [], []
                for k, start, value, slot in template_windows(words, tried, lengths is None):
                    here = np.arange(len(start)) if bitmap is None else np.flatnonzero(bitmap[value & (SLOTS - 1)])
                    if not len(here):
                        continue
                    start = start[here]
                    rows.append(first + owner[start])
                    places.append(start - words.word_at[owner[start]])
                    values.append(value[here])
                    widths.append(np.full(len(start), k))
                    slots += [slot(i) for i in here.tolist()]
                if not rows:
                    continue
                owners = pa.array(np.concatenate(rows))
                yield pa.record_batch(
                    [
                        *(batch.column(c).take(owners) for c in columns),
                        pa.array(np.concatenate(places), pa.int32()),
                        pa.array(np.concatenate(widths), pa.int32()),
                        pa.array(np.concatenate(values), pa.int64()),
                        pa.array(slots, pa.list_(pa.string())),
                    ],
                    names=[*columns, "at", "width", "h", "slots"],
                )

    return find


_WINDOW_COLUMNS = "at int, width int, h bigint, slots array<string>"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, x, item_id, n_windows, n_matched, n_changed`` of every document and leaked item.

    ``x`` is a hash of the document's text, which tells rows of one ``doc_id`` (or of null
    ones) apart.  ``n_windows`` are the item's windows, ``n_matched`` those found in consistent
    alignments or unchanged in any, ``n_changed`` the placeholders with another value.  Null or empty texts and items
    match nothing; equal rows count as one; items of one id are parts of one item.  Items with
    fewer than ``SHORTEST`` tokens cannot be told from ordinary text
    and are not searched (``too_short`` gives them).
    """
    items = cut_lineage(
        benchmark.select("item_id", "text")
        .mapInArrow(_windows(["item_id"], None, None), f"item_id bigint, {_WINDOW_COLUMNS}")
        .distinct()
    )
    lengths = sorted(r.width for r in items.select("width").distinct().collect())
    keyed = docs.select("doc_id", F.xxhash64("text").alias("x"), "text")
    # A fixed number of slots bounds what comes here, whatever the benchmark's size.
    taken = items.select(F.pmod("h", F.lit(SLOTS)).cast("int").alias("slot")).distinct().toArrow()
    bitmap = np.zeros(SLOTS, bool)
    bitmap[taken.column(0).to_numpy()] = True
    packed = np.packbits(bitmap)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _windows(["doc_id", "x"], lengths, np.unpackbits(packed).astype(bool))(batches)

    schema = f"doc_id bigint, x bigint, {_WINDOW_COLUMNS}"
    if lengths:
        found = keyed.mapInArrow(find, schema)
    else:
        found = docs.sparkSession.createDataFrame([], schema)
    sought = items.select("item_id", F.col("at").alias("item_at"), "h", F.col("slots").alias("item_slots"))
    met = found.join(small_side(sought), "h").select(
        "doc_id", "x", "item_id", "item_at", (F.col("at") - F.col("item_at")).alias("shift"),
        F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b")).alias("pairs"),
    )
    same = F.forall("pairs", lambda p: p["a"] == p["b"])
    # All windows of one alignment: bounded by the item's windows.
    aligned = met.groupBy("doc_id", "x", "item_id", "shift").agg(
        F.collect_set("item_at").alias("places"),
        F.collect_set(F.when(same, F.col("item_at"))).alias("unchanged"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
    )
    pairs = F.col("pairs")
    consistent = F.size(F.array_distinct(F.transform(pairs, lambda p: p["a"]))) == F.size(pairs)
    places = F.when(consistent, F.col("places")).otherwise(F.col("unchanged"))
    changed = F.when(consistent, F.size(F.filter(pairs, lambda p: p["a"] != p["b"]))).otherwise(0)
    by_item = (
        aligned.select("doc_id", "x", "item_id", F.explode(places).alias("item_at"), changed.alias("changed"))
        .groupBy("doc_id", "x", "item_id")
        .agg(F.countDistinct("item_at").alias("n_matched"), F.max("changed").cast("bigint").alias("n_changed"))
    )
    sizes = items.groupBy("item_id").agg(F.countDistinct("at").alias("n_windows"))
    enough = F.col("n_matched") >= F.least(F.lit(LEAK), F.ceil(F.col("n_windows") / 2))
    return (
        by_item.join(small_side(sizes), "item_id")
        .filter(enough)
        .select("doc_id", "x", "item_id", "n_windows", "n_matched", "n_changed")
    )


def too_short(benchmark: DataFrame) -> DataFrame:
    """The items that ``leaks`` cannot search."""
    sought = benchmark.select("item_id", "text").mapInArrow(_windows(["item_id"], None, None), f"item_id bigint, {_WINDOW_COLUMNS}")
    return benchmark.join(sought.select("item_id").distinct(), "item_id", "left_anti")


def leak_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_windows, n_matched, n_changed`` of every leak."""
    return leaks(docs, benchmark).drop("x")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (``doc_id, text`` and any others) without a leak."""
    bad = cut_lineage(leaks(docs, benchmark).select(F.col("doc_id").alias("bad_id"), F.col("x").alias("bad_x")).distinct())
    rows = docs.select(F.struct("*").alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64("row.text") == F.col("bad_x"))
    return rows.join(small_side(bad), same, "left_anti").select("row.*")
