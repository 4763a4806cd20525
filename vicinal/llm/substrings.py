"""Remove long word sequences that occur earlier in the corpus.

Suffix automata decide.  An automaton of the whole corpus does not fit any executor, so that
it is cut into reference shards that need not know of each other:

* Every window of ``WINDOW`` words has one anchor, the lowest hash of the ``GRAM``-word
  sequences in it.  It depends on the window's words alone, so that equal windows
  have equal anchors wherever they stand.  A run of windows with one anchor is a piece.
* Only anchors that occur twice or more (in one text or in several) can belong to repeated windows.  Their pieces are
  gathered, equal pieces counted as one with their first place, and dealt by anchor.
* A reference shard is the pieces of one anchor in corpus order.  Its automaton is fed
  word by word; matching statistics of each piece against all that came before tell which of
  its windows occur earlier.

A window among the pieces that is not some window's first occurrence is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinal.llm.frames import small_side
from vicinal.llm.tokens import chunks, grams, slide_min, split_words
from vicinal.plans.sizing import cut_lineage

#: Words of a window; a word in a window that occurs earlier is removed.
WINDOW = 20
#: Words of an anchor.
GRAM = 8
#: Windows of a piece at most; a longer run is cut.
PIECE = 16
#: Different pieces of one anchor that one automaton takes.  The windows of an anchor with
#: more of them are told apart one by one instead, by an aggregation that no key can overload.
SHARD_PIECES = 256

#: Anchors that are looked for ahead of the shuffle, as so many rows have them.
HOT_ANCHORS = 100_000
#: Rows in every 64th document that make an anchor so frequent.
HOT_LEAST = 64
#: Places that the rows of each of them are dealt to.
HOT_PLACES = 4096

_LAST = 2**63 - 1


def runs(words, window: int, gram: int, piece: int):
    """Pieces of some texts: anchor, text, first window and number of windows of each, and how
    often its words hold the anchor."""
    hashed, whole = grams(words.hashes(), words.left, gram)
    hashed[~whole] = np.uint64(2**64 - 1)
    anchor = slide_min(hashed, window - gram + 1)
    left, owner = words.left, words.owner
    valid = left >= window
    at = np.flatnonzero(valid)
    if not len(at):
        return (np.zeros(0, np.int64),) * 5
    fresh = np.ones(len(at), bool)
    fresh[1:] = (np.diff(at) > 1) | (anchor[at[1:]] != anchor[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])
    # Cut long runs at every ``piece`` windows from their beginning.
    head = np.flatnonzero(fresh)
    since = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
    head = np.flatnonzero(since % piece == 0)
    count = np.diff(np.append(head, len(at)))
    first = at[head]
    wanted, held = anchor[first], np.zeros(len(first), np.int64)
    for j in range(piece + window - gram):
        place = first + j
        inside = j < count + (window - gram)
        held[inside] += hashed[place[inside]] == wanted[inside]
    return wanted.view(np.int64), owner[first], first - words.word_at[owner[first]], count, held


class Automaton:
    """Suffix automaton of several sequences, grown word by word.

    ``covered`` adds a sequence and tells, for every word, whether the ``window`` words
    up to it stand in what was added before them, be it an earlier sequence or an earlier
    place of the same one.
    """

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _clone(self, p: int, q: int, word) -> int:
        """State of the strings of ``q`` that end with ``word`` after those of ``p``."""
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, last: int, word) -> int:
        """Add ``word`` after the sequence of state ``last``; the state of the longer sequence."""
        q = self.next[last].get(word)
        if q is not None:  # another sequence went on alike
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, word)
        state = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, word)
        return state

    def covered(self, words: list, window: int) -> list[bool]:
        step, link, length = self.next, self.link, self.length
        last = state = matched = 0
        found = []
        for word in words:
            # The longest suffix that stood before: follow the word, or shorten until it fits.
            while state and word not in step[state]:
                state = link[state]
                matched = length[state]
            if word in step[state]:
                state = step[state][word]
                matched += 1
            found.append(matched >= window)
            last = self.add(last, word)
            # A split may have moved the match into the state of its shorter strings.
            while state and matched <= length[link[state]]:
                state = link[state]
        return found


def _pieces(window: int, gram: int):
    schema = pa.schema(
        [("h", pa.int64()), ("o", pa.int64()), ("x", pa.int64())]
        + [(c, pa.int32()) for c in ("start", "n", "held")]
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            o, x = (batch.column(c).to_numpy() for c in ("o", "x"))
            for first, data, at in chunks(batch.column("text")):
                anchor, owner, *rest = runs(split_words(data, at), window, gram, PIECE)
                yield pa.record_batch(
                    [anchor, o[first + owner], x[first + owner], *(c.astype(np.int32) for c in rest)],
                    schema=schema,
                )

    return find


def _cut(window: int):
    """Words of the wanted pieces of each text, joined by one blank."""
    schema = pa.schema(
        [("h", pa.int64()), ("o", pa.int64()), ("x", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("words", pa.string())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            o, x, wanted = (batch.column(c) for c in ("o", "x", "pieces"))
            at, values = wanted.offsets.to_numpy(), wanted.values
            start, n, h = (values.field(c).to_numpy() for c in ("start", "n", "h"))
            for first, data, text_at in chunks(batch.column("text")):
                words = split_words(data, text_at)
                raw = data.tobytes()
                count = len(text_at) - 1
                mine = slice(at[first], at[first + count])
                owner = np.repeat(np.arange(count), np.diff(at[first : first + count + 1]))
                begin = words.word_at[owner] + start[mine]
                a = words.begin[begin].tolist()
                b = words.end[begin + n[mine] + window - 2].tolist()
                joined = [b" ".join(raw[i:j].split()) for i, j in zip(a, b)]
                ids = pa.array(first + owner)
                yield pa.record_batch(
                    [h[mine], o.take(ids), x.take(ids), start[mine], n[mine], pa.array(joined, pa.binary()).cast(pa.string())],
                    schema=schema,
                )

    return cut


def _match(window: int):
    """First occurrences among pieces that come sorted by anchor and place."""
    schema = pa.schema([("o", pa.int64()), ("x", pa.int64()), ("start", pa.int32()), ("mask", pa.int32())])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor = automaton = None
        for batch in batches:
            rows = []
            for h, o, x, start, n, words in zip(*(batch.column(c).to_pylist() for c in ("h", "o", "x", "start", "n", "words"))):
                if h != anchor:
                    anchor, automaton = h, Automaton()
                seen = automaton.covered(words.split(" "), window)[window - 1 :]
                mask = sum(1 << i for i, known in enumerate(seen) if not known)
                if mask:
                    rows.append((o, x, start, mask))
            yield pa.record_batch(list(zip(*rows)) or [[]] * 4, schema=schema)

    return match


def _keep(window: int, columns: list[str]):
    """Kept words of every text.  ``pieces``: its windows that may go; ``firsts``: those that stay."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, copy, pieces, firsts in zip(*(batch.column(c) for c in ("text", "copy", "pieces", "firsts"))):
                words = (text.as_py() or "").encode().split()
                counts.append(len(words))
                if copy.as_py():
                    words = words if len(words) < window else []
                elif pieces.is_valid:
                    stay = {p["start"]: p["mask"] for p in firsts.as_py() or ()}
                    gone = np.zeros(len(words) + 1, np.int32)
                    for p in pieces.as_py():
                        mask = stay.get(p["start"], 0)
                        for i in range(p["n"]):
                            if not mask >> i & 1:
                                gone[p["start"] + i] += 1
                                gone[p["start"] + i + window] -= 1
                    lost = np.cumsum(gone) > 0
                    words = [w for w, g in zip(words, lost.tolist()) if not g]
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words))
            rest = [batch.column(c) for c in columns]
            yield pa.record_batch(
                [*rest, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=[*columns, "n_words", "n_removed", "kept_text"],
            )

    return keep


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_pieces: int = SHARD_PIECES
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` of every document.

    Order is by ``doc_id``, null ones last; documents of one id are ordered by a hash of their
    texts, and equal rows are one document and get equal results.  A null or blank text
    has no words and keeps none.  Texts after the first equal one go whole (if they have a
    window).  Words are compared as 64-bit hashes only to find candidates, then as words.
    """
    text = F.col("text")
    keyed = docs.select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(_LAST)).alias("o"), F.xxhash64(text).alias("x")
    )
    copies = cut_lineage(_copies(keyed))
    key = ["o", "x"]
    unique = keyed.join(small_side(copies), key, "left_anti")
    pieces = cut_lineage(
        unique.select("o", "x", "text").mapInArrow(
            _pieces(window, gram), "h bigint, o bigint, x bigint, start int, n int, held int"
        )
    )
    wanted = cut_lineage(
        _repeated(pieces).groupBy(*key).agg(F.collect_list(F.struct("start", "n", "h")).alias("pieces"))
    )
    # The ids alone are few enough to reach the documents in place; only texts of the wanted
    # ones are moved.
    ids = cut_lineage(wanted.select(*key))
    cut = (
        unique.join(small_side(ids), key, "left_semi")
        .join(wanted, key)
        .select("o", "x", "text", "pieces")
        .mapInArrow(_cut(window), "h bigint, o bigint, x bigint, start int, n int, words string")
    )
    # Equal pieces meet in the partial aggregation; only their first place can hold first windows.
    different = cut_lineage(
        cut.groupBy("h", "words", "n")
        .agg(F.min(F.struct("o", "x", "start")).alias("at"))
        .select("h", "at.o", "at.x", "at.start", "n", "words")
    )
    crowded = cut_lineage(
        different.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > shard_pieces).select("h")
    )
    ordinary = different.join(small_side(crowded), "h", "left_anti")
    automata = (
        ordinary.repartition("h")
        .sortWithinPartitions("h", "o", "x", "start")
        .mapInArrow(_match(window), "o bigint, x bigint, start int, mask int")
    )
    firsts = automata.unionByName(_single_windows(different, crowded, window))
    stays = firsts.groupBy(*key).agg(F.collect_list(F.struct("start", "mask")).alias("firsts"))
    marks = cut_lineage(wanted.join(stays, key, "left"))
    # A copy has no pieces of its own, so that its key is in no row of ``marks``.
    touched = keyed.join(small_side(ids), key, "left_semi").join(marks, key).withColumn("copy", F.lit(False))
    others = keyed.join(small_side(ids), key, "left_anti").join(
        small_side(copies.withColumn("copy", F.lit(True))), key, "left"
    )
    both = others.unionByName(touched, allowMissingColumns=True)
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string"
    return both.select(
        "doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "pieces", "firsts"
    ).mapInArrow(_keep(window, ["doc_id"]), schema)


def _repeated(pieces: DataFrame) -> DataFrame:
    """Pieces whose anchor stands twice or more, from one shuffle.

    Anchors so frequent that their rows would overload a task show in every 64th document
    already.  They are repeated, and their rows need not meet; at most ``HOT_ANCHORS`` can be
    so frequent, which bounds what is broadcast.  All other rows meet by anchor.
    """
    part = pieces.filter(F.pmod("x", F.lit(64)) == 0)
    least = max(HOT_LEAST, -(-pieces.count() // (64 * HOT_ANCHORS)))
    hot = F.broadcast(
        cut_lineage(part.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > least))
        .select("h", F.lit(True).alias("hot"))
    )
    # One pass for both: rows of frequent anchors are dealt over many places.
    deal = F.when(F.col("hot"), F.pmod(F.xxhash64("o", "x", "start"), F.lit(HOT_PLACES))).otherwise(0)
    met = pieces.join(hot, "h", "left").withColumn("deal", deal)
    held = F.sum("held").over(Window.partitionBy("h", "deal"))
    return met.withColumn("k", held).filter("hot OR k > 1").select(*pieces.columns)


def _copies(keyed: DataFrame) -> DataFrame:
    """Keys of the documents whose whole text an earlier one has."""
    ids = cut_lineage(keyed.select("o", "x", F.md5(F.col("text").cast("binary")).alias("m")))
    groups = ids.groupBy("m").agg(F.min("o").alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    # A hot text is one row of ``groups``; its many documents are split by Spark where need be.
    return ids.join(small_side(cut_lineage(groups)), "m").filter("o > first").select("o", "x").distinct()


def _single_windows(different: DataFrame, crowded: DataFrame, window: int) -> DataFrame:
    """First occurrences among the windows of crowded anchors, one mask bit each."""
    words = F.split("words", " ")
    each = different.join(small_side(crowded), "h").select(
        "o", "x", "start", words.alias("w"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")
    )
    one = each.select(
        "o",
        "x",
        "start",
        "i",
        F.concat_ws(" ", F.slice("w", F.col("i") + 1, window)).alias("window"),
    )
    place = F.struct("o", "x", (F.col("start") + F.col("i")).alias("at"), "start", "i")
    first = one.groupBy("window").agg(F.min(place).alias("p"))
    bit = F.pow(F.lit(2.0), F.col("p.i")).cast("int")
    return first.groupBy("p.o", "p.x", "p.start").agg(F.sum(bit).cast("int").alias("mask"))


def repeats_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document."""
    found = remove_repeats(docs.select("doc_id", "text"), window)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The same for a few ``(doc_id, text)`` of different ids, by a set of all windows so far."""
    seen, found = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone[i : i + window] = [True] * window
            seen.add(w)
        kept = [w for w, g in zip(words, gone) if not g]
        found.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return found
