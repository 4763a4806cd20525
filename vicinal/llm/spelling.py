"""Group spelling variants: permuterm rotations of words, sorted and scanned.

A word followed by a terminator is rotated to every start.  Two words that differ by one replaced
code point have rotations that agree in all but the last place; a word with one code point more
has a rotation that, but for its last place, is a whole rotation of the shorter word.  So every
rotation is sorted under its prefix without the edited last place, and words that meet under one
prefix are near.  A prefix holds at most one whole rotation and one skipped one for each code
point of the alphabet, whatever the number of words is.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.frames import small_side
from vicinal.plans.sizing import cut_lineage

#: Ends a word in its rotations; a word that holds it has no neighbours.
TERMINATOR = "\x00"


@dataclass(frozen=True)
class Settings:
    """Words of ``length`` code points and ``count`` occurrences at least; a form occurs ``ratio``
    times as often as the word; one of ``slips`` runs of a document loses a code point."""

    length: int = 6
    count: int = 5
    ratio: int = 5
    slips: int = 199
    #: Different words that a task counts ahead of the shuffle.
    held: int = 400_000


SETTINGS = Settings()
_UPPER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def slip(run: str, prefix: int, slips: int) -> str:
    """``run`` without one code point where its checksum, begun with ``prefix``, is divisible by ``slips``."""
    h = zlib.crc32(run.encode(), prefix)
    at = h % len(run)
    return run if h % slips else run[:at] + run[at + 1 :]


def _counts(settings: Settings):
    """Words and their occurrences, counted in each task as far as its memory goes."""
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % settings.length)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def told(found: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                if not text.is_valid:
                    continue
                prefix = zlib.crc32(f"{doc_id.as_py() if doc_id.is_valid else 'null'}:".encode())
                for run, n in Counter(runs.findall(text.as_py().translate(_UPPER))).items():
                    word = slip(run, prefix, settings.slips)
                    if len(word) >= settings.length:
                        found[word] += n
                if len(found) >= settings.held:
                    yield told(found)
                    found = Counter()
        yield told(found)

    return count


def word_counts(docs: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """``word, n`` of the words of ``docs`` (``doc_id, text``) that occur often enough.

    Words are maximal runs of ASCII letters and U+00C0 to U+00FF with A-Z in lower case, some of them with a
    seeded slip.  Null and empty texts have none, a null id counts as the text ``null``, and equal rows count as
    often as they stand.
    """
    found = docs.select("doc_id", "text").mapInArrow(_counts(settings), "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= settings.count)


def rotations(words: DataFrame) -> DataFrame:
    """``prefix, word, n, skipped, lead``: all rotations of every word.

    A whole rotation has no ``skipped`` place; the others leave out the last one.  ``lead`` tells
    the first of a row of equal code points: leaving out any of them gives the same word, so that only
    this one stands for a deletion.
    """
    word, length = F.col("word"), F.length("word")
    part = lambda a, n: F.substring(word, a, n)

    def at(i):
        before, here = part(F.lit(1), i), part(i + 1, F.lit(1))
        whole = F.struct(
            F.concat(part(i + 1, length), F.lit(TERMINATOR), before).alias("prefix"),
            F.lit(False).alias("skipped"),
            F.lit(True).alias("lead"),
        )
        rest = F.struct(
            F.concat(part(i + 2, length), F.lit(TERMINATOR), before).alias("prefix"),
            F.lit(True).alias("skipped"),
            ((i == 0) | (here != part(i, F.lit(1)))).alias("lead"),
        )
        return F.when(i < length, F.array(whole, rest)).otherwise(F.array(whole))

    turned = F.flatten(F.transform(F.sequence(F.lit(0), length), at))
    plain = words.filter(~F.contains(word, F.lit(TERMINATOR)))
    return plain.select("word", "n", F.explode(turned).alias("r")).select("r.prefix", "word", "n", "r.skipped", "r.lead")


_MET = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best", pa.string()), ("best_n", pa.int64())])


def _others(prefix: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For members sorted by rank within each prefix: those that have others, how many, and the best of these."""
    start = np.flatnonzero(np.r_[True, prefix[group][1:] != prefix[group][:-1]]) if len(group) else group
    size = np.diff(np.r_[start, len(group)])
    first, many = np.repeat(start, size), np.repeat(size, size)
    here = np.arange(len(group))
    best = np.where(here == first, np.minimum(first + 1, len(group) - 1), first)
    shown = many > 1
    return group[shown], many[shown] - 1, group[best[shown]]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours of the rotations of each prefix; rows come by prefix, then by falling ``n`` and rising word."""
    kept: pa.Table | None = None

    def near(table: pa.Table) -> pa.RecordBatch:
        codes = pc.dictionary_encode(table.column("prefix").combine_chunks())
        prefix = codes.indices.to_numpy(zero_copy_only=False)
        skipped = table.column("skipped").to_numpy()
        lead = table.column("lead").to_numpy()
        rows, counts, bests = _others(prefix, np.flatnonzero(skipped))
        found = [(rows, counts, bests)]
        whole, cut = np.flatnonzero(~skipped), np.flatnonzero(skipped & lead)
        owner = np.full(int(prefix.max()) + 1 if len(prefix) else 0, -1)
        owner[prefix[whole]] = whole
        cut = cut[owner[prefix[cut]] >= 0]
        found.append((cut, np.ones(len(cut), np.int64), owner[prefix[cut]]))
        here, first, many = np.unique(prefix[cut], return_index=True, return_counts=True)
        found.append((owner[here], many, cut[first]))
        rows, counts, bests = (np.concatenate(x).astype(np.int64) for x in zip(*found))
        word, n = table.column("word").combine_chunks(), table.column("n").combine_chunks()
        return pa.record_batch([word.take(pa.array(rows)), pa.array(counts), word.take(pa.array(bests)), n.take(pa.array(bests))], schema=_MET)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if kept is not None:
            table = pa.concat_tables([kept, table])
        if not len(table):
            continue
        prefix = table.column("prefix").combine_chunks()
        ends = pc.equal(prefix, prefix[-1]).to_numpy(zero_copy_only=False)
        last = int(np.flatnonzero(~ends)[-1]) + 1 if not ends.all() else 0
        kept = table.slice(last)
        yield near(table.slice(0, last))
    if kept is not None:
        yield near(kept)


def neighbours(words: DataFrame) -> DataFrame:
    """``word, n_near, best, best_n`` of words that have a near one: how many there are, and
    the most frequent of them (ties: the smallest word).  Words must be unique."""
    turned = rotations(words).repartition("prefix").sortWithinPartitions("prefix", F.desc("n"), "word", "skipped")
    met = turned.mapInArrow(_scan, "word string, near bigint, best string, best_n bigint")
    best = F.min(F.struct((-F.col("best_n")).alias("k"), "best"))
    return met.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", "b.best", (-F.col("b.k")).alias("best_n")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every ``word, form``.  A form is several times as frequent as its word, so there
    is no circle, and as every round doubles the steps taken, few rounds reach the end."""
    found = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = small_side(found.select(F.col("word").alias("root"), F.col("root").alias("next")))
        stepped = cut_lineage(found.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"))
        found = stepped.select("word", "root")
        if stepped.filter("next IS NOT NULL").isEmpty():
            return found


def variants(words: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of a table of unique words and their counts.

    ``form`` is the near word of the largest count (ties: the smallest in code-point order) if that is large
    enough; ``root`` is where following forms ends.  An empty table gives an empty one, and a null word or a
    null count none.
    """
    words = cut_lineage(words.select("word", "n").dropna())
    near = cut_lineage(neighbours(words))
    is_form = F.col("best_n") >= settings.ratio * F.col("n")
    told = cut_lineage(
        words.join(small_side(near), "word", "left").select(
            "word",
            F.when(is_form, F.col("best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(is_form, F.col("best_n")).alias("form_n"),
        )
    )
    roots = _roots(told.filter("form IS NOT NULL"))
    return told.join(small_side(roots), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def brute_force(counts: dict[str, int], ratio: int = 5) -> dict[str, tuple]:
    """``form, root, n, n_near, form_n`` by comparing all words."""

    def edited(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    near = {a: [b for b in counts if edited(a, b)] for a in counts}
    form = {}
    for a, found in near.items():
        best = min(found, key=lambda b: (-counts[b], b), default=None)
        form[a] = best if best is not None and counts[best] >= ratio * counts[a] else None

    def root(a: str) -> str:
        while form[a] is not None:
            a = form[a]
        return a

    return {a: (form[a], root(a), counts[a], len(near[a]), counts.get(form[a])) for a in counts}


_CRC = ", ".join(
    str((lambda f: f(f, i, 4))(lambda f, c, k: c if k == 0 else f(f, (c >> 1) ^ (0xEDB88320 * (c & 1)), k - 1)))
    for i in range(16)
)
_LETTER = "[A-Za-zÀ-ÿ]"

#: The same over the whole table ``documents`` for DuckDB, which has no CRC: it is worked out by half bytes.
SQL = f"""
WITH RECURSIVE runs AS (
  SELECT key, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), 'null') AS key,
    unnest(regexp_extract_all(text, '{_LETTER}{{6,}}')) AS run FROM documents)
  GROUP BY ALL),
nibbles AS (
  SELECT *, list_transform(string_split(hex(encode(key || ':' || run)), ''), lambda c: strpos('0123456789ABCDEF', c) - 1)
    AS b FROM runs),
sums AS (
  SELECT run, k, xor(4294967295::BIGINT,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(b)),
      lambda i: (b[CAST(CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END AS BIGINT)])::BIGINT)),
      lambda c, v: xor(c >> 4, [{_CRC}][1 + (xor(c, v) & 15)]::BIGINT))) AS h FROM nibbles),
slipped AS (
  SELECT CASE WHEN h % {SETTINGS.slips} <> 0 THEN run
    ELSE run[:CAST(h % length(run) AS BIGINT)] || run[CAST(h % length(run) AS BIGINT) + 2:] END AS word, k FROM sums),
words AS MATERIALIZED (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM slipped WHERE length(word) >= {SETTINGS.length} GROUP BY word
  HAVING sum(k) >= {SETTINGS.count}),
holes AS MATERIALIZED (
  SELECT word, n, i, word[:i] || word[i + 2:] AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON w.word = h.rest
  UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON w.word = h.rest),
best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS best_n FROM near GROUP BY word),
told AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
    CASE WHEN best_n >= {SETTINGS.ratio} * w.n THEN (SELECT min(x.other) FROM near x
      WHERE x.word = w.word AND x.other_n = b.best_n) END AS form,
    CASE WHEN best_n >= {SETTINGS.ratio} * w.n THEN best_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
walk(word, cur) AS (
  SELECT word, form FROM told WHERE form IS NOT NULL
  UNION ALL SELECT walk.word, told.form FROM walk JOIN told ON told.word = walk.cur WHERE told.form IS NOT NULL),
roots AS (
  SELECT walk.word, walk.cur AS root FROM walk JOIN told ON told.word = walk.cur WHERE told.form IS NULL)
SELECT t.word, t.form, coalesce(r.root, t.word) AS root, t.n, t.n_near, t.form_n
FROM told t LEFT JOIN roots r USING (word)
"""
