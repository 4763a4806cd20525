"""Similarity join of word n-gram sets by chosen paths.

Documents with one set of n-grams are a class and take part once.  In every run each class
chooses the token (n-gram) of its set with the least hash; classes that choose one token meet
in its bucket.  A bucket is brute-forced when it is small, or when its members are alike anyway;
otherwise each of its members chooses again, by another hash, and the bucket splits.  Two classes
choose alike at each step with a chance that is their similarity, and the number of runs
follows from the recall asked for on the longest path.

Nothing lists the pairs of a bucket.  A task takes a small bucket, or one or two blocks of members of
large ones, whichever and however many these are.  It first
compares sketches, and only members with a likely partner bring their sets to a second task,
which compares them by matrix products and returns sums and a spanning forest of the links
it found.  A pair that meets in several buckets counts in one of them: with the large ones if it shares one, else in
the lowest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.components import components
from vicinal.llm.frames import small_side
from vicinal.llm.tokens import ALNUM, chunks, grams, hash_series, lowered, mix, split_words
from vicinal.plans.sizing import cut_lineage, settle

_LAST = 2**63 - 1


@dataclass(frozen=True)
class Settings:
    """``words`` of an n-gram, least ``similarity``, ``recall`` of a pair at that similarity.

    ``levels`` tokens deep at most, with ``deeper`` choices at each level after the first;
    ``bucket`` members are compared without further splitting, as
    are those whose mean similarity reaches ``alike``; ``block`` members of larger buckets
    are one side of a task.
    """

    words: int = 5
    similarity: float = 0.8
    recall: float = 0.99999
    levels: int = 3
    deeper: int = 1
    bucket: int = 256
    alike: float = 0.4
    block: int = 512
    signature: int = 4
    #: Bins of a sketch, and how many deviations below the threshold its estimate may lie.
    bins: int = 128
    deviations: float = 6.0

    @property
    def runs(self) -> int:
        """Enough for a pair whose shared tokens all have buckets that split at every level: it
        meets in one run if it chooses alike at the first level and at each further one."""
        further = 1 - (1 - self.similarity) ** self.deeper
        met = self.similarity * further ** (self.levels - 1)
        return math.ceil(math.log(1 - self.recall) / math.log(1 - met)) if met < 1 else 1


SETTINGS = Settings()


def token_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(text, sorted distinct n-gram hashes)``; a shorter text is one n-gram of all its words.

    Words are runs of letters and digits in lower case; other characters part them.
    """
    for first, data, at in chunks(texts):
        words = split_words(data, at, ALNUM)
        hashed = words.hashes(lowered(data))
        value, whole = grams(hashed, words.left, k)
        for i in range(len(at) - 1):
            a, b = int(words.word_at[i]), int(words.word_at[i + 1])
            if b - a >= k:
                yield first + i, np.unique(value[a : b - k + 1])
            elif b > a:
                short, _ = grams(hashed[a:b], np.arange(b - a, 0, -1), b - a)
                yield first + i, short[:1]
            else:
                yield first + i, np.zeros(0, np.uint64)


def set_key(s: np.ndarray) -> bytes | None:
    """16 bytes that stand for a set; None for the empty one."""
    if not len(s):
        return None
    other = mix(s ^ np.uint64(0x5851F42D4C957F2D))
    return s.sum(dtype=np.uint64).tobytes() + other.sum(dtype=np.uint64).tobytes()


def _classes(k: int):
    """The set key of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("o", pa.int64()), ("x", pa.int64()), ("c", pa.binary())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [set_key(s) for _, s in token_sets(batch.column("text"), k)]
            ids = [batch.column(c) for c in ("doc_id", "o", "x")]
            yield pa.record_batch([*ids, pa.array(keys, pa.binary())], schema=schema)

    return find


_CHOSEN = "array<struct<run:int,level:int,t:bigint>>"
_SKETCH_SEED = np.uint64(0x2545F4914F6CDD1D)


def sketch(s: np.ndarray, bins: int) -> bytes:
    """One byte a bin: of the least hash that falls into it; 0 if none does."""
    hashed = mix(s ^ _SKETCH_SEED)
    least = np.full(bins, np.uint64(2**64 - 1))
    np.minimum.at(least, (hashed % np.uint64(bins)).astype(np.int64), hashed >> np.uint64(8))
    found = (mix(least) % np.uint64(255)).astype(np.uint8) + np.uint8(1)
    found[least == np.uint64(2**64 - 1)] = 0
    return found.tobytes()


def _samples(settings: Settings):
    """For every run, the tokens that a class chooses at each level, and its signature.

    Each choice is the token with the least hash of its own, so that two sets choose alike
    with a chance of their similarity, whatever their sizes are.
    """
    chosen = pa.struct([("run", pa.int32()), ("level", pa.int32()), ("t", pa.int64())])
    schema = pa.schema([("c", pa.binary()), ("chosen", pa.list_(chosen)), ("signature", pa.list_(pa.int64())), ("sketch", pa.binary())])
    seeds = hash_series(53, settings.runs)[:, None]
    coordinates = hash_series(59, settings.signature)[:, None]
    of_choice = np.array([0] + [d for d in range(1, settings.levels) for _ in range(settings.deeper)])
    factors = hash_series(61, len(of_choice))
    all_runs = np.tile(np.arange(settings.runs), len(of_choice))
    all_levels = np.repeat(of_choice, settings.runs)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, least, sketches, runs, levels, tokens, counts = [], [], [], [], [], [], [0]
            for _, s in token_sets(batch.column("text"), settings.words):
                key = set_key(s)
                if key is None:
                    continue
                hashed = mix(s[None, :] ^ seeds)
                at = np.concatenate([(hashed * f).argmin(1) for f in factors])
                keys.append(key)
                least.append(mix(s[None, :] ^ coordinates).min(1).view(np.int64).tolist())
                sketches.append(sketch(s, settings.bins))
                runs.append(all_runs)
                levels.append(all_levels)
                tokens.append(s[at].view(np.int64))
                counts.append(counts[-1] + len(at))
            if not keys:
                continue
            fields = [
                pa.array(np.concatenate(v).astype(t)) for v, t in ((runs, np.int32), (levels, np.int32), (tokens, np.int64))
            ]
            lists = pa.ListArray.from_arrays(
                pa.array(counts, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(chosen))
            )
            own = [pa.array(v, schema.field(n).type) for n, v in (("c", keys), ("signature", least), ("sketch", sketches))]
            yield pa.record_batch([own[0], lists, *own[1:]], schema=schema)

    return find


def _leaves(samples: DataFrame, settings: Settings) -> DataFrame:
    """``path, c, k``: the members of all buckets to be compared, and how many they are."""
    level = samples.select("c", F.explode(F.filter("chosen", lambda s: s.level == 0)).alias("s"))
    members = level.select(F.xxhash64("s.run", "s.t").alias("path"), "s.run", "c")
    found = []
    for depth in range(settings.levels):
        sizes = cut_lineage(members.groupBy("path").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"))
        last = depth == settings.levels - 1
        # The first token of nearly every class is its own: most members go here.
        met = members.join(small_side(sizes), "path")
        small = met if last else met.filter(F.col("k") <= settings.bucket)
        found.append(small.select("path", "c", "k"))
        if last:
            break
        big = cut_lineage(met.filter(F.col("k") > settings.bucket))
        if big.isEmpty():
            break
        # Mean similarity of a bucket: how often two members agree in a signature number.
        spread = big.join(samples.select("c", "signature"), "c").select(
            "path", "k", F.posexplode("signature").alias("i", "v")
        )
        agreeing = spread.groupBy("path", "k", "i", "v").agg(F.count(F.lit(1)).alias("n"))
        mean = F.sum(F.col("n") * F.col("n")) / (F.col("k") * F.col("k") * settings.signature)
        judged = cut_lineage(
            agreeing.groupBy("path", "k").agg(mean.alias("mean")).select("path", (F.col("mean") >= settings.alike).alias("alike"))
        )
        split = big.join(small_side(judged), "path")
        found.append(split.filter("alike").select("path", "c", "k"))
        onward = split.filter("NOT alike").join(samples.select("c", "chosen"), "c")
        mine = lambda s: (s.run == F.col("run")) & (s.level == depth + 1)  # noqa: E731, B023
        members = cut_lineage(
            onward.select("path", "run", "c", F.explode(F.array_distinct(F.filter("chosen", mine))).alias("s")).select(
                F.xxhash64("path", "s.t").alias("path"), "run", "c"
            )
        )
    leaves = found[0]
    for more in found[1:]:
        leaves = leaves.unionByName(more)
    return cut_lineage(leaves)


def _without_repeats(leaves: DataFrame) -> DataFrame:
    """Of buckets with the same members, the lowest path only."""
    total = lambda h: F.sum(h.cast("decimal(20,0)")).alias
    marks = leaves.groupBy("path").agg(
        F.count(F.lit(1)).alias("k"), total(F.xxhash64("c"))("p"), total(F.xxhash64("c", F.lit(1)))("q")
    )
    kept = cut_lineage(marks.groupBy("k", "p", "q").agg(F.min("path").alias("path")).select("path"))
    return cut_lineage(leaves.join(small_side(kept), "path"))


def _tasks(leaves: DataFrame, settings: Settings) -> DataFrame:
    """``c, keys, crowds, tasks``: of every class its small buckets, its large ones, and where it is compared.

    A small bucket is one task.  Groups of many near copies fill a large bucket in nearly every run, so
    these are not compared one by one: a class lies in one block of its largest bucket, and two blocks are
    compared once, if they meet in any large bucket.  So a class takes part in as many tasks as the blocks it meets.
    """
    large = F.col("k") > settings.bucket
    of = lambda which: F.sort_array(F.collect_set(F.when(which, F.col("path"))))
    keys = cut_lineage(
        leaves.groupBy("c").agg(
            of(~large).alias("keys"), of(large).alias("crowds"), F.max(F.when(large, F.struct("k", "path"))).alias("home")
        ).select("c", "keys", "crowds", F.col("home.path").alias("home"))
    )
    homed = keys.filter("home IS NOT NULL")
    homes = cut_lineage(homed.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / settings.block).cast("bigint").alias("blocks")))
    block = F.xxhash64("home", F.pmod(F.xxhash64("c", F.lit(7)), F.col("blocks")))
    placed = cut_lineage(homed.join(small_side(homes), "home").select("c", "crowds", block.alias("block")))
    where = cut_lineage(placed.select("block", F.explode("crowds").alias("path")).distinct())
    pairs = cut_lineage(
        where.withColumnRenamed("block", "p").join(where.withColumnRenamed("block", "q"), "path").filter("p <= q").select("p", "q").distinct()
    )
    both = pairs.withColumn("block", F.explode(F.array_distinct(F.array("p", "q"))))
    side = F.when(F.col("p") == F.col("q"), 0).when(F.col("block") == F.col("p"), 1).otherwise(2)
    met = placed.select("c", "block").join(both, "block").select("c", F.struct(F.lit(True).alias("large"), "p", "q", side.alias("side")).alias("task"))
    alone = leaves.filter(~large).select(
        "c", F.struct(F.lit(False).alias("large"), F.col("path").alias("p"), F.col("path").alias("q"), F.lit(0).alias("side")).alias("task")
    )
    tasks = alone.unionByName(met).groupBy("c").agg(F.collect_list("task").alias("tasks"))
    return cut_lineage(tasks.join(keys.select("c", "keys", "crowds"), "c"))


def _spread(words: int):
    """The set of every class, once for each task it takes part in."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tasks, own = batch.column("tasks"), [batch.column(n) for n in ("c", "w", "keys", "crowds")]
            rows, size = [], 0
            for i, s in token_sets(batch.column("text"), words):
                raw, mine = s.tobytes(), [v[i].as_py() for v in own]
                for t in tasks[i].as_py():
                    rows.append((t["large"], t["p"], t["q"], t["side"], *mine, raw))
                    size += len(raw)
                if size > 8_000_000:
                    yield pa.record_batch([pa.array(v, f.type) for v, f in zip(zip(*rows), _SETS)], schema=_SETS)
                    rows, size = [], 0
            if rows:
                yield pa.record_batch([pa.array(v, f.type) for v, f in zip(zip(*rows), _SETS)], schema=_SETS)

    return spread


def common_counts(sets: list[np.ndarray], others: list[np.ndarray] | None = None, columns: int = 8192) -> np.ndarray:
    """Shared tokens of any two sets (of any of ``sets`` and any of ``others``), by products of blocks
    of their incidence matrices."""
    n, m = len(sets), len(sets) if others is None else len(others)
    every = sets if others is None else [*sets, *others]
    owner = np.repeat(np.arange(len(every)), [len(s) for s in every])
    _, token, count = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    shared = count[token] > 1
    number = np.cumsum(count > 1) - 1
    owner, token = owner[shared], number[token[shared]]
    found = np.zeros((n, m), np.float32)
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    for a in range(0, int(token[-1]) + 1 if len(token) else 0, columns):
        i, j = np.searchsorted(token, [a, a + columns])
        part = np.zeros((len(every), min(columns, int(token[-1]) + 1 - a)), np.float32)
        part[owner[i:j], token[i:j] - a] = 1
        found += part[:n] @ (part if others is None else part[n:]).T
    return found


class _Task:
    """The members of a task: the rows and columns of its matrix of pairs are one side and the other."""

    def __init__(self, large: bool, path: int, rows: list[dict]):
        self.large, self.path, self.rows = large, path, rows
        self.across = large and any(r["side"] for r in rows)
        self.left = [r for r in rows if r["side"] != 2]
        self.right = [r for r in rows if r["side"] == 2] if self.across else self.left

    def common(self, of) -> np.ndarray:
        """Shared numbers of any pair, of a list that ``of`` a member tells."""
        sets = [of(r) for r in self.left]
        return common_counts(sets, [of(r) for r in self.right] if self.across else None)

    def decided(self) -> np.ndarray:
        """The pairs that are decided here: in large buckets those that share one; else those
        that share neither a large bucket nor a lower small one."""
        if self.large:
            met = self.common(lambda r: np.array(r["crowds"], np.int64).astype(np.uint64)) > 0
        else:
            met = np.ones((len(self.left), len(self.right)), bool)
            elsewhere = [[*(k for k in r["keys"] if k < self.path), *r["crowds"]] for r in self.rows]
            if any(elsewhere):
                met &= common_counts([np.array(k, np.int64).astype(np.uint64) for k in elsewhere]) == 0
        if not self.across:
            np.fill_diagonal(met, False)
        return met


def _likely(task: _Task, settings: Settings) -> list[dict]:
    """Members with a partner whose sketch does not rule the pair out.

    The share of equal bins estimates the similarity.  A similar pair lies ``deviations``
    standard deviations below with a chance of about 1e-9.
    """
    left, right = (np.stack([np.frombuffer(r["sketch"], np.uint8) for r in side]) for side in (task.left, task.right))
    likely = task.decided()
    t = settings.similarity
    for a in range(0, len(left), 64):
        equal = np.zeros((len(left[a : a + 64]), len(right)), np.int16)
        empty = np.zeros_like(equal)
        for one, other in zip(left[a : a + 64].T, right.T):
            same = one[:, None] == other[None, :]
            filled = one > 0
            if filled.all():
                equal += same
            else:
                equal += same & filled[:, None]
                empty += ~filled[:, None] & (other == 0)[None, :]
        used = settings.bins - empty
        likely[a : a + 64] &= equal >= t * used - settings.deviations * np.sqrt(used * t * (1 - t))
    shown = [r for r, some in zip(task.left, likely.any(1)) if some]
    if task.across:
        shown += [r for r, some in zip(task.right, likely.any(0)) if some]
    return shown


def _linked(task: _Task, settings: Settings) -> list[dict]:
    """``c, links, lower`` of members with a link: the sum of its partners' documents, and the
    lowest class of its tree."""
    sets = lambda r: np.frombuffer(r["tokens"], np.uint64)
    size = [np.array([len(r["tokens"]) / 8 for r in side]) for side in (task.left, task.right)]
    weight = [np.array([r["w"] for r in side]) for side in (task.left, task.right)]
    common = task.common(sets)
    linked = common >= settings.similarity * (size[0][:, None] + size[1][None, :] - common) - 1e-6
    linked &= task.decided()
    if task.across:
        rows = task.left + task.right
        links = np.r_[linked @ weight[1], weight[0] @ linked]
    else:
        rows, links = task.left, linked @ weight[1]
    n = len(task.left)
    place = np.argsort(np.argsort([r["c"] for r in rows]))
    label, by_place = place.copy(), np.argsort(place)
    far = len(rows)
    while True:
        other = label[n:] if task.across else label
        least = label.copy()
        least[:n] = np.minimum(least[:n], np.where(linked, other[None, :], far).min(1, initial=far))
        if task.across:
            least[n:] = np.minimum(least[n:], np.where(linked, least[:n, None], far).min(0, initial=far))
        least = least[by_place[least]]
        if (least == label).all():
            break
        label = least
    return [
        {"c": r["c"], "links": int(k), "lower": rows[by_place[low]]["c"] if low != own else None}
        for r, k, low, own in zip(rows, links, label, place)
        if k
    ]


def _by_task(decide, settings: Settings, schema: pa.Schema):
    """Apply ``decide(task, settings)`` to the members of each task, which come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, {}

        def done():
            if len(members) < 2:
                return []
            task = _Task(key[0], key[1], [members[c] for c in sorted(members)])
            return decide(task, settings) if task.left and task.right else []

        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if (row["large"], row["p"], row["q"]) != key:
                    found += done()
                    key, members = (row["large"], row["p"], row["q"]), {}
                members[row["c"]] = row  # equal rows bring a class twice
            yield pa.RecordBatch.from_pylist(found, schema=schema)
        yield pa.RecordBatch.from_pylist(done(), schema=schema)

    return run


def _in_tasks(rows: DataFrame, decide, settings: Settings, schema: pa.Schema, ddl: str) -> DataFrame:
    dealt = rows.repartition("large", "p", "q").sortWithinPartitions("large", "p", "q")
    return dealt.mapInArrow(_by_task(decide, settings, schema), ddl)


_PLACE = [("large", pa.bool_()), ("p", pa.int64()), ("q", pa.int64()), ("side", pa.int32()), ("c", pa.binary())]
_BUCKETS = [("keys", pa.list_(pa.int64())), ("crowds", pa.list_(pa.int64()))]
_LIKELY = pa.schema([*_PLACE, *_BUCKETS])
_SETS = pa.schema([*_PLACE, ("w", pa.int64()), *_BUCKETS, ("tokens", pa.binary())])
_LINKED = pa.schema([("c", pa.binary()), ("links", pa.int64()), ("lower", pa.binary())])
_PLACE_DDL = "large boolean, p bigint, q bigint, side int, c binary"
_BUCKETS_DDL = "keys array<bigint>, crowds array<bigint>"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("o"), F.xxhash64("text").alias("x"), "text")


def similar_classes(docs: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """``doc_id, o, x, c, first, first_x, links`` of every document.

    ``o`` and ``x`` are its place in order (null ids last) and a hash of its text; ``first`` and
    ``first_x`` are those of the first document of its group of linked ones; ``links`` counts
    the other documents that are similar to it.  Documents without words (null text included)
    are linked to none.  Equal rows are documents of their own and linked.
    """
    keyed = _keyed(docs)
    members = cut_lineage(
        keyed.mapInArrow(_classes(settings.words), "doc_id bigint, o bigint, x bigint, c binary")
    )
    classes = cut_lineage(
        members.filter("c IS NOT NULL")
        .groupBy("c")
        .agg(F.count(F.lit(1)).alias("w"), F.min(F.struct("o", "x")).alias("first"))
        .select("c", "w", "first.o", "first.x")
    )
    shared = cut_lineage(classes.filter("w > 1").select("c", F.col("o").alias("o1"), F.col("x").alias("x1")))
    others = members.join(small_side(shared), "c").filter("o != o1 OR x != x1").select("o", "x").distinct()
    single = keyed.join(small_side(cut_lineage(others)), ["o", "x"], "left_anti")
    samples = cut_lineage(
        single.select("text").mapInArrow(_samples(settings), f"c binary, chosen {_CHOSEN}, signature array<bigint>, sketch binary")
    )
    tasks = _tasks(_without_repeats(_leaves(samples, settings)), settings)
    sketched = tasks.join(samples.select("c", "sketch"), "c").select("c", "keys", "crowds", "sketch", F.explode("tasks").alias("t"))
    likely = cut_lineage(
        _in_tasks(
            sketched.select("t.*", "c", "keys", "crowds", "sketch"), _likely, settings, _LIKELY, f"{_PLACE_DDL}, {_BUCKETS_DDL}"
        )
    )
    again = likely.groupBy("c").agg(
        F.collect_list(F.struct("large", "p", "q", "side")).alias("tasks"),
        F.first("keys").alias("keys"),
        F.first("crowds").alias("crowds"),
    )
    taking = cut_lineage(again.join(classes, "c"))
    sets = single.select("o", "x", "text").join(small_side(taking), ["o", "x"]).select("c", "w", "keys", "crowds", "tasks", "text")
    spread = sets.mapInArrow(_spread(settings.words), f"{_PLACE_DDL}, w bigint, {_BUCKETS_DDL}, tokens binary")
    found = cut_lineage(_in_tasks(spread, _linked, settings, _LINKED, "c binary, links bigint, lower binary"))
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    labels = components(found.filter("lower IS NOT NULL").select(F.col("c").alias("u"), F.col("lower").alias("v")))
    of_class = classes.join(small_side(labels.withColumnRenamed("node", "c")), "c", "left").select(
        "c", "w", "o", "x", F.coalesce("label", "c").alias("label")
    )
    of_class = cut_lineage(of_class.join(small_side(cut_lineage(links)), "c", "left"))
    firsts = of_class.groupBy("label").agg(F.min(F.struct("o", "x")).alias("first"))
    told = cut_lineage(
        of_class.join(small_side(cut_lineage(firsts)), "label")
        .select("c", F.col("first.o").alias("first"), F.col("first.x").alias("first_x"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"))
    )
    return members.join(small_side(told), "c", "left").select(
        "doc_id", "o", "x", "c",
        F.coalesce("first", "o").alias("first"), F.coalesce("first_x", "x").alias("first_x"),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("links"),
    )


def join_report(docs: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """``doc_id, class_id, n_links``: the lowest id of its group, and its number of links.

    The group of a document without words is its own.  Among null ids ``class_id`` is null.
    """
    class_id = F.when(F.col("first") != _LAST, F.col("first"))
    told = ["doc_id", class_id.alias("class_id"), F.col("links").alias("n_links")]
    return settle(docs.sparkSession, lambda: similar_classes(docs.select("doc_id", "text"), settings).select(*told))


def keep_one(docs: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """``docs`` (``doc_id, text`` and any others) with the first document of each group only.

    Of equal rows one stays; documents without words stay, but for repeats of a row.
    """
    key = ["o", "x"]
    spark, pair = docs.sparkSession, docs.select("doc_id", "text")
    found = settle(spark, lambda: similar_classes(pair, settings).select(*key, "first", "first_x"))
    rows = docs.select(
        F.struct("*").alias("row"), F.coalesce("doc_id", F.lit(_LAST)).alias("o"), F.xxhash64("text").alias("x")
    )
    gone = cut_lineage(found.filter("o != first OR x != first_x").select(*key).distinct())
    again = cut_lineage(found.groupBy(*key).agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(*key))
    kept = rows.join(small_side(gone), key, "left_anti")
    once = kept.join(small_side(again), key, "left_anti").select("row")
    # Rows of one id and text may differ elsewhere: the lowest of them stays.
    repeated = kept.join(small_side(again), key, "left_semi").groupBy(*key).agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return once.unionByName(repeated).select("row.*")
