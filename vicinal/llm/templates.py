"""Drop lines whose template recurs across documents.

Lines are parsed as log lines are, by a tree of fixed depth: the first level is the number of
tokens, the next ones are the leading tokens, with variable ones generalised.  A token with a
digit is variable, and so is a leading one that fewer than ``DOCUMENTS`` documents have at its
place in lines of its length: it goes to a wildcard child, which takes up no level, so that a leaf
always stands on ``DEPTH`` tokens that recur.  A line that has too few of these among its first
``LEADS`` tokens has no leaf and stays.  In a leaf that enough documents reach, every further position keeps its frequent
tokens as they are and generalises the rest; that is the line's template.  A template that
enough documents have, and that keeps enough constant tokens, is boilerplate.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinal.llm.frames import small_side
from vicinal.llm.tokens import byte_class, chunks, hash_series, mix, split_words
from vicinal.plans.sizing import cut_lineage

#: Leading tokens that lead to a leaf (all of them in a shorter line), wildcards not counted, and
#: the first tokens of a line among which they are looked for.
DEPTH, LEADS = 3, 6
#: Documents that make a leaf worth parsing and a template recurring, and lines (each once a
#: document) that make a token of a leaf constant.
DOCUMENTS = 5
#: Least share of constant tokens, and least number of them, in a template to be dropped.
CONSTANT, FEWEST = 0.5, 3

_DIGIT = byte_class(b"0123456789")
_ANY, _SEED, _RARE, _PLACE = hash_series(67, 4)
_LAST = 2**63 - 1
#: Leading tokens gathered before they are counted, and frequent ones that a task remembers.
_GATHERED, _KNOWN = 1 << 18, 1 << 20


def _lines(data: np.ndarray, at: np.ndarray):
    """Tokens of some texts with the line of each; lines are numbered within their text.

    Returns token hashes (variable tokens generalised), the text and line of each line that
    has a token, and where the tokens of each begin.
    """
    words = split_words(data, at)
    hashed = words.hashes()
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    hashed[digits[words.end] > digits[words.begin]] = _ANY
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    owner = words.owner
    line = breaks[words.begin] - breaks[at[owner]] if len(owner) else owner
    head = np.ones(len(owner), bool)
    head[1:] = (owner[1:] != owner[:-1]) | (line[1:] != line[:-1])
    first = np.flatnonzero(head)
    return hashed, owner[first], line[first], np.append(first, len(owner))


_HEADS = "d bigint, o bigint, x bigint, line array<int>, size array<int>, token array<bigint>"


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number, length and leading tokens of every line, as one row a document that has any."""
    for batch in batches:
        named = [batch.column(c).to_numpy() for c in ("d", "o", "x")]
        for first, data, at in chunks(batch.column("text")):
            hashed, owner, line, begin = _lines(data, at)
            size = np.diff(begin)
            some = np.minimum(size, LEADS)
            starts = np.concatenate([[0], np.cumsum(some)])
            tokens = hashed[np.arange(starts[-1]) + np.repeat(begin[:-1] - starts[:-1], some)]
            docs, lines = np.unique(owner, return_index=True)
            lines = np.append(lines, len(owner))
            by_line, by_token = pa.array(lines, pa.int32()), pa.array(starts[lines], pa.int32())
            yield pa.record_batch(
                [
                    *(c[first + docs] for c in named),
                    pa.ListArray.from_arrays(by_line, pa.array(line, pa.int32())),
                    pa.ListArray.from_arrays(by_line, pa.array(size, pa.int32())),
                    pa.ListArray.from_arrays(by_token, pa.array(tokens.view(np.int64))),
                ],
                names=["d", "o", "x", "line", "size", "token"],
            )


def _opened(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Document, number and length of each line of ``_heads``, and its leading tokens (0 where it has none)."""
    lines = batch.column("line")
    owner = np.repeat(np.arange(batch.num_rows), lines.value_lengths().to_numpy(zero_copy_only=False))
    size = batch.column("size").flatten().to_numpy()
    has = size[:, None] > np.arange(LEADS)
    tokens = np.zeros(has.shape, np.uint64)
    tokens[has] = batch.column("token").flatten().to_numpy().view(np.uint64)
    return owner, lines.flatten().to_numpy(), size, tokens, has


def _lead_keys(size: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Key of each leading token of each line: length of the line, place, token."""
    place = size.astype(np.uint64)[:, None] * np.uint64(LEADS) + np.arange(LEADS, dtype=np.uint64) + _PLACE
    return mix(tokens ^ mix(place)).view(np.int64)


def _leads(batches: Iterator[pa.RecordBatch], documents: int) -> Iterator[pa.RecordBatch]:
    """Leading tokens without a digit, each once a document: ``key, d``.

    A key that ``documents`` of those gathered have is told once, without a document, and passed
    over from then on as long as the task remembers it.
    """
    gathered: list[np.ndarray] = []
    known = np.zeros(0, np.int64)

    def counted() -> tuple[pa.RecordBatch, np.ndarray]:
        rows = np.concatenate(gathered, axis=1)
        rows = rows[:, np.lexsort(rows[::-1])]
        new = np.ones(rows.shape[1], bool)
        new[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
        rows = rows[:, new]
        keys, of, n = np.unique(rows[0], return_inverse=True, return_counts=True)
        full = keys[n >= documents]
        key, d = rows[:, n[of] < documents]
        keys, many = np.concatenate([key, full]), len(key) + len(full)
        d = pa.array(np.resize(np.append(d, 0), many), pa.int64(), mask=np.arange(many) >= len(d))
        return pa.record_batch([pa.array(keys), d], names=["key", "d"]), full

    for batch in batches:
        owner, _, size, tokens, has = _opened(batch)
        row, place = np.nonzero(has & (tokens != _ANY))
        pairs = np.stack([_lead_keys(size, tokens)[row, place], batch.column("d").to_numpy()[owner[row]]])
        gathered.append(pairs[:, ~np.isin(pairs[0], known)])
        if sum(rows.shape[1] for rows in gathered) >= _GATHERED:
            told, full = counted()
            yield told
            gathered, known = [], full if len(known) > _KNOWN else np.union1d(known, full)
    if gathered:
        yield counted()[0]


def _rare_leads(heads: DataFrame, documents: int) -> DataFrame:
    """``d, rare``: the keys of a document's leading tokens that fewer than ``documents`` documents share.

    Each task tells a key few times only, so that no key loads the task that counts it.
    """
    rows = heads.select("d", "line", "size", "token").mapInArrow(
        lambda batches: _leads(batches, documents), "key bigint, d bigint"
    )
    same = Window.partitionBy("key")
    counted = rows.repartition("key").distinct().select(
        "*", F.count("d").over(same).alias("n"), F.max(F.isnull("d")).over(same).alias("full")
    )
    few = counted.filter(~F.col("full") & (F.col("n") < documents))
    return few.groupBy("d").agg(F.collect_list("key").alias("rare"))


def _walks(size: np.ndarray, tokens: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaf of each line (a hash of its length and its way down), whether it has one, and the places of its wildcards
    as bits.  ``rare`` tells the rare ones of the leading tokens."""
    has = size[:, None] > np.arange(LEADS)
    held = has & ~rare
    way = has & (np.cumsum(held, axis=1) - held < DEPTH)
    key, wild = mix(size.astype(np.uint64) + _SEED), np.zeros(len(size), np.int32)
    for j in range(LEADS):
        on = way[:, j]
        key[on] = mix(key[on] ^ np.where(rare[on, j], _RARE, tokens[on, j]))
        wild[on & rare[:, j]] |= 1 << j
    return key.view(np.int64), held.sum(axis=1) >= np.minimum(size, DEPTH), wild


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of every document that have a leaf."""
    for batch in batches:
        o, x = (batch.column(c).to_numpy() for c in ("o", "x"))
        owner, line, size, tokens, has = _opened(batch)
        # A key is rare or not in all documents alike, so that those of a batch can be looked up together.
        rare = has & np.isin(_lead_keys(size, tokens), batch.column("rare").flatten().to_numpy())
        leaf, reached, wild = _walks(size, tokens, rare)
        owner = owner[reached]
        yield pa.record_batch(
            [o[owner], x[owner], line[reached], leaf[reached], wild[reached]], names=["o", "x", "line", "leaf", "wild"]
        )


_PARSED = "o bigint, x bigint, line int, leaf bigint, id binary, tokens array<bigint>"


def _line_ids(hashed: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """16 bytes that stand for the tokens of each line, in order."""
    size = np.diff(begin)
    place = np.arange(len(hashed)) - np.repeat(begin[:-1], size)
    halves = []
    for seed in (np.uint64(1), np.uint64(2)):
        sums = np.zeros(len(hashed) + 1, np.uint64)
        np.cumsum(mix(hashed ^ mix(place.astype(np.uint64) * np.uint64(4) + seed)), out=sums[1:])
        halves.append(sums[begin[1:]] - sums[begin[:-1]])
    return [row.tobytes() for row in np.stack(halves, axis=1)]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted lines of every document as tokens, rare leading ones replaced."""
    for batch in batches:
        o, x = (batch.column(c).to_numpy() for c in ("o", "x"))
        wanted = batch.column("lines")
        edges = np.concatenate([[0], np.cumsum(wanted.value_lengths().to_numpy(zero_copy_only=False))])
        flat = wanted.flatten()
        number, leaf, wild = (flat.field(c).to_numpy() for c in ("line", "leaf", "wild"))
        for first, data, at in chunks(batch.column("text")):
            hashed, owner, line, begin = _lines(data, at)
            some = slice(edges[first], edges[first + len(at) - 1])
            of = np.repeat(np.arange(len(at) - 1), np.diff(edges[first : first + len(at)]))
            j = np.searchsorted((owner << 32) + line, (of << 32) + number[some])
            for p in range(LEADS):
                hashed[begin[j[(wild[some] >> p) & 1 == 1]] + p] = _RARE
            ids = _line_ids(hashed, begin)
            size = np.diff(begin)[j]
            starts = np.concatenate([[0], np.cumsum(size)])
            places = np.arange(starts[-1]) + np.repeat(begin[j] - starts[:-1], size)
            tokens = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(hashed[places].view(np.int64)))
            columns = [o[first + of], x[first + of], number[some], leaf[some], pa.array([ids[k] for k in j], pa.binary()), tokens]
            yield pa.record_batch(columns, names=["o", "x", "line", "leaf", "id", "tokens"])


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their dropped lines."""
    for batch in batches:
        total, gone, kept = [], [], []
        for text, drop in zip(batch.column("text"), batch.column("drop")):
            if not text.is_valid:
                total.append(0)
                gone.append(0)
                kept.append(None)
                continue
            lines = text.as_py().split("\n")
            out = set(drop.as_py() or ())
            total.append(sum(1 for line in lines if line.encode().split()))
            gone.append(len(out))
            kept.append("\n".join(line for i, line in enumerate(lines) if i not in out))
        yield pa.record_batch(
            [batch.column("row"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
            names=["row", "n_lines", "n_dropped", "kept_text"],
        )


def boilerplate_lines(docs: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """``o, x, lines``: the numbers of the lines to drop, of every document with some.

    ``o`` and ``x`` are the document's id (the highest number for null) and text hash: equal rows
    are one document.  Lines of white space have no template and stay.
    """
    keyed = docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("o"), F.xxhash64("text").alias("x"), "text")
    key = ["o", "x"]
    heads = cut_lineage(keyed.withColumn("d", F.xxhash64(*key)).mapInArrow(_heads, _HEADS))
    # Heads take about a quarter of the texts' bytes; a document repeated in many rows is split by adaptive execution.
    rare = cut_lineage(_rare_leads(heads, documents))
    told = heads.join(rare.hint("merge"), "d", "left").select(*key, "line", "size", "token", "rare")
    leaves = cut_lineage(told.mapInArrow(_leaves, "o bigint, x bigint, line int, leaf bigint, wild int"))
    reached = cut_lineage(
        leaves.select(*key, "leaf").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= documents).select("leaf")
    )
    wanted = cut_lineage(
        leaves.join(small_side(reached), "leaf")
        .groupBy(*key)
        .agg(F.collect_set(F.struct("line", "leaf", "wild")).alias("lines"))
    )
    lines = cut_lineage(keyed.join(small_side(wanted), key).select(*key, "text", "lines").mapInArrow(_parsed, _PARSED))
    # A line counts once a document; equal lines of many documents add up before the shuffle.
    counts = lines.select(*key, "id").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    same = lines.groupBy("id").agg(F.first("leaf").alias("leaf"), F.first("tokens").alias("tokens"))
    same = cut_lineage(same.join(counts, "id"))
    any_token, rare_token = (F.lit(int(t.view(np.int64))) for t in (_ANY, _RARE))
    places = same.select("id", "leaf", "k", F.posexplode("tokens").alias("i", "t")).filter(
        (F.col("i") >= DEPTH) & (F.col("t") != rare_token)
    )
    constant = cut_lineage(
        places.groupBy("leaf", "i", "t").agg(F.sum("k").alias("n")).filter(F.col("n") >= documents).drop("n")
    )
    marked = (
        places.join(small_side(constant), ["leaf", "i", "t"])
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("i", "t"))).alias("fixed"))
    )
    nothing = F.array().cast("array<struct<i:int,t:bigint>>")
    lead = F.filter(F.slice("tokens", 1, DEPTH), lambda t: ~t.isin(any_token, rare_token))
    templates = same.join(marked, "id", "left").select(
        "id", "leaf", F.size("tokens").alias("size"), F.size(lead).alias("leading"), F.coalesce("fixed", nothing).alias("fixed")
    )
    held = F.col("leading") + F.size("fixed")
    enough = (held >= F.least(F.lit(FEWEST), "size")) & (held >= F.col("size") * CONSTANT)
    solid = cut_lineage(templates.filter(enough).select("id", F.struct("leaf", "fixed").alias("template")))
    # Documents are counted, not lines: one document full of a template is no recurrence.
    held_by = lines.join(small_side(solid), "id").select(*key, "template").distinct()
    recurring = held_by.groupBy("template").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= documents)
    dropped = cut_lineage(solid.join(recurring.drop("n"), "template").select("id"))
    return cut_lineage(
        lines.join(small_side(dropped), "id").groupBy(*key).agg(F.collect_set("line").alias("lines"))
    )


def drop_templates(
    docs: DataFrame, documents: int = DOCUMENTS, columns: Sequence[str] | None = None
) -> DataFrame:
    """``row`` (``columns`` of ``docs``, all if not told) with ``n_lines, n_dropped, kept_text``.

    Lines are parted by line feeds.  A null text stays null; an empty table stays empty.
    """
    found = boilerplate_lines(docs.select("doc_id", "text"), documents)
    carried = F.struct(*(columns or ["*"])).alias("row")
    rows = docs.select(
        carried, "text", F.coalesce("doc_id", F.lit(_LAST)).alias("o"), F.xxhash64("text").alias("x")
    )
    marked = rows.join(small_side(found), ["o", "x"], "left").select("row", "text", F.col("lines").alias("drop"))
    row = rows.schema["row"].dataType.simpleString()
    return marked.mapInArrow(_keep, f"row {row}, n_lines bigint, n_dropped bigint, kept_text string")


def line_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every document."""
    found = drop_templates(docs, columns=["doc_id"])
    return found.select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


def brute_force(rows: list[tuple], documents: int = DOCUMENTS) -> dict:
    """``doc_id -> kept text`` for a few documents of different ids, with plain loops."""
    general = lambda t: "<*>" if any(c in "0123456789" for c in t) else t
    raw, having = [], {}
    for doc_id, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            tokens = [general(t.decode()) for t in line.encode().split()]
            if tokens:
                raw.append((doc_id, i, tokens))
            for j, t in enumerate(tokens[:LEADS]):
                having.setdefault((len(tokens), j, t), set()).add(doc_id)
    parsed = []
    for doc_id, i, tokens in raw:
        n, held, way = len(tokens), 0, []
        for j, t in enumerate(tokens[:LEADS]):
            if held == DEPTH:
                break
            if t != "<*>" and len(having[n, j, t]) < documents:
                t = "<rare>"
            else:
                held += 1
            way.append(t)
        if held >= min(DEPTH, n):
            parsed.append((doc_id, i, (n, *way), (*way, *tokens[len(way) :])))
    per_leaf: dict = {}
    for doc_id, _, leaf, tokens in parsed:
        per_leaf.setdefault(leaf, set()).add((doc_id, tokens))
    docs_of = {leaf: {d for d, _ in v} for leaf, v in per_leaf.items()}
    templates, counts = {}, {}
    for leaf, members in per_leaf.items():
        if len(docs_of[leaf]) < documents:
            continue
        seen: dict = {}
        for _, tokens in members:
            for i, t in enumerate(tokens):
                seen[i, t] = seen.get((i, t), 0) + 1
        for d, tokens in members:
            fixed = tuple((i, t) for i, t in enumerate(tokens) if i >= DEPTH and t != "<rare>" and seen[i, t] >= documents)
            held = len(fixed) + sum(t not in ("<*>", "<rare>") for t in tokens[:DEPTH])
            if held >= min(FEWEST, len(tokens)) and held >= CONSTANT * len(tokens):
                templates[leaf, tokens] = fixed
                counts.setdefault((leaf, fixed), set()).add(d)
    gone = {(d, i) for d, i, leaf, tokens in parsed if (leaf, tokens) in templates and len(counts[leaf, templates[leaf, tokens]]) >= documents}
    return {
        d: None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if (d, i) not in gone)
        for d, text in rows
    }
