"""Deal records into weighted shards by rendezvous hashing."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinal.llm.frames import hex_int, key_digest, small_side
from vicinal.plans.sizing import cut_lineage

SEED = "shard"
SHARDS = 24
#: Modulus of the mixing arithmetic, a prime; products of two residues fit a BIGINT.
PRIME = 2147483647
#: Hex digits of the key digest in each of its two numbers.
DIGITS = 7
#: Slots are numbered within this many ranges of the key hash in each shard, and in each of those within so many
#: of the text's checksum: rows of one key with different texts are dealt over these.
RANGES, CRC_RANGES = 256, 64


def shard_factors(shard: int) -> tuple[int, int, int, int]:
    """Four residues that stand for a shard; other shards do not touch them."""
    digest = hashlib.md5(f"{SEED}:{shard}".encode()).digest()
    return tuple(1 + int.from_bytes(digest[i : i + 4], "big") % (PRIME - 1) for i in range(0, 16, 4))


def _numbers(key: Column) -> tuple[Column, Column]:
    digest = key_digest(key, SEED)
    return hex_int(digest, 1, DIGITS), hex_int(digest, 1 + DIGITS, DIGITS)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key: every shard draws a cost for it and the lowest one wins.

    A draw hangs on the key and that shard only, so that one more shard takes keys into itself
    and moves no other; a shard's share is its weight.  Null keys share one shard.
    """
    x, y = _numbers(key)
    shards = F.array(
        *(
            F.struct(
                F.lit(i).alias("id"),
                *(F.lit(v).cast("bigint").alias(n) for n, v in zip("abcd", shard_factors(i))),
                F.lit(float(w)).alias("w"),
            )
            for i, w in enumerate(weights)
            if w > 0
        )
    )

    # The two numbers of the key are worked out once, ahead of the loop over the shards.
    point = F.array(F.struct(x.alias("x"), y.alias("y")))

    def best(p: Column) -> Column:
        def one(s: Column) -> Column:
            prime = F.lit(PRIME).cast("bigint")
            first = (p.x * s.a + p.y * s.b + s.c) % prime
            score = ((first * first) % prime * s.d + first) % prime
            drawn = -F.log((score + 0.5) / F.lit(float(PRIME))) / s.w
            return F.struct(drawn.alias("cost"), s.id.alias("id"))

        return F.array_min(F.transform(shards, one)).id

    return F.element_at(F.transform(point, best), 1)


def assign(
    docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, key: str = "doc_id", name: str = "shard"
) -> DataFrame:
    """``docs`` with the shard of each row, as one narrow step.

    A column of that name is replaced.  Null keys, repeated rows and empty tables need no
    special care: equal keys share a shard.
    """
    return docs.withColumn(name, rendezvous(F.col(key), weights))


def manifest(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every document.

    ``size`` is the text's UTF-8 bytes plus 8 (8 for a null text, whose checksum is null).
    ``slot`` numbers the rows of a shard from 0 without a gap, in order of ranges of the key's hash and of the
    checksum and then of the row.  Equal rows are counted first and numbered as a run, so that a hot
    row is one; the others are numbered within the ranges, whose sizes are summed up, so that a hot key with
    different texts (a null one, say) is shared by many tasks.
    """
    text = F.col("text")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    found = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    x, y = _numbers(F.col("doc_id"))
    placed = found.select(
        "*",
        x.alias("x"),
        y.alias("y"),
        rendezvous(F.col("doc_id"), (1.0,) * n_shards).alias("shard"),
        rendezvous(F.col("doc_id"), (1.0,) * (n_shards + 1)).alias("grown_shard"),
    )
    at_key = F.floor(F.col("x") * RANGES / F.lit(16**DIGITS))
    at_text = F.floor(F.coalesce("text_crc32", F.lit(0)) * CRC_RANGES / F.lit(2**32))
    placed = placed.withColumn("part", (at_key * CRC_RANGES + at_text).cast("int"))
    placed = cut_lineage(placed)
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(
        placed.groupBy("shard", "part")
        .agg(F.sum("n").alias("held"))
        .select("shard", "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    )
    inside = Window.partitionBy("shard", "part").orderBy(
        "x", "y", "doc_id", "size", "text_crc32"
    )
    first = F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    numbered = placed.withColumn("first", first).join(small_side(offsets), ["shard", "part"])
    start = F.col("offset") + F.col("first")
    slots = F.explode(F.sequence(start, start + F.col("n") - 1))
    return numbered.select("*", slots.alias("slot")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.col("slot").cast("bigint"),
        "grown_shard",
    )


def shard_sql(n: int, out: str) -> str:
    """CTEs ``out``: the shard of every ``(doc_id, x, y)`` of ``points``, for DuckDB."""
    table = ", ".join(f"({i}, {', '.join(map(str, shard_factors(i)))})" for i in range(n))
    return f"""{out}_f(id, a, b, c, d) AS (VALUES {table}),
{out}_t AS (SELECT p.*, id, d, (x * a + y * b + c) % {PRIME} AS t FROM points p, {out}_f),
{out} AS (SELECT key, CAST(arg_min(id, -(((t * t) % {PRIME} * d + t) % {PRIME}) * 1000 + id) AS INTEGER)
  AS shard FROM {out}_t GROUP BY key)"""


_CRC = ", ".join(
    str((lambda f: f(f, i, 4))(lambda f, c, k: c if k == 0 else f(f, (c >> 1) ^ (0xEDB88320 * (c & 1)), k - 1)))
    for i in range(16)
)

#: The same over the whole table ``documents``.  DuckDB has no CRC: it is worked out by half bytes.
SQL = f"""
WITH points AS (
  SELECT DISTINCT key, ('0x' || substr(h, 1, {DIGITS}))::BIGINT AS x,
    ('0x' || substr(h, {1 + DIGITS}, {DIGITS}))::BIGINT AS y
  FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), 'null') AS key,
    md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents)),
{shard_sql(SHARDS, "now")},
{shard_sql(SHARDS + 1, "grown")},
nibbles AS (
  SELECT doc_id, text, list_transform(string_split(hex(encode(text)), ''), lambda c: strpos('0123456789ABCDEF', c) - 1)
    AS b FROM documents),
sums AS (
  SELECT doc_id, text, CASE WHEN text IS NULL THEN NULL WHEN text = '' THEN 0 ELSE xor(4294967295::BIGINT,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(b)),
      lambda i: (b[CAST(CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END AS BIGINT)])::BIGINT)),
      lambda c, v: xor(c >> 4, [{_CRC}][1 + (xor(c, v) & 15)]::BIGINT))) END AS crc FROM nibbles)
SELECT s.doc_id, coalesce(octet_length(encode(s.text)), 0)::BIGINT + 8 AS size, crc AS text_crc32,
  'key' AS law, now.shard,
  row_number() OVER (PARTITION BY now.shard ORDER BY x * {RANGES} // {16**DIGITS},
    coalesce(crc, 0) * {CRC_RANGES} // {2**32}, x, y, s.doc_id NULLS FIRST, size, crc NULLS FIRST) - 1 AS slot,
  grown.shard AS grown_shard
FROM sums s JOIN points p ON p.key = coalesce(CAST(s.doc_id AS VARCHAR), 'null')
JOIN now ON now.key = p.key JOIN grown ON grown.key = p.key
"""
