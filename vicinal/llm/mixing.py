"""Mix sources to target weights by repeating documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinal.llm.frames import hex_int, key_digest, small_side, word_count
from vicinal.plans.sizing import cut_lineage

#: Weights dealt to the sources in code point order, again and again.
WEIGHTS = (5, 2, 1)
#: No source, and so no document, is taken more often than this.
MOST = 3
SEED = "mix"


def source_rates(
    sizes: DataFrame, source: str, size: str, weights: Sequence[int] = WEIGHTS, most: int = MOST
) -> DataFrame:
    """``mix_source, source_size, target, rate`` of every source of ``sizes``.

    The targets share the total size by weight.  A target stops at ``most`` times its
    source's size and the excess is shared among the others by weight, until none is above:
    that is ``least(most * size, level * weight)`` with one level for all.  With the sources
    sorted by how early they stop, the level if exactly the first ``i`` stop is
    ``(total - their stops) / (weights of the rest)``; it rises while stopping one more is
    right and falls after that, so that the level looked for is the largest.

    Documents are summed per source first; what follows sees one row a source.  A source
    without words gets the target and the rate 0.
    """
    by_source = sizes.groupBy(F.col(source).alias("mix_source")).agg(
        F.sum(size).cast("bigint").alias("source_size")
    )
    order = Window.orderBy(F.col("mix_source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(int(w)).cast("bigint") for w in weights)), turn + 1)
    early = Window.orderBy(
        F.col("source_size") / F.col("weight"), F.col("mix_source").asc_nulls_last()
    ).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    so_far = lambda c: F.coalesce(F.sum(c).over(early), F.lit(0))
    level = (F.sum("source_size").over(everything) - so_far(F.col("source_size") * most)) / (
        F.sum("weight").over(everything) - so_far(F.col("weight"))
    )
    levels = by_source.withColumn("weight", weight).withColumn("level", level)
    target = F.least(
        (F.col("source_size") * most).cast("double"),
        F.max("level").over(everything) * F.col("weight"),
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return levels.withColumn("target", target).select(
        "mix_source", "source_size", "target", rate.alias("rate")
    )


def copies(key: Column, rate: Column, seed: str = SEED) -> Column:
    """How often a document is taken: the whole part of its rate, and once more with the
    fraction's probability.  The draw hangs on seed and key alone, so that reruns agree."""
    draw = hex_int(key_digest(key, seed), 1, 8) / F.lit(float(16**8))
    whole = F.floor(rate)
    return whole + F.when(draw < rate - whole, 1).otherwise(0)


def with_rates(docs: DataFrame, source: str, rates: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs``) beside its source's numbers."""
    rows = docs.select(F.struct("*").alias("row"))
    # Rates are few against documents: a hot source meets them in place, or is split by
    # Spark where they are too many to broadcast.
    return rows.join(small_side(rates), F.col(f"row.{source}").eqNullSafe(F.col("mix_source")))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    seed: str = SEED,
) -> DataFrame:
    """The mixed corpus: every document as often as it is taken, with its own columns.

    Sizes are words.  A null or blank text has size 0 and follows its source's rate.  A null
    source is a source.  Rows with one ``doc_id`` (or a null one) share the draw.  An empty
    table stays empty.  Other columns are kept, whatever their names.
    """
    sizes = docs.select(
        F.col(source).alias("source"), word_count(F.col(text)).alias("size")
    )
    rates = cut_lineage(source_rates(sizes, "source", "size", weights, most))
    taken = copies(F.col(f"row.{doc_id}"), F.col("rate"), seed).cast("int")
    again = with_rates(docs, source, rates).select("row", F.explode(F.array_repeat(F.lit(0), taken)))
    return again.select("row.*")


def mix_report(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = SEED
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document, taken or not."""
    sized = cut_lineage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    rates = cut_lineage(source_rates(sized, "source", "size", weights, most))
    taken = copies(F.col("row.doc_id"), F.col("rate"), seed)
    return with_rates(sized, "source", rates).select(
        "row.doc_id",
        "row.size",
        "source_size",
        "target",
        (taken * F.col("row.size")).cast("bigint").alias("taken"),
    )


#: The same over the whole table ``documents``, for DuckDB.
SQL = rf"""
WITH sized AS (
  SELECT doc_id, source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [{", ".join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1)
    % {len(WEIGHTS)}] AS weight FROM by_source),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum({MOST} * source_size) OVER early, 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER early, 0))::DOUBLE AS level
  FROM weighed
  WINDOW early AS (ORDER BY source_size / weight, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
    least(({MOST} * source_size)::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN
    ('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8))::BIGINT
      / {16**8}::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source
"""
