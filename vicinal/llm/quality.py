"""Quality rules whose thresholds follow each language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinal.llm.frames import WORD, small_side, words
from vicinal.plans.sizing import cut_lineage

#: Fixed values of the base rule: fewest words, most repeated words in a hundred.
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = "[#*$%&|<>]"
#: Documents of its language that every (language, source) group is blended with.
PRIOR = 50
#: A fence lies this many times the distance of two quantiles beyond the outer one.
FENCE = 3
#: Significant bits that a sketch keeps of a value: a relative error of at most 1/32.
BITS = 6
#: Adaptive measures: (name, numerator, denominator, scale, slack of the fence, inner and outer percentile, lower
#: one).  Rates are 0 in most documents, so that their fences follow the median and the highest tenth; the slack is
#: a few occurrences in a short document.
MEASURES = (
    ("symbol_rate", "n_symbols", "word_chars", 1000, 10, 50, 90, None),
    ("repeat_rate", "n_repeat_words", "n_words", 1000, 150, 50, 90, None),
    ("dup_line_rate", "n_dup_lines", "n_words", 1000, 10, 50, 90, None),
    ("word_length", "word_chars", "n_words", 100, 150, 25, 75, 25),
)
PERCENTILES = sorted({p for m in MEASURES for p in m[5:] if p is not None})


def repeated_words(w: Column) -> Column:
    """Words of ``w`` in a 3-word window that the text holds twice or more.

    Windows are hashed to 64 bits and sorted with their places; a window repeats if a
    neighbour has its hash.  Each repeated place then adds the words that the one before has
    not covered yet.  All of it happens inside the row, in n log n steps.
    """
    n = F.size(w)
    hashed = F.transform(
        F.slice(w, 1, F.greatest(n - 2, F.lit(0))),
        lambda x, i: F.struct(
            F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")
        ),
    )
    inside = lambda s: F.filter(
        s,
        lambda x, i: x.h.eqNullSafe(F.get(s, i - 1).h) | x.h.eqNullSafe(F.get(s, i + 1).h),
    )
    # One-element arrays stand for local variables: the sorted windows, then their places.
    places = F.flatten(
        F.transform(F.array(F.sort_array(hashed)), lambda s: F.transform(inside(s), lambda x: x.i))
    )
    covered = F.transform(
        F.array(F.sort_array(places)),
        lambda p: F.aggregate(
            p,
            F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(-3).alias("last")),
            lambda a, i: F.struct(
                (a["sum"] + F.least(F.lit(3), i - a["last"])).alias("sum"), i.alias("last")
            ),
            lambda a: a["sum"],
        ),
    )
    return F.element_at(covered, 1)


def base_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``) beside the base counts of its whole text.

    A null or blank text has no words and only zeros.
    """
    t = F.coalesce(F.col(f"row.{text}"), F.lit(""))
    split = docs.select(F.struct("*").alias("row")).select(
        "row",
        words(t).alias("w"),
        F.filter(F.split(t, "\n"), lambda line: line.rlike(WORD)).alias("lines"),
    )
    return split.select(
        "row",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
    ).withColumn(
        "base_failed",
        (F.col("n_words") < LEAST_WORDS)
        | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED),
    )


def measure(numerator: str, denominator: str, scale: int) -> Column:
    """A ratio as a whole number of 1/``scale``."""
    return F.floor(F.col(numerator) * scale / F.greatest(F.col(denominator), F.lit(1)))


def bucket(v: Column) -> Column:
    """The sketch bucket of a non-negative BIGINT: its leading ``BITS`` bits, the rest zero."""
    drop = F.greatest(F.length(F.bin(v)) - BITS, F.lit(0))
    unit = F.pow(F.lit(2.0), drop).cast("bigint")
    return F.floor(v / unit) * unit


def sketches(measured: DataFrame, lang: str, source: str) -> DataFrame:
    """``lang, source, name, bucket, n``: one sketch per group and measure.

    A sketch is a count per bucket.  Its size is bounded by the buckets (a few hundred), not
    by the rows; adding counts merges two of them exactly, in any order, which is what the
    partial aggregation does.
    """
    pairs = F.array(
        *(
            F.struct(F.lit(n).alias("name"), bucket(measure(a, b, k)).alias("bucket"))
            for n, a, b, k, *_ in MEASURES
        )
    )
    sound = measured.filter(~F.col("base_failed")).select(
        F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(pairs).alias("p")
    )
    return sound.groupBy("lang", "source", "p.name", "p.bucket").agg(F.count(F.lit(1)).alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """``t_lang, t_source`` and the lower and upper fence of each measure.

    A group's sketch is merged with its language's, weighed down to ``PRIOR`` documents, so
    that small groups lean on their language and large ones stand alone, without a switch.
    A fence lies ``FENCE`` times the distance of two quantiles and a small slack beyond the outer one, so that
    a group of ordinary documents loses few, whatever its level is.
    """
    sketch = cut_lineage(sketch)
    wide = "decimal(38,0)"
    by_lang = sketch.groupBy("lang", "name", "bucket").agg(F.sum("n").alias("n_lang"))
    lang_total = by_lang.groupBy("lang", "name").agg(F.sum("n_lang").alias("of_lang"))
    groups = sketch.groupBy("lang", "source", "name").agg(F.sum("n").alias("of_group"))
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in ("lang", "name")]
    prior = (
        groups.alias("g")
        .join(by_lang.alias("b"), same("g", "b"))
        .select(
            *(F.col(f"g.{c}") for c in ("lang", "source", "name")),
            "b.bucket",
            (F.col("n_lang").cast(wide) * PRIOR).cast(wide).alias("weight"),
        )
    )
    counted = (
        sketch.alias("k")
        .join(lang_total.alias("t"), same("k", "t"))
        .select("k.lang", "k.source", "k.name", "k.bucket", (F.col("n").cast(wide) * F.col("of_lang")).cast(wide).alias("weight"))
    )
    blended = prior.unionByName(counted).groupBy("lang", "source", "name", "bucket").agg(
        F.sum("weight").cast(wide).alias("weight")
    )
    group = Window.partitionBy("lang", "source", "name")
    running = F.sum("weight").over(group.orderBy("bucket"))
    ranked = blended.select(
        "*", running.cast(wide).alias("up_to"), F.sum("weight").over(group).cast(wide).alias("whole")
    )
    quantile = lambda p: F.min(F.when(F.col("up_to") * 100 >= F.col("whole") * p, F.col("bucket")))
    quantiles = ranked.groupBy("lang", "source", "name").agg(*(quantile(p).alias(f"p{p}") for p in PERCENTILES))
    fences = []
    for name, _, _, _, slack, inner, outer, below in MEASURES:
        mine = F.col("name") == name
        reach = (F.col(f"p{outer}") - F.col(f"p{inner}")) * FENCE + slack
        low = F.lit(-1) if below is None else F.col(f"p{below}") - reach
        fences.append(F.max(F.when(mine, low)).cast("bigint").alias(f"{name}_low"))
        fences.append(F.max(F.when(mine, F.col(f"p{outer}") + reach)).cast("bigint").alias(f"{name}_high"))
    return quantiles.groupBy(F.col("lang").alias("t_lang"), F.col("source").alias("t_source")).agg(*fences)


def judged(measured: DataFrame, lang: str, source: str) -> DataFrame:
    """``measured`` (a written table) with ``kept``: the base rule and all fences hold."""
    limits = cut_lineage(thresholds(sketches(measured, lang, source)))
    # A hot source meets its thresholds in place; where they are too many to broadcast, Spark
    # splits it.  A group without sound documents has none, and loses all its rows anyway.
    both = measured.join(
        small_side(limits),
        F.col(lang).eqNullSafe(F.col("t_lang")) & F.col(source).eqNullSafe(F.col("t_source")),
        "left",
    )
    held = ~F.col("base_failed")
    for name, a, b, k, *_ in MEASURES:
        held &= measure(a, b, k).between(F.col(f"{name}_low"), F.col(f"{name}_high"))
    return both.withColumn("kept", F.coalesce(held, F.lit(False))).drop(*limits.columns)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_filter(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """The rows of ``docs`` that pass the base rule and their group's thresholds.

    A null or blank text fails.  A null language or source is a group of its own.  Repeated
    rows are judged alike and each is kept.  Other columns are kept, whatever their names.
    """
    measured = cut_lineage(base_measures(docs, text))
    return judged(measured, f"row.{lang}", f"row.{source}").filter("kept").select("row.*")


def quality_report(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed`` and ``kept`` of every document."""
    counted = base_measures(docs.select("doc_id", "text", "lang", "source"))
    measured = cut_lineage(
        counted.select("row.doc_id", "row.lang", "row.source", *COUNTS, "base_failed")
    )
    return judged(measured, "lang", "source").select("doc_id", *COUNTS, "base_failed", "kept")


def _measured_sql() -> str:
    return ", ".join(
        f"CAST({a} * {k} // greatest({b}, 1) AS BIGINT) AS {n}" for n, a, b, k, *_ in MEASURES
    )


def _held_sql() -> str:
    found = []
    for name, _, _, _, slack, inner, outer, below in MEASURES:
        reach = f"({FENCE} * (p{outer} - p{inner}) + {slack})"
        low = "-1" if below is None else f"p{below} - {reach}"
        found.append(
            f"max(CASE WHEN name = '{name}' THEN CASE WHEN {name} BETWEEN {low} AND p{outer} + {reach} THEN 1 ELSE 0 END END)"
        )
    return " AND ".join(f"{x} = 1" for x in found)


#: The same over the whole table ``documents``, for DuckDB.
SQL = rf"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source,
    coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT r, i, x, count(*) OVER (PARTITION BY r, x) AS n
  FROM (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1),
    lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x FROM split)),
covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM windows, range(3) AS o(k) WHERE n > 1 GROUP BY r),
base AS (
  SELECT split.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '{SYMBOLS}')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM split LEFT JOIN covered USING (r)),
failed AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, {_measured_sql()}
  FROM base),
sound AS (UNPIVOT (SELECT lang, source, {", ".join(m[0] for m in MEASURES)} FROM failed WHERE NOT base_failed)
  ON {", ".join(m[0] for m in MEASURES)} INTO NAME name VALUE v),
sketch AS (
  SELECT lang, source, name, v // (1::BIGINT << greatest(length(bin(v)) - {BITS}, 0)::INT)
    * (1::BIGINT << greatest(length(bin(v)) - {BITS}, 0)::INT) AS bucket, count(*) AS n
  FROM sound GROUP BY ALL),
by_lang AS (SELECT lang, name, bucket, sum(n) AS n FROM sketch GROUP BY ALL),
of_lang AS (SELECT lang, name, sum(n) AS n FROM sketch GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source, name FROM sketch),
blended AS (
  SELECT lang, source, name, bucket, sum(weight)::HUGEINT AS weight FROM (
    SELECT g.lang, g.source, g.name, b.bucket, b.n * {PRIOR} AS weight
    FROM groups g JOIN by_lang b ON g.name = b.name AND g.lang IS NOT DISTINCT FROM b.lang
    UNION ALL
    SELECT s.lang, s.source, s.name, s.bucket, s.n * t.n
    FROM sketch s JOIN of_lang t ON s.name = t.name AND s.lang IS NOT DISTINCT FROM t.lang)
  GROUP BY ALL),
ranked AS (
  SELECT *, sum(weight) OVER (PARTITION BY lang, source, name ORDER BY bucket) AS up_to,
    sum(weight) OVER (PARTITION BY lang, source, name) AS whole FROM blended),
quantiles AS (
  SELECT lang, source, name, {", ".join(f"min(bucket) FILTER (100 * up_to >= {p} * whole) AS p{p}" for p in PERCENTILES)}
  FROM ranked GROUP BY ALL),
held AS (
  SELECT r, {_held_sql()} AS held
  FROM failed f JOIN quantiles q ON f.lang IS NOT DISTINCT FROM q.lang AND f.source IS NOT DISTINCT FROM q.source
  GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(held, FALSE) AS kept
FROM failed LEFT JOIN held USING (r)
"""
