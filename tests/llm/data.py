"""Small tables with every awkward kind of row."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside.
EXTRA = ["row", "size", "rate", "shard", "o", "x", "h", "c", "kept", "name", "w", "n_words", "lines", "copy"]


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    found = [f"w{rng.randrange(vocabulary):x}{'.' if rng.random() < 0.1 else ''}" for _ in range(n)]
    return "".join(w + ("\n" if rng.random() < 0.08 else " ") for w in found).strip()


def documents(seed: int = 3, n: int = 60) -> list[tuple]:
    """Prose, exact and near copies, shared passages, repeats, nulls, blanks and one long text."""
    rng = random.Random(seed)
    rows = []
    shared = prose(rng, 45)
    for i in range(n):
        text = prose(rng, rng.choice([1, 4, 12, 60, 150]))
        if i % 5 == 1:
            text = f"{prose(rng, 30)} {shared} {prose(rng, 30)}"
        if i % 7 == 2 and rows:
            text = rows[rng.randrange(len(rows))][1]
        if i % 11 == 3:
            words = (rows[1][1] or "").split(" ")
            words[rng.randrange(len(words))] = f"edit{i}"
            text = " ".join(words)
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "b", "b", None]), 0))
    loop = " ".join(["round", "and"] * 40)
    rows += [
        (n, None, "en", "a", None),
        (n + 1, "", None, "b", 0),
        (n + 2, " \n\t \x0b", "en", None, 4),
        (n + 3, loop, "en", "a", 0),
        (n + 4, loop, "en", "b", 0),
        (n + 5, "é漢 " * 30, "zz", "c", 0),
        (n + 6, prose(rng, 30_000), "en", "b", 0),
        (n + 7, "12 34 56 !! ??", None, "", 0),
    ]
    return rows


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def with_extras(df):
    """The table with columns named like those that operators use inside."""
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in EXTRA if c not in df.columns))
