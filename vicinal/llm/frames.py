"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.plans.sizing import fits_bytes

#: White space that parts words: blank, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text, in order; a null or blank text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def word_count(text: Column) -> Column:
    """Number of words as a BIGINT; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def small_side(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast when its measured bytes allow, else as it is.

    ``df`` must be cheap to read (a written table or a scan).  Without the mark Spark joins
    by sort and merge, where adaptive execution splits a hot key of the other side.
    """
    return F.broadcast(df) if fits_bytes(df) else df


def hex_int(digest: Column, start: int, digits: int) -> Column:
    """Hex digits of a digest as a BIGINT."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")


def key_digest(key: Column, seed: str) -> Column:
    """32 hex digits that depend on ``seed`` and the key only; null keys share one digest."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
