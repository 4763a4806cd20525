"""Index build: vectors -> normalised postings.

A posting says that a vector lies in a bucket.  Postings stay normalised (one row per
vector and table) because lists of a hot bucket would grow without bound; the grouped
form is available as lists of limited length (``posting_lists``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.functions.hashing import HashFamily, bucket_partition, compact_key, key_multipliers
from vicinal.plans.skew import segmented_lists

#: Seed of the multipliers that lay postings out; part of the saved format.
LAYOUT_SEED = 20161

#: Ids held by one row of the grouped form.
LIST_ROWS = 100_000


@dataclass(frozen=True)
class IndexParams:
    """Parameters of an index.  ``seed`` makes a rebuild reproducible."""

    dimension: int
    num_functions: int = 4
    num_tables: int = 10
    bin_length: float = 4.0
    seed: int = 0
    kind: str = "pstable"

    def family(self) -> HashFamily:
        return HashFamily.draw(
            self.num_functions,
            self.num_tables,
            self.dimension,
            self.bin_length,
            self.seed,
            self.kind,
        )


@dataclass(frozen=True)
class LshIndex:
    """Hash family plus postings ``(table_id, bins, vec_id, sig[, part, key])``.

    ``parts`` is the number of key partitions of a saved index (0 when not laid out);
    then ``part`` is a partition column and a query reads only the parts it names.  ``fresh`` are postings of
    vectors that were added to a saved index since; no vector is in both.  ``heavy`` holds the buckets
    that were found large when the index was saved, ``(table_id, bins, part, n)``.
    """

    params: IndexParams
    family: HashFamily = field(repr=False)
    postings: DataFrame = field(repr=False)
    parts: int = 0
    fresh: DataFrame | None = field(default=None, repr=False)
    heavy: DataFrame | None = field(default=None, repr=False)

    @property
    def layers(self) -> list[DataFrame]:
        """All postings, as the tables in which they lie."""
        return [self.postings] if self.fresh is None else [self.postings, self.fresh]

    @property
    def whole(self) -> DataFrame:
        """All postings ``(table_id, bins, vec_id, sig)``."""
        shown = [layer.select("table_id", "bins", "vec_id", "sig") for layer in self.layers]
        return shown[0] if len(shown) == 1 else shown[0].unionByName(shown[1])


def bucket_keys(
    vectors: DataFrame, family: HashFamily, id_col: str = "vec_id", v_col: str = "v", parts: int = 0
) -> DataFrame:
    """``(id, sig, table_id, bins[, part])``: one row per vector and table, no shuffle."""
    signed = vectors.select(id_col, family.signature(F.col(v_col)).alias("sig"))
    return table_keys(signed, family, parts)


def table_keys(signed: DataFrame, family: HashFamily, parts: int = 0, sig: str = "sig") -> DataFrame:
    """Add ``table_id``, ``bins`` and, for a laid-out index, ``part``: one row per table."""
    keys = family.expand_tables(signed, sig)
    return keys if not parts else keys.withColumn("part", key_part(F.col("bins"), family, parts))


def layout_key(bins: Column, family: HashFamily) -> Column:
    """One number for a bucket, by which postings are partitioned and sorted."""
    return compact_key(bins, key_multipliers(family.num_functions, LAYOUT_SEED))


def key_part(bins: Column, family: HashFamily, parts: int) -> Column:
    """Layout partition of a bucket."""
    return bucket_partition(layout_key(bins, family), parts)


def build_index(vectors: DataFrame, params: IndexParams) -> LshIndex:
    """Hash every vector of ``(vec_id, v)`` into the tables of a freshly drawn family.

    The build is one narrow stage.  ``vec_id`` must be unique.
    """
    family = params.family()
    postings = bucket_keys(vectors, family).select("table_id", "bins", "vec_id", "sig")
    return LshIndex(params, family, postings)


def posting_lists(index: LshIndex, list_rows: int = LIST_ROWS) -> DataFrame:
    """Grouped form ``(table_id, bins, segment, members)`` of the postings.

    Buckets above ``list_rows`` ids are spread over several rows, so no task ever holds
    the whole list of a hot bucket.
    """
    return segmented_lists(
        index.whole.select("table_id", "bins", "vec_id"),
        ["table_id", "bins"],
        "vec_id",
        list_rows,
        F.col("vec_id"),
    )
