"""Registered queries: vector functions, hashing, text source."""

from __future__ import annotations

from pyspark.sql import functions as F

from registered.common import (
    EMB,
    LEHMER,
    PARAMS,
    SIGN_PARAMS,
    Registry,
    bin_sql,
    index_sql,
    planes_sql,
    read,
    rounded,
    vectors,
)
from vicinal.functions import hashing, sparse as sp, vectors as vf
from vicinal.operators.index import bucket_keys, build_index, posting_lists
from vicinal.plans.sizing import work_path
from vicinal.sources.text_vectors import load_text_table, load_text_vectors, vector_line

R = Registry()
FAMILY, SIGNS = PARAMS.family(), SIGN_PARAMS.family()
KEY_SEED, PARTITIONS, LIST_ROWS = 11, 16, 16
MULTIPLIERS = hashing.key_multipliers(FAMILY.num_functions, KEY_SEED)


def _summary(df):
    """Numbers that pin down every component of ``v`` and its place."""
    v = F.col("v")
    weighted = F.aggregate(
        F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x
    )
    return df.select(
        "vec_id",
        F.size(v).alias("n"),
        rounded(F.get(v, F.lit(0))).alias("first"),
        rounded(F.get(v, F.size(v) - 1)).alias("last"),
        rounded(weighted).alias("weighted"),
    )


_SUMMARY = (
    "CAST(len(v) AS INTEGER) AS n, round(v[1], 6) + 0.0 AS first, round(v[len(v)], 6) + 0.0 AS last, "
    "round(list_sum(list_transform(v, lambda x, i: x * i)), 6) + 0.0 AS weighted"
)


@R.add(
    "load_text_vectors",
    f"WITH {EMB} SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, {_SUMMARY} FROM emb",
)
def load_text(spark, sf_dir):
    path = work_path(spark, "text-vectors")
    lines = vectors(spark, sf_dir).orderBy("vec_id").select(vector_line(F.col("v")).alias("value"))
    lines.write.text(path)
    return _summary(load_text_vectors(spark, path))


@R.add(
    "load_text_table",
    f"WITH {EMB} SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, {_SUMMARY} FROM emb",
)
def text_table(spark, sf_dir):
    """The same as a keyed table, partitioned by id."""
    path = work_path(spark, "text-vectors")
    lines = vectors(spark, sf_dir).orderBy("vec_id").select(vector_line(F.col("v")).alias("value"))
    lines.write.text(path)
    return _summary(load_text_table(spark, path, 8).df)


@R.add("parse_vector", f"WITH {EMB} SELECT vec_id, {_SUMMARY} FROM emb")
def parse(spark, sf_dir):
    lines = vectors(spark, sf_dir).select("vec_id", vector_line(F.col("v")).alias("value"))
    return _summary(lines.select("vec_id", vf.parse_vector(F.col("value")).alias("v")))


@R.add(
    "dense_to_sparse",
    f"""WITH {EMB}, cut AS (
      SELECT vec_id, list_transform(v, lambda x: CASE WHEN abs(x) < 0.1 THEN 0.0 ELSE x END) AS v FROM emb),
    nz AS (SELECT vec_id, v, list_filter(range(len(v)), lambda i: v[i + 1] <> 0) AS idx FROM cut)
    SELECT vec_id, CAST(len(v) AS INTEGER) AS size, coalesce(array_to_string(idx, ','), '') AS indices,
      round(coalesce(list_sum(list_transform(idx, lambda i: v[i + 1] * (i + 1))), 0), 6) + 0.0 AS weighted
    FROM nz""",
)
def sparse(spark, sf_dir):
    cut = F.transform("v", lambda x: F.when(F.abs(x) < 0.1, 0.0).otherwise(x))
    s = vectors(spark, sf_dir).select("vec_id", vf.dense_to_sparse(cut).alias("s"))
    weighted = F.aggregate(
        F.zip_with("s.vals", "s.indices", lambda x, i: x * (i + 1)),
        F.lit(0.0),
        lambda a, x: a + x,
    )
    return s.select(
        "vec_id",
        F.col("s.size").alias("size"),
        F.array_join(F.col("s.indices").cast("array<string>"), ",").alias("indices"),
        rounded(weighted).alias("weighted"),
    )


def _measure(name, f, sql):
    @R.add(name, f"WITH {EMB} SELECT vec_id, round({sql}, 6) + 0.0 AS {name} FROM emb")
    def run(spark, sf_dir):
        return vectors(spark, sf_dir).select(
            "vec_id", rounded(f(F.col("v"), F.reverse("v"))).alias(name)
        )


_DOT, _VV = "list_dot_product(v, list_reverse(v))", "list_dot_product(v, v)"
_measure("vector_dot", vf.dot, _DOT)
_measure("vector_l2", vf.l2, "list_distance(v, list_reverse(v))")
_measure("vector_cosine", vf.cosine, "list_cosine_similarity(v, list_reverse(v))")
_measure("vector_tanimoto", vf.tanimoto, f"{_DOT} / (2 * {_VV} - {_DOT})")


def _hash(name, family):
    @R.add(
        name,
        f"WITH {EMB}, {planes_sql(family)} "
        f"SELECT vec_id, fn, CAST({bin_sql(family, 'v')} AS BIGINT) AS bin FROM emb, planes",
    )
    def run(spark, sf_dir):
        signed = vectors(spark, sf_dir).select("vec_id", family.signature(F.col("v")).alias("sig"))
        return signed.select("vec_id", F.posexplode("sig").alias("fn", "bin"))


_hash("hash_pstable", FAMILY)
_hash("hash_sign", SIGNS)


@R.add(
    "group_bins",
    f"WITH {EMB}, {planes_sql(FAMILY)} SELECT vec_id, fn % {FAMILY.m} AS grp, "
    f"string_agg(CAST({bin_sql(FAMILY, 'v')} AS VARCHAR), ',' ORDER BY fn) AS bins "
    f"FROM emb, planes GROUP BY vec_id, fn % {FAMILY.m}",
)
def group_bins(spark, sf_dir):
    signed = vectors(spark, sf_dir).select("vec_id", FAMILY.signature(F.col("v")).alias("sig"))
    groups = signed.select("vec_id", F.posexplode(FAMILY.group_bins(F.col("sig"))).alias("grp", "b"))
    return groups.select("vec_id", "grp", text(F.col("b")).alias("bins"))


def text(bins):
    return F.array_join(bins.cast("array<string>"), ",")


_BINS = "array_to_string(bins, ',') AS bins"


@R.add(
    "bucket_keys", f"WITH {index_sql(FAMILY)} SELECT vec_id, table_id, {_BINS} FROM pkeys"
)
def keys(spark, sf_dir):
    found = bucket_keys(vectors(spark, sf_dir), FAMILY)
    return found.select("vec_id", "table_id", text(F.col("bins")).alias("bins"))


_MODULUS = hashing.KEY_HASH_MODULUS
_COMPACT = (
    "("
    + " + ".join(
        f"((((bins[{i + 1}] % {_MODULUS}) + {_MODULUS}) % {_MODULUS}) * {x}) % {_MODULUS}"
        for i, x in enumerate(MULTIPLIERS)
    )
    + f") % {_MODULUS}"
)


@R.add(
    "bucket_key_compact",
    f"WITH {index_sql(FAMILY)} SELECT vec_id, table_id, CAST({_COMPACT} AS BIGINT) AS key FROM pkeys",
)
def compact(spark, sf_dir):
    found = bucket_keys(vectors(spark, sf_dir), FAMILY)
    key = hashing.compact_key(F.col("bins"), MULTIPLIERS)
    return found.select("vec_id", "table_id", key.alias("key"))


@R.add(
    "bucket_partition",
    f"WITH {index_sql(FAMILY)} SELECT vec_id, table_id, "
    f"CAST(({_COMPACT}) % {PARTITIONS} AS INTEGER) AS part FROM pkeys",
)
def partition(spark, sf_dir):
    found = bucket_keys(vectors(spark, sf_dir), FAMILY)
    key = hashing.compact_key(F.col("bins"), MULTIPLIERS)
    part = hashing.bucket_partition(key, PARTITIONS)
    return found.select("vec_id", "table_id", part.alias("part"))


@R.add(
    "string_key_hash",
    """SELECT c_custkey, CAST(list_reduce(
      list_prepend(CAST(0 AS BIGINT), list_transform(string_split(c_name, ''), lambda c: CAST(unicode(c) AS BIGINT))),
      lambda h, c: (h * 31 + c) & 2147483647) AS BIGINT) AS name_hash FROM customer""",
)
def string_hash(spark, sf_dir):
    customer = read(spark, sf_dir, "customer")
    return customer.select("c_custkey", hashing.string_key_hash(F.col("c_name")).alias("name_hash"))


@R.add(
    "lsh_postings",
    f"""WITH {index_sql(FAMILY)},
    sized AS (SELECT *, count(*) OVER (PARTITION BY table_id, bins) AS n FROM pkeys),
    dealt AS (SELECT table_id, bins, vec_id, CASE WHEN n > {LIST_ROWS}
      THEN ({LEHMER.format("vec_id")}) % CAST(ceil(n / {LIST_ROWS}) AS BIGINT) ELSE 0 END AS segment FROM sized)
    SELECT table_id, {_BINS}, CAST(segment AS BIGINT) AS segment,
      string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id) AS members
    FROM dealt GROUP BY table_id, dealt.bins, segment""",
)
def postings(spark, sf_dir):
    lists = posting_lists(build_index(vectors(spark, sf_dir), PARAMS), LIST_ROWS)
    return lists.select(
        "table_id", text(F.col("bins")).alias("bins"), "segment", text(F.col("members")).alias("members")
    )


# -- sparse vectors ----------------------------------------------------------------------

SPARSE_SEED, SPARSE_FUNCTIONS, LEAST = 5, 6, 0.1
_THINNED = "thin AS (SELECT vec_id, list_transform(v, lambda x: CASE WHEN abs(x) >= 0.1 THEN x ELSE 0 END) AS v FROM emb)"


def _thinned(spark, sf_dir):
    """Vectors without their small components, kept sparse."""
    thin = F.transform("v", lambda x: F.when(F.abs(x) >= LEAST, x).otherwise(0.0))
    return vectors(spark, sf_dir).select("vec_id", vf.dense_to_sparse(thin).alias("s"))


@R.add(
    "hash_sign_sparse",
    f"""WITH {EMB}, {_THINNED},
    planes AS (SELECT f, list({sp.entry_sql(SPARSE_SEED, "f", "d")} ORDER BY d) AS a
      FROM range({SPARSE_FUNCTIONS}) AS fs(f), range(64) AS ds(d) GROUP BY f)
    SELECT vec_id, string_agg(CASE WHEN list_dot_product(v, a) > 0 THEN '1' ELSE '0' END, '' ORDER BY f) AS bins
    FROM thin, planes GROUP BY vec_id""",
)
def hash_sign_sparse(spark, sf_dir):
    bins = sp.sign_signature(F.col("s"), SPARSE_SEED, SPARSE_FUNCTIONS)
    return _thinned(spark, sf_dir).select("vec_id", F.array_join(bins.cast("array<string>"), "").alias("bins"))


@R.add(
    "vector_dot_sparse",
    f"""WITH {EMB}, {_THINNED} SELECT a.vec_id, round(list_dot_product(a.v, b.v), 6) + 0.0 AS dot,
      round(list_distance(a.v, b.v), 6) AS l2
    FROM thin a JOIN thin b ON b.vec_id = a.vec_id + 1""",
)
def vector_dot_sparse(spark, sf_dir):
    ours = _thinned(spark, sf_dir)
    next_ones = ours.select((F.col("vec_id") - 1).alias("vec_id"), F.col("s").alias("t"))
    a, b = F.col("s"), F.col("t")
    met = ours.join(next_ones, "vec_id")
    return met.select("vec_id", (rounded(sp.sparse_dot(a, b)) + 0.0).alias("dot"), rounded(sp.sparse_l2(a, b)).alias("l2"))
