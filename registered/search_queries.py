"""Registered queries: index, candidates, radius and nearest-neighbour search, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from registered.common import (
    DIMENSION,
    EMB,
    MEASURED,
    PARAMS,
    QRY,
    RADIUS,
    SIGN_PARAMS,
    Registry,
    candidates_sql,
    index_sql,
    keys_sql,
    moved,
    queries_of,
    read,
    rounded,
    sig_sql,
    vectors,
)
from vicinal.functions.vectors import COSINE
from vicinal.operators import search
from vicinal.operators.index import IndexParams, build_index
from vicinal.operators.keyed import KeyedTable
from vicinal.operators.probing import ROUNDS, exact_knn_search, knn_probed, perturbations
from vicinal.plans.jobs import answer_stream, answer_table, index_text_file, index_vectors
from vicinal.plans.sizing import work_path
from vicinal.sources.index_store import compact_index, delete_vectors, load_index, upsert_vectors
from vicinal.sources.messages import file_messages
from vicinal.sources.pivot_store import load_pivot_vectors, save_pivot_vectors
from vicinal.sources.text_vectors import vector_line
from vicinal.sources.vector_store import load_vectors, save_vectors
from vicinal.streaming.answers import preview, read_answers, read_rejects

R = Registry()
FAMILY = PARAMS.family()
PARTS = 4
EXACT_CLOSE = 1.1
#: Stated queries that meet all vectors: those whose id is divisible by this.
EVERY = 100
_NEAR = f"WITH {candidates_sql(FAMILY)}, {MEASURED}"


def _index(spark, sf_dir):
    return build_index(vectors(spark, sf_dir), PARAMS)


def _ids_and_distance(df):
    return df.select("query_id", "vec_id", rounded("distance").alias("distance"))


@R.add(
    "index_save_load",
    f"WITH {index_sql(FAMILY)} SELECT vec_id, table_id, array_to_string(bins, ',') AS bins, "
    "array_to_string(sig, ',') AS sig FROM pkeys JOIN psig USING (vec_id)",
)
def save_load(spark, sf_dir):
    index = index_vectors(vectors(spark, sf_dir), PARAMS, work_path(spark, "index"), PARTS)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return index.postings.select("vec_id", "table_id", text("bins"), text("sig"))


@R.add("lsh_candidates", f"WITH {candidates_sql(FAMILY)} SELECT query_id, vec_id FROM cand")
def lsh_candidates(spark, sf_dir):
    return search.candidates(_index(spark, sf_dir), queries_of(spark, sf_dir))


@R.add("range_search_lsh", f"{_NEAR} SELECT query_id, vec_id FROM near WHERE d < {RADIUS}")
def range_lsh(spark, sf_dir):
    near = search.radius_search(
        _index(spark, sf_dir), vectors(spark, sf_dir), queries_of(spark, sf_dir), RADIUS
    )
    return near.select("query_id", "vec_id")


@R.add(
    "range_search_lsh_dist",
    f"{_NEAR} SELECT query_id, vec_id, round(d, 6) AS distance FROM near WHERE d < {RADIUS}",
)
def range_lsh_dist(spark, sf_dir):
    return _ids_and_distance(
        search.radius_search(
            _index(spark, sf_dir), vectors(spark, sf_dir), queries_of(spark, sf_dir), RADIUS
        )
    )


@R.add(
    "range_search_saved_index",
    f"{_NEAR} SELECT query_id, vec_id, round(d, 6) AS distance FROM near WHERE d < {RADIUS}",
)
def range_saved(spark, sf_dir):
    data = vectors(spark, sf_dir)
    index = index_vectors(data, PARAMS, work_path(spark, "index"), PARTS)
    return _ids_and_distance(search.radius_search(index, data, queries_of(spark, sf_dir), RADIUS))


@R.add(
    "range_search_stored_vectors",
    f"{_NEAR} SELECT query_id, vec_id, round(d, 6) AS distance FROM near WHERE d < {RADIUS}",
)
def range_stored(spark, sf_dir):
    """Vectors laid out by id, and a saved index."""
    path = work_path(spark, "vectors")
    save_vectors(vectors(spark, sf_dir), path, PARTS)
    stored = load_vectors(spark, path)
    index = index_vectors(stored, PARAMS, work_path(spark, "index"), PARTS)
    return _ids_and_distance(search.radius_search(index, stored, queries_of(spark, sf_dir), RADIUS))


SIGN_FAMILY, COSINE_NEAR = SIGN_PARAMS.family(), 0.9
# Wide buckets, of its own: few near pairs are missed.
COSINE_PARAMS = IndexParams(DIMENSION, 4, 10, 1.0, seed=7, kind="sign")
COSINE_FAMILY = COSINE_PARAMS.family()


@R.add(
    "range_search_cosine",
    f"""WITH {candidates_sql(COSINE_FAMILY)}
    SELECT query_id, vec_id, round(list_cosine_similarity(v, qv), 6) AS distance
    FROM cand JOIN emb USING (vec_id) JOIN qry USING (query_id)
    WHERE list_cosine_similarity(v, qv) > {COSINE_NEAR}""",
)
def range_cosine(spark, sf_dir):
    """The sign family with the similarity that it approximates."""
    data = vectors(spark, sf_dir)
    index = build_index(data, COSINE_PARAMS)
    return _ids_and_distance(
        search.radius_search(index, data, queries_of(spark, sf_dir), COSINE_NEAR, metric=COSINE)
    )


@R.add(
    "knn_lsh",
    f"""{_NEAR}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM near)
    SELECT query_id, vec_id, round(d, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10""",
)
def knn(spark, sf_dir):
    near = search.knn_search(
        _index(spark, sf_dir), vectors(spark, sf_dir), queries_of(spark, sf_dir), 10
    )
    return near.select("query_id", "vec_id", rounded("distance").alias("distance"), "rank")


_CENTRE = (
    "qry AS (SELECT 0 AS query_id, list(c ORDER BY i) AS qv FROM (SELECT i, avg(v[i + 1]) AS c "
    f"FROM emb, range({DIMENSION}) AS t(i) GROUP BY i))"
)


@R.add(
    "knn_single_query",
    f"WITH {candidates_sql(FAMILY, _CENTRE)}, {MEASURED} "
    "SELECT vec_id, round(d, 6) AS distance FROM near ORDER BY d, vec_id LIMIT 10",
)
def knn_single(spark, sf_dir):
    data = vectors(spark, sf_dir)
    centre = data.agg(F.array(*[F.avg(F.get("v", F.lit(i))) for i in range(DIMENSION)]).alias("qv"))
    query = centre.select(F.lit(0).alias("query_id"), "qv")
    near = search.knn_single(_index(spark, sf_dir), data, query, 10)
    return near.select("vec_id", rounded("distance").alias("distance"))


def _exact(name, radius, inclusive):
    op = "<=" if inclusive else "<"

    @R.add(
        name,
        f"WITH {EMB}, {QRY} SELECT query_id, vec_id, round(list_distance(v, qv), 6) AS distance "
        f"FROM emb, qry WHERE list_distance(v, qv) {op} {radius}",
    )
    def run(spark, sf_dir):
        return _ids_and_distance(
            search.exact_radius_search(
                vectors(spark, sf_dir), queries_of(spark, sf_dir), radius, DIMENSION, inclusive
            )
        )


_EXACT = f"WITH {EMB}, {QRY} SELECT query_id, vec_id, round(list_distance(v, qv), 6) AS distance FROM emb, qry"


@R.add("range_search_exact_rounds", f"{_EXACT} WHERE list_distance(v, qv) <= {EXACT_CLOSE}")
def exact_rounds(spark, sf_dir):
    """More queries than one block holds: they come to the vectors in rounds."""
    data, queries = vectors(spark, sf_dir), queries_of(spark, sf_dir)
    block = 8 * DIMENSION * 300
    return _ids_and_distance(search.exact_radius_search(data, queries, EXACT_CLOSE, DIMENSION, block_bytes=block))


@R.add("range_search_pivots", f"{_EXACT} WHERE list_distance(v, qv) <= 0.5")
def exact_pivots(spark, sf_dir):
    """Vectors laid out by pivots; cells that no query reaches are passed over."""
    path = work_path(spark, "pivots")
    save_pivot_vectors(vectors(spark, sf_dir), path, pivots=16, bands=4)
    stored = load_pivot_vectors(spark, path)
    return _ids_and_distance(search.exact_radius_search(stored, queries_of(spark, sf_dir), 0.5, DIMENSION))


_PATTERNS = perturbations(PARAMS.num_functions)
_STEPS = ", ".join(
    f"({p}, {s}, {step})" for p, pattern in enumerate(_PATTERNS) for s, step in (pattern or [(0, 0)])
)


@R.add(
    "knn_lsh_probed",
    f"""WITH {index_sql(FAMILY)}, {QRY}, {sig_sql(FAMILY, "qry", "query_id", "qv", "qsig")}, {keys_sql("qsig", "query_id", "qkeys")},
    steps(pattern, slot, step) AS (VALUES {_STEPS}),
    edges AS (SELECT query_id, fn, (list_dot_product(qv, a) + b) / {PARAMS.bin_length}::DOUBLE AS place FROM qry, planes),
    crossed AS (SELECT query_id, fn, step, CASE step WHEN 0 THEN -1 WHEN -1 THEN ((place - floor(place)) * {PARAMS.bin_length}::DOUBLE) ** 2
      ELSE ((floor(place) + 1 - place) * {PARAMS.bin_length}::DOUBLE) ** 2 END AS cost FROM edges, (VALUES (-1), (0), (1)) AS t(step)),
    probes AS (SELECT query_id, table_id, pattern, sum(cost) AS cost, list(slot) AS slotted, list(steps.step) AS moved FROM steps, tables
      JOIN crossed ON fn = slots[slot + 1] - 1 AND crossed.step = steps.step GROUP BY query_id, table_id, pattern),
    tried AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cost, table_id, pattern) AS turn FROM probes
      QUALIFY turn <= {ROUNDS[-1] * len(FAMILY.tables)}),
    wanted AS (SELECT query_id, table_id, turn, list_transform(bins, lambda x, i: x + coalesce(moved[list_position(slotted, i - 1)], 0)) AS bins
      FROM tried JOIN qkeys USING (query_id, table_id)),
    met AS (SELECT query_id, vec_id, min(turn) AS turn FROM wanted JOIN pkeys USING (table_id, bins) GROUP BY query_id, vec_id),
    rounds(upto) AS (VALUES {", ".join(f"({r * len(FAMILY.tables)})" for r in ROUNDS)}),
    enough AS (SELECT query_id, min(upto) AS upto FROM (SELECT query_id, upto FROM met, rounds WHERE turn <= upto
      GROUP BY query_id, upto HAVING count(*) >= 10) GROUP BY query_id),
    cand AS (SELECT query_id, vec_id FROM met JOIN enough USING (query_id) WHERE turn <= upto
      UNION ALL SELECT query_id, vec_id FROM qry, emb WHERE query_id NOT IN (SELECT query_id FROM enough)), {MEASURED}
    SELECT query_id, vec_id, round(d, 6) AS distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS INTEGER) AS rank
    FROM near QUALIFY rank <= 10""",
)
def knn_of_all(spark, sf_dir):
    """Ten answers for every query: neighbouring buckets are probed until there are enough candidates."""
    near = knn_probed(_index(spark, sf_dir), vectors(spark, sf_dir), queries_of(spark, sf_dir), 10)
    return near.select("query_id", "vec_id", rounded("distance").alias("distance"), "rank")


@R.add(
    "knn_exact",
    f"""WITH {EMB}, {QRY} SELECT query_id, vec_id, round(list_distance(v, qv), 6) AS distance,
      CAST(row_number() OVER (PARTITION BY query_id ORDER BY list_distance(v, qv), vec_id) AS INTEGER) AS rank
    FROM emb, qry WHERE query_id % {EVERY} = 0 QUALIFY rank <= 10""",
)
def knn_exact(spark, sf_dir):
    """The stated queries against all vectors."""
    queries = queries_of(spark, sf_dir).filter(F.col("query_id") % EVERY == 0)
    near = exact_knn_search(vectors(spark, sf_dir), queries, 10, DIMENSION)
    return near.select("query_id", "vec_id", rounded("distance").alias("distance"), "rank")


_CHANGED = EMB.replace("emb AS", "stored AS") + f""", emb AS (
  SELECT vec_id, CASE WHEN vec_id % 5 = 1 AND vec_id % 14 <> 2
    THEN (SELECT qv FROM moved WHERE query_id = vec_id) ELSE v END AS v
  FROM stored WHERE vec_id % 7 <> 2 OR vec_id % 14 = 2)"""
_MOVED = QRY.replace("qry AS", "moved AS").replace("FROM emb", "FROM stored")


@R.add(
    "index_upsert_delete",
    f"WITH {_CHANGED.replace(', emb AS', ', ' + _MOVED + ', emb AS')}, {index_sql(FAMILY).removeprefix(EMB + ', ')} "
    "SELECT vec_id, table_id, array_to_string(bins, ',') AS bins FROM pkeys",
)
def index_changes(spark, sf_dir):
    """A saved index changed by segments, compacted on the way, and read as one."""
    data, path = vectors(spark, sf_dir), work_path(spark, "index")
    index_vectors(data.filter(F.col("vec_id") % 4 != 0), PARAMS, path, PARTS)
    near = data.withColumn("v", moved(F.col("v"), F.col("vec_id")))
    upsert_vectors(data.filter(F.col("vec_id") % 4 == 0), path)
    upsert_vectors(near.filter(F.col("vec_id") % 5 == 1), path)
    compact_index(spark, path)
    delete_vectors(data.filter(F.col("vec_id") % 7 == 2), path)
    upsert_vectors(data.filter(F.col("vec_id") % 14 == 2), path)
    text = F.array_join(F.col("bins").cast("array<string>"), ",").alias("bins")
    return load_index(spark, path).whole.select("vec_id", "table_id", text)


_exact("range_search_exact", RADIUS, True)
_exact("range_search_exact_strict", EXACT_CLOSE, False)


# Wide buckets, of its own: the functions and tables that the reference takes by itself.
RECALL_PARAMS = IndexParams(DIMENSION, 4, 10, 1.0, seed=7)
RECALL_FAMILY = RECALL_PARAMS.family()


@R.add(
    "lsh_recall",
    f"""WITH {candidates_sql(RECALL_FAMILY)}, {MEASURED}, found AS (SELECT query_id, count(*) AS found_count FROM near WHERE d <= {EXACT_CLOSE} GROUP BY query_id),
    truth AS (SELECT query_id, count(*) AS exact_count FROM emb, qry
      WHERE list_distance(v, qv) <= {EXACT_CLOSE} GROUP BY query_id)
    SELECT query_id, exact_count, coalesce(found_count, 0) AS found_count,
      round(coalesce(found_count, 0) / exact_count, 6) AS recall FROM truth LEFT JOIN found USING (query_id)""",
)
def lsh_recall(spark, sf_dir):
    data, queries = vectors(spark, sf_dir), queries_of(spark, sf_dir)
    index = build_index(data, RECALL_PARAMS)
    found = search.radius_search(index, data, queries, EXACT_CLOSE, inclusive=True)
    exact = search.exact_radius_search(data, queries, EXACT_CLOSE, DIMENSION)
    result = search.recall(found, exact)
    return result.withColumn("recall", rounded("recall"))


@R.add(
    "keyed_multifilter",
    f"""WITH {EMB}, {QRY}, wanted AS (SELECT query_id, query_id + s AS vec_id FROM qry, range(5) AS t(s))
    SELECT query_id, vec_id FROM wanted JOIN emb USING (vec_id) JOIN qry USING (query_id)
    WHERE list_distance(v, qv) < 1.4""",
)
def keyed_multifilter(spark, sf_dir):
    table = KeyedTable.of(vectors(spark, sf_dir), "vec_id", "v", trusted=True)
    queries = queries_of(spark, sf_dir)
    shift = F.explode(F.sequence(F.lit(0), F.lit(4)))
    wanted = queries.select("query_id", shift.alias("s")).select(
        "query_id", (F.col("query_id") + F.col("s")).alias("vec_id")
    )
    return table.multifilter(queries, wanted, 1.4, DIMENSION)


# -- streams ---------------------------------------------------------------------------


def _messages(spark, sf_dir):
    """A query message per vector, and messages no vector can be read from."""
    good = queries_of(spark, sf_dir).select(
        F.col("query_id").cast("string").alias("key"), vector_line(F.col("qv")).alias("value")
    )
    nation = read(spark, sf_dir, "nation")
    key = F.concat(F.lit("nation-"), F.col("n_nationkey"))
    region = read(spark, sf_dir, "region")
    return (
        good.union(nation.select(key, F.concat(F.col("n_name"), F.lit("   1.5"))))
        .union(nation.select(key, F.col("n_nationkey").cast("string")))
        .union(region.select(F.concat(F.lit("blank-"), F.col("r_regionkey")), F.lit("   ")))
        .union(region.select(F.concat(F.lit("empty-"), F.col("r_regionkey")), F.lit("")))
        .union(region.select(F.concat(F.lit("null-"), F.col("r_regionkey")), F.lit(None)))
    )


def _streamed(spark, sf_dir, approximate, messages=None, files=None):
    data = vectors(spark, sf_dir)
    inbox, out = work_path(spark, "messages"), work_path(spark, "answers")
    model = work_path(spark, "index")
    (_messages(spark, sf_dir) if messages is None else messages).repartition(3).write.json(inbox)
    index_vectors(data, PARAMS, model, PARTS)
    stream = answer_stream(
        file_messages(spark, inbox, files),
        data,
        model,
        RADIUS,
        approximate,
        out,
        work_path(spark, "stream-checkpoint"),
        available_now=True,
    )
    stream.awaitTermination()
    return out


def _answers(spark, out):
    answers = read_answers(spark, out)
    return answers.select("query_id", "neighbor_id", rounded("distance").alias("distance"))


_ANSWER = "CAST(query_id AS VARCHAR) AS query_id, vec_id AS neighbor_id"


@R.add(
    "stream_radius_search",
    f"{_NEAR} SELECT {_ANSWER}, round(d, 6) AS distance FROM near WHERE d < {RADIUS}",
)
def stream_lsh(spark, sf_dir):
    return _answers(spark, _streamed(spark, sf_dir, approximate=True))


@R.add(
    "stream_radius_search_exact",
    f"WITH {EMB}, {QRY} SELECT {_ANSWER}, round(list_distance(v, qv), 6) AS distance "
    f"FROM emb, qry WHERE list_distance(v, qv) <= {RADIUS}",
)
def stream_exact(spark, sf_dir):
    return _answers(spark, _streamed(spark, sf_dir, approximate=False))


@R.add(
    "stream_rejects",
    """SELECT 'nation-' || n_nationkey AS query_id, n_name || '   1.5' AS value FROM nation
    UNION ALL SELECT 'nation-' || n_nationkey, CAST(n_nationkey AS VARCHAR) FROM nation
    UNION ALL SELECT 'blank-' || r_regionkey, '   ' FROM region""",
)
def stream_rejects(spark, sf_dir):
    rejects = read_rejects(spark, _streamed(spark, sf_dir, approximate=True))
    return rejects.select("query_id", "value")


@R.add(
    "answer_table_preview",
    f"""{_NEAR}, hits AS (SELECT * FROM near WHERE d < {RADIUS}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank,
      count(*) OVER (PARTITION BY query_id) AS neighbors FROM hits)
    SELECT query_id, neighbors, CAST(rank AS INTEGER) AS rank, vec_id AS neighbor_id, round(d, 6) AS distance
    FROM ranked WHERE rank <= 5""",
)
def answers_preview(spark, sf_dir):
    """The batch form of the query job, and its preview."""
    data = vectors(spark, sf_dir)
    found = answer_table(queries_of(spark, sf_dir), data, _index(spark, sf_dir), RADIUS)
    shown = preview(found.withColumnRenamed("vec_id", "neighbor_id"))
    return shown.withColumn("distance", rounded("distance"))


@R.add(
    "index_text_job",
    f"WITH {index_sql(SIGN_FAMILY)} SELECT vec_id, table_id, array_to_string(bins, ',') AS bins FROM pkeys",
)
def index_text(spark, sf_dir):
    """The index job: a text file of vectors to a saved index, here of the sign family."""
    path = work_path(spark, "text-vectors")
    lines = vectors(spark, sf_dir).orderBy("vec_id").select(vector_line(F.col("v")).alias("value"))
    lines.write.text(path)
    p = SIGN_PARAMS
    index = index_text_file(
        spark, path, work_path(spark, "index"), p.num_tables, p.dimension, p.num_functions, p.bin_length, p.seed, PARTS, p.kind
    )
    text = F.array_join(F.col("bins").cast("array<string>"), ",").alias("bins")
    return index.postings.select("vec_id", "table_id", text)


_REPEATS = "range(1 + (query_id % 3)::BIGINT)"


@R.add(
    "stream_repeated_messages",
    f"""{_NEAR}, sent AS (SELECT query_id, CASE WHEN query_id % 2 = 0 THEN 'even' END AS key FROM qry, {_REPEATS})
    SELECT key AS query_id, vec_id AS neighbor_id, round(d, 6) AS distance, count(*) AS answers
    FROM sent JOIN near USING (query_id) WHERE d < {RADIUS} GROUP BY ALL""",
)
def stream_repeated(spark, sf_dir):
    """Messages sent up to three times, half of them under one key and half under none, in
    batches of one file each: all are answered as often as they were sent."""
    queries = queries_of(spark, sf_dir)
    times = F.explode(F.sequence(F.lit(0), (F.col("query_id") % 3).cast("int")))
    sent = queries.select(
        F.when(F.col("query_id") % 2 == 0, "even").alias("key"), vector_line(F.col("qv")).alias("value"), times
    ).select("key", "value")
    out = _streamed(spark, sf_dir, True, sent, files=1)
    return _answers(spark, out).groupBy("query_id", "neighbor_id", "distance").agg(F.count(F.lit(1)).alias("answers"))
