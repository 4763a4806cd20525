from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from registered import search_queries
from vicinal.functions.vectors import COSINE, L2
from vicinal.operators import search
from vicinal.operators.index import IndexParams, build_index, posting_lists
from vicinal.plans.jobs import answer_table, index_vectors
from vicinal.sources.vector_store import buckets_of, load_vectors, save_vectors
from vicinal.sources.index_store import METADATA_SCHEMA, load_index, read_records, save_index

DIM, N, M = 8, 300, 60
PARAMS = IndexParams(DIM, num_functions=4, num_tables=10, bin_length=2.0, seed=3)

# Small limits send the same data through the plans meant for big inputs.
BIG = {"broadcast_rows": 0, "salt_cap": 20}


def frame(spark, ids, x, id_col, v_col):
    rows = [(i, [float(c) for c in v]) for i, v in zip(ids, x)]
    return spark.createDataFrame(rows, f"{id_col} BIGINT, {v_col} ARRAY<DOUBLE>")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((N, DIM))
    x[: N // 3] = x[0] + rng.standard_normal((N // 3, DIM)) * 1e-3  # one hot bucket
    q = rng.standard_normal((M, DIM))
    q[: M // 3] = x[0]
    return x, q


@pytest.fixture(scope="module")
def tables(spark, data):
    x, q = data
    vectors = frame(spark, range(N), x, "vec_id", "v").cache()
    queries = frame(spark, range(1000, 1000 + M), q, "query_id", "qv").cache()
    return vectors, queries


def true_candidates(x, q, params=PARAMS):
    """Pairs for which at least two groups of functions agree."""
    family = params.family()
    bins = lambda y: np.floor((y @ family.a.T + family.b) / params.bin_length)
    bx, bq = bins(x), bins(q)
    agree = sum(
        (bx[:, None, g] == bq[None, :, g]).all(axis=2).astype(int)
        for g in (np.array(g) for g in family.groups)
    )
    return {(1000 + j, i) for i, j in zip(*np.nonzero(agree >= 2))}


def true_distances(x, q):
    return np.sqrt(((x[:, None] - q[None]) ** 2).sum(axis=2))


def pairs(df):
    rows = [(r["query_id"], r["vec_id"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("plan", [{}, BIG], ids=["broadcast", "salted"])
def test_candidates_are_pairs_with_two_agreeing_groups(tables, data, plan):
    vectors, queries = tables
    got = pairs(search.candidates(build_index(vectors, PARAMS), queries, **plan))
    assert got == true_candidates(*data) and len(got) > N


@pytest.mark.parametrize("num_tables, k", [(1, 2), (3, 6), (30, 4)])
def test_candidates_of_other_family_sizes(tables, data, num_tables, k):
    vectors, queries = tables
    params = IndexParams(DIM, k, num_tables, 3.0, seed=8)
    got = pairs(search.candidates(build_index(vectors, params), queries))
    assert got == true_candidates(*data, params)


@pytest.mark.parametrize("plan", [{}, BIG, {"broadcast_rows": M}], ids=["small", "salted", "mixed"])
@pytest.mark.parametrize("inclusive", [False, True])
def test_radius_search(tables, data, plan, inclusive):
    vectors, queries = tables
    x, q = data
    near = search.radius_search(build_index(vectors, PARAMS), vectors, queries, 2.5, inclusive, **plan)
    d = true_distances(x, q)
    wanted = {(j, i) for j, i in true_candidates(x, q) if d[i, j - 1000] < 2.5}
    assert pairs(near) == wanted
    assert all(r["distance"] == pytest.approx(d[r["vec_id"], r["query_id"] - 1000]) for r in near.collect())


@pytest.mark.parametrize("block_bytes, bytes_of_lists", [(8 * DIM * 30, 0), (1 << 25, 1 << 20), (8 * DIM * 60, 1 << 20)])
def test_radius_search_in_rounds_of_blocks(tables, data, monkeypatch, block_bytes, bytes_of_lists):
    monkeypatch.setattr(search, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(search, "BROADCAST_BYTES", bytes_of_lists)
    vectors, queries = tables
    x, q = data
    near = search.radius_search(build_index(vectors, PARAMS), vectors, queries, 2.5, **BIG)
    d = true_distances(x, q)
    wanted = {(j, i): d[i, j - 1000] for j, i in true_candidates(x, q) if d[i, j - 1000] < 2.5}
    got = {(r["query_id"], r["vec_id"]): r["distance"] for r in near.collect()}
    assert got.keys() == wanted.keys()
    assert all(got[p] == pytest.approx(wanted[p]) for p in wanted)


def test_radius_is_strict_here_and_inclusive_in_the_exact_scan(spark):
    vectors = frame(spark, [1, 2], [[0.0, 0.0], [3.0, 4.0]], "vec_id", "v")
    query = frame(spark, [9], [[0.0, 0.0]], "query_id", "qv")
    index = build_index(vectors, IndexParams(2, 2, 1, 1000.0, seed=1))
    assert pairs(search.radius_search(index, vectors, query, 5.0)) == {(9, 1)}
    assert pairs(search.radius_search(index, vectors, query, 5.0, inclusive=True)) == {(9, 1), (9, 2)}
    assert pairs(search.exact_radius_search(vectors, query, 5.0, 2)) == {(9, 1), (9, 2)}
    assert pairs(search.exact_radius_search(vectors, query, 5.0, 2, inclusive=False)) == {(9, 1)}


@pytest.mark.parametrize("plan", [{}, BIG], ids=["broadcast", "salted"])
def test_knn(tables, data, plan):
    vectors, queries = tables
    x, q = data
    got = defaultdict(list)
    for r in search.knn_search(build_index(vectors, PARAMS), vectors, queries, 7, **plan).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"]))
    d, wanted = true_distances(x, q), defaultdict(list)
    for j, i in true_candidates(x, q):
        wanted[j].append(i)
    for j, ids in wanted.items():
        nearest = sorted(ids, key=lambda i: (d[i, j - 1000], i))[:7]
        assert [i for _, i in sorted(got[j])] == nearest
    assert set(got) == set(wanted)


def test_knn_limits_per_task_before_the_shuffle(tables):
    vectors, queries = tables
    near = search.knn_search(build_index(vectors, PARAMS), vectors, queries, 7)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_small_query_plan_shuffles_id_pairs_only(tables):
    vectors, queries = tables
    near = search.radius_search(build_index(vectors, PARAMS), vectors, queries, 2.5)
    plan = near._jdf.queryExecution().executedPlan().toString()
    # The ids were worked out ahead; the vectors themselves stay where they are.
    assert "Exchange hashpartitioning" not in plan
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_batch_equals_single_queries(spark, tables, data):
    vectors, queries = tables
    index = build_index(vectors, PARAMS)
    batch = defaultdict(set)
    for j, i in pairs(search.radius_search(index, vectors, queries, 2.5)):
        batch[j].add((j, i))
    for j in (1000, 1030, 1059):
        one = queries.filter(F.col("query_id") == j)
        assert pairs(search.radius_search(index, vectors, one, 2.5)) == batch[j]
        nearest = search.knn_single(index, vectors, one, 5).collect()
        many = search.knn_search(index, vectors, one, 5).orderBy("rank").collect()
        assert [r["vec_id"] for r in nearest] == [r["vec_id"] for r in many]


def test_own_metric_ordering(tables, data):
    vectors, queries = tables
    x, q = data
    near = search.radius_search(build_index(vectors, PARAMS), vectors, queries, 0.9, metric=COSINE)
    cos = (x @ q.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1))
    assert pairs(near) == {(j, i) for j, i in true_candidates(x, q) if cos[i, j - 1000] > 0.9}


@pytest.mark.parametrize("block_bytes", [1 << 25, 8 * DIM * 16], ids=["one block", "grid"])
@pytest.mark.parametrize("metric, radius", [(L2, 2.5), (COSINE, 0.6)], ids=["l2", "cosine"])
def test_exact_scan(tables, data, block_bytes, metric, radius):
    vectors, queries = tables
    x, q = data
    got = pairs(
        search.exact_radius_search(vectors, queries, radius, DIM, True, metric, block_bytes)
    )
    cos = (x @ q.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1))
    hit = true_distances(x, q) <= radius if metric is L2 else cos >= radius
    assert got == {(1000 + j, i) for i, j in zip(*np.nonzero(hit))}


def test_lsh_answers_are_exact_answers(tables):
    vectors, queries = tables
    found = search.radius_search(build_index(vectors, PARAMS), vectors, queries, 2.5, inclusive=True)
    exact = search.exact_radius_search(vectors, queries, 2.5, DIM)
    assert pairs(found) <= pairs(exact)
    for r in search.recall(found, exact).collect():
        assert 0 <= r["found_count"] <= r["exact_count"]
        assert r["recall"] == r["found_count"] / r["exact_count"]


def test_empty_inputs(spark, tables):
    vectors, queries = tables
    none = queries.filter("query_id < 0")
    index = build_index(vectors, PARAMS)
    assert pairs(search.radius_search(index, vectors, none, 2.5)) == set()
    assert pairs(search.exact_radius_search(vectors, none, 2.5, DIM)) == set()
    empty = vectors.filter("vec_id < 0")
    assert pairs(search.radius_search(build_index(empty, PARAMS), empty, queries, 2.5)) == set()


def test_multifilter_drops_absent_ids(spark, tables, data):
    vectors, queries = tables
    x, q = data
    wanted = spark.createDataFrame(
        [(1000 + j, i) for j in range(M + 3) for i in (j, j + 1, 10**9)], "query_id BIGINT, vec_id BIGINT"
    )
    d = true_distances(x, q)
    expected = {(1000 + j, i) for j in range(M) for i in (j, j + 1) if d[i, j] < 2.5}
    for plan in ({}, {"broadcast_rows": 0}):
        assert pairs(search.multifilter(vectors, queries, wanted, 2.5, DIM, **plan)) == expected


def test_posting_lists_split_hot_buckets(tables, data):
    vectors, _ = tables
    index = build_index(vectors, PARAMS)
    whole = defaultdict(set)
    for r in index.postings.collect():
        whole[r["table_id"], tuple(r["bins"])].add(r["vec_id"])
    lists, segments = defaultdict(list), defaultdict(int)
    for r in posting_lists(index, 20).collect():
        lists[r["table_id"], tuple(r["bins"])] += r["members"]
        segments[r["table_id"], tuple(r["bins"])] += 1
        assert r["members"] == sorted(r["members"]) and len(r["members"]) < 60
    assert {k: set(v) for k, v in lists.items()} == whole
    assert all(len(v) == len(set(v)) for v in lists.values())
    assert max(segments.values()) >= N // 3 // 20


def test_save_load_query(spark, tables, tmp_path):
    vectors, queries = tables
    built = build_index(vectors, PARAMS)
    path = f"file://{tmp_path}/index"
    save_index(built, path, parts=4)
    loaded = load_index(spark, path)
    key = lambda r: (r["table_id"], r["vec_id"], tuple(r["bins"]), tuple(r["sig"]))
    assert sorted(map(key, loaded.postings.collect())) == sorted(map(key, built.postings.collect()))
    assert (loaded.family.a == built.family.a).all() and (loaded.family.b == built.family.b).all()
    assert loaded.params == built.params
    for plan in ({}, BIG):
        want = pairs(search.radius_search(built, vectors, queries, 2.5))
        assert pairs(search.radius_search(loaded, vectors, queries, 2.5, **plan)) == want
        assert pairs(search.candidates(loaded, queries, **plan)) == pairs(search.candidates(built, queries))
    assert pairs(answer_table(queries, vectors, loaded, 2.5)) == want
    exact = pairs(search.exact_radius_search(vectors, queries, 2.5, DIM))
    assert pairs(answer_table(queries, vectors, loaded, 2.5, approximate=False)) == exact


def test_saved_index_prunes_partitions(spark, tables, tmp_path):
    vectors, queries = tables
    index = index_vectors(vectors, PARAMS, f"file://{tmp_path}/index", parts=8)
    one = spark.createDataFrame(queries.filter("query_id = 1059").collect(), queries.schema)
    found = search.candidates(index, one)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    assert len(found.collect()) == len([p for p in pairs(search.candidates(index, queries)) if p[0] == 1059])


def test_laid_out_vectors_are_read_by_part(spark, tables, tmp_path):
    vectors, queries = tables
    save_vectors(vectors, f"file://{tmp_path}/vectors", parts=8)
    stored = load_vectors(spark, f"file://{tmp_path}/vectors")
    assert stored.count() == N and buckets_of(stored) == 8
    index = build_index(vectors, PARAMS)
    want = pairs(search.radius_search(index, vectors, queries, 2.5))
    for limit in (N - 1, 0):
        near = search.radius_search(index, stored, queries, 2.5, broadcast_rows=limit)
        assert pairs(near) == want
    one = spark.createDataFrame(queries.filter("query_id = 1000").collect(), queries.schema)
    few = search.radius_search(index, stored, one, 2.5, broadcast_rows=N - 1)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "PushedFilters: [" in plan and "In(vec_id" in plan.replace("In(`vec_id`", "In(vec_id")
    assert pairs(few) == {p for p in want if p[0] == 1000}


def test_wanted_vectors_are_sent_to_their_buckets(spark, tables, tmp_path, monkeypatch):
    """Many candidates: the table in buckets stays in place."""
    vectors, queries = tables
    save_vectors(vectors, f"file://{tmp_path}/vectors", parts=8)
    stored = load_vectors(spark, f"file://{tmp_path}/vectors")
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(search, "LITERAL_IDS", 0)
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(N - 1).cast("bigint"))
    lists = queries.select(F.explode(every).alias("vec_id"), F.array("query_id").alias("asked"))
    met = search._asked_vectors(lists, stored, True)
    lines = met._jdf.queryExecution().executedPlan().toString().splitlines()
    (scan,) = [i for i, line in enumerate(lines) if "Bucketed: true" in line]
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    above = [line for i, line in enumerate(lines[:scan]) if all(depth(line) < depth(x) for x in lines[i + 1 : scan + 1])]
    assert not any("Exchange" in line for line in above)
    assert met.count() == N


def test_few_ids_open_few_row_groups(spark, tmp_path):
    """Ten ids of 100,000: rows that the scan gives out, against those of the table."""
    vectors = spark.range(100_000).select(F.col("id").alias("vec_id"), F.array(F.col("id") * 1.0).alias("v"))
    spark.conf.set("parquet.block.size", str(1 << 16))
    try:
        save_vectors(vectors, f"file://{tmp_path}/vectors", parts=4)
    finally:
        spark.conf.unset("parquet.block.size")
    stored = load_vectors(spark, f"file://{tmp_path}/vectors")
    ids = list(range(50_000, 50_010))
    found = stored.filter(F.col("vec_id").isin(ids))
    assert sorted(r.vec_id for r in found.collect()) == ids
    plan = found._jdf.queryExecution().executedPlan()
    scan = plan
    while not scan.getClass().getSimpleName().startswith("FileSourceScan"):
        scan = scan.children().head()
    assert scan.metrics().apply("numOutputRows").value() < 20_000


def test_load_checks_the_metadata(spark, tables, tmp_path):
    vectors, _ = tables
    path = f"file://{tmp_path}/index"
    save_index(build_index(vectors, PARAMS), path, parts=2)
    read = read_records(spark, f"{path}/metadata", METADATA_SCHEMA)
    good = spark.createDataFrame(read.collect(), METADATA_SCHEMA)
    for column, value, message in [
        ("class", "other", "not vicinal"),
        ("version", "9", "not vicinal"),
        ("dimension", 0, "dimension must not be zero"),
        ("num_tables", 40, "do not match"),
    ]:
        changed = good.withColumn(column, F.lit(value))
        changed.write.mode("overwrite").json(f"{path}/metadata")
        with pytest.raises(ValueError, match=message):
            load_index(spark, path)


@pytest.mark.parametrize("step", ["postings", "functions", "metadata"])
def test_a_stopped_save_leaves_the_index_before_it(spark, tables, tmp_path, monkeypatch, step):
    vectors, _ = tables
    path = f"file://{tmp_path}/index"
    save_index(build_index(vectors, PARAMS), path, parts=2)
    key = lambda r: (r["table_id"], r["vec_id"], tuple(r["bins"]))
    before = sorted(map(key, load_index(spark, path).postings.collect()))
    writer = type(vectors.write)
    for method in ("parquet", "json"):
        real = getattr(writer, method)

        def stopping(self, target, *args, real=real, **kwargs):
            if f"/{step}" in target:
                raise KeyboardInterrupt(step)
            return real(self, target, *args, **kwargs)

        monkeypatch.setattr(writer, method, stopping)
    other = IndexParams(DIM, PARAMS.num_functions, PARAMS.num_tables, PARAMS.bin_length, seed=99)
    with pytest.raises(KeyboardInterrupt):
        save_index(build_index(vectors, other), path, parts=4)
    monkeypatch.undo()
    loaded = load_index(spark, path)
    assert loaded.params == PARAMS and sorted(map(key, loaded.postings.collect())) == before
    save_index(build_index(vectors, other), path, parts=4)
    assert load_index(spark, path).params == other
    with pytest.raises(ValueError, match="ids of type"):
        load_index(spark, path, "STRING")


def test_vectors_saved_again_with_other_parts(spark, tables, tmp_path):
    vectors, _ = tables
    path = f"file://{tmp_path}/vectors"
    for parts in (3, 8):
        save_vectors(vectors, path, parts)
        assert buckets_of(load_vectors(spark, path)) == parts
        assert load_vectors(spark, path).count() == N


def test_pairs_whose_squares_overflow_are_found(spark):
    rows = [(1, [1e160, 0.0]), (2, [-1e160, 0.0]), (3, [0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id BIGINT, v ARRAY<DOUBLE>")
    queries = vectors.withColumnsRenamed({"vec_id": "query_id", "v": "qv"})
    for block in (search.BLOCK_BYTES, 16):
        found = search.exact_radius_search(vectors, queries, 1.0, 2, block_bytes=block)
        assert pairs(found) == {(1, 1), (2, 2), (3, 3)}


@pytest.mark.parametrize("block", [search.BLOCK_BYTES, 16])
def test_null_ids_are_an_error_in_every_plan(spark, block):
    vectors = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "vec_id BIGINT, v ARRAY<DOUBLE>")
    queries = spark.createDataFrame([(None, [0.0, 0.0]), (7, [1.0, 0.0])], "query_id BIGINT, qv ARRAY<DOUBLE>")
    with pytest.raises(Exception, match="NULL query_id"):
        search.exact_radius_search(vectors, queries, 9.0, 2, block_bytes=block).collect()
    index = build_index(vectors, IndexParams(2, 2, 3, 1000.0, seed=1))
    with pytest.raises(Exception, match="NULL query_id"):
        search.radius_search(index, vectors, queries, 9.0, broadcast_rows=None if block > 16 else 0).collect()


def test_same_seed_same_postings(tables):
    vectors, _ = tables
    key = lambda r: (r["table_id"], r["vec_id"], tuple(r["bins"]))
    one, two = (sorted(map(key, build_index(vectors, PARAMS).postings.collect())) for _ in range(2))
    assert one == two


def test_planted_neighbours_are_found(spark, sf_dir):
    from registered.common import PARAMS as EMBEDDED
    from registered.common import queries_of
    from registered.common import vectors as stored

    vectors, queries = stored(spark, sf_dir), queries_of(spark, sf_dir)
    found = search.radius_search(build_index(vectors, EMBEDDED), vectors, queries, 0.2)
    hits = found.filter("query_id = vec_id").count()
    assert hits / queries.count() > 0.9


def _no_driver(monkeypatch, frame):
    def refused(*_):
        raise AssertionError("queries came to the driver")

    monkeypatch.setattr(type(frame), "toArrow", refused)
    monkeypatch.setattr(search, "share", refused)


@pytest.mark.parametrize("k", [None, 3], ids=["radius", "knn"])
def test_blocks_of_queries_pass_no_driver(tables, data, monkeypatch, k):
    vectors, queries = tables
    _no_driver(monkeypatch, queries)
    monkeypatch.setattr(search, "BLOCK_BYTES", 8 * DIM * 30)
    monkeypatch.setattr(search, "SLICE", 7)
    d, index = true_distances(*data), build_index(vectors, PARAMS)
    if k is None:
        near = search.radius_search(index, vectors, queries, 2.5, **BIG)
        assert pairs(near) == {(j, i) for j, i in true_candidates(*data) if d[i, j - 1000] < 2.5}
        return
    met = defaultdict(list)
    for j, i in true_candidates(*data):
        met[j].append((d[i, j - 1000], i))
    wanted = {(j, i) for j, found in met.items() for _, i in sorted(found)[:k]}
    found = pairs(search.knn_search(index, vectors, queries, k, **BIG))
    assert len(found) == len(wanted) and {j for j, _ in found} == {j for j, _ in wanted}


def test_lists_of_long_ids_are_not_broadcast(spark, tables, monkeypatch):
    """Lists are measured by the bytes of their ids."""
    vectors, _ = tables
    monkeypatch.setattr(search, "BROADCAST_BYTES", 10_000)
    ids = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(F.repeat(F.lit("x"), 200), i.cast("string")))
    met = search._asked_vectors(spark.range(50).select(F.col("id").alias("vec_id"), ids.alias("asked")), vectors, False)
    assert "BroadcastHashJoin" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 50


@pytest.mark.parametrize("metric, radius", [(L2, 2.5), (COSINE, 0.6)], ids=["l2", "cosine"])
def test_exact_grid_passes_no_driver_and_writes_no_matches(tables, data, monkeypatch, metric, radius):
    """Many blocks of either side, and more matches of a tile than are held."""
    vectors, queries = tables
    x, q = data
    _no_driver(monkeypatch, queries)
    monkeypatch.setattr(search, "BLOCK_BYTES", 8 * DIM * 40)
    monkeypatch.setattr(search, "TILE", 16)
    monkeypatch.setattr(search, "HELD_HITS", 5)
    found = search.exact_radius_search(vectors, queries, radius, DIM, True, metric, 8 * DIM * 10)
    assert not found.inputFiles() or not any("hits" in f for f in found.inputFiles())
    cos = (x @ q.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1))
    hit = true_distances(x, q) <= radius if metric is L2 else cos >= radius
    assert pairs(found) == {(1000 + j, i) for i, j in zip(*np.nonzero(hit))}


def test_cosine_search_misses_few_near_pairs(spark, sf_dir):
    data, queries = search_queries.vectors(spark, sf_dir), search_queries.queries_of(spark, sf_dir)
    exact = search.exact_radius_search(data, queries, search_queries.COSINE_NEAR, 64, False, COSINE).count()
    assert search_queries.range_cosine(spark, sf_dir).count() >= 0.99 * exact


def _embeddings(spark, tmp_path, rows=150):
    """A table of its own: crowded vectors whose ids are mostly not divisible by 100."""
    x = (np.random.default_rng(5).standard_normal((rows, 64)) * 0.11).astype(np.float32).astype(float)
    table = frame(spark, range(1, rows + 1), x, "vec_id", "v")
    table.select("vec_id", F.col("v").cast("array<float>").alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    ids = np.arange(1, rows + 1)
    return ids, x, x + 0.01 * ((ids[:, None] * 31 + np.arange(64) * 17) % 7 - 3)


def test_recall_is_told_of_every_query(spark, tmp_path):
    ids, x, q = _embeddings(spark, tmp_path)
    near = true_distances(x, q) <= search_queries.EXACT_CLOSE
    told = {r.query_id: r.exact_count for r in search_queries.lsh_recall(spark, str(tmp_path)).collect()}
    assert told == {int(i): int(n) for i, n in zip(ids, near.sum(0)) if n}
    assert len(told) == 150 and max(told.values()) > 1


def test_recall_is_that_of_wide_buckets(spark, tmp_path):
    _, x, q = _embeddings(spark, tmp_path)
    met = true_candidates(x, q, IndexParams(64, num_functions=4, num_tables=10, bin_length=1.0, seed=7))
    near = true_distances(x, q) <= search_queries.EXACT_CLOSE
    wanted = {j + 1: 0 for j in range(150)}
    for j, i in met:
        wanted[j - 1000 + 1] += bool(near[i, j - 1000])
    assert {r.query_id: r.found_count for r in search_queries.lsh_recall(spark, str(tmp_path)).collect()} == wanted


@pytest.mark.parametrize("metric, radius, inclusive", [(L2, 2.5, True), (COSINE, 0.6, False)], ids=["l2", "cosine"])
@pytest.mark.parametrize("saved", [False, True])
def test_pairs_of_wide_buckets_are_not_listed(tables, data, tmp_path, monkeypatch, metric, radius, inclusive, saved):
    """Where much of all pairs meets, both sides pass each other in blocks with their signatures."""
    vectors, queries = tables
    x, q = data
    index = build_index(vectors, PARAMS)
    if saved:
        index = index_vectors(vectors, PARAMS, str(tmp_path / "index"), 3)
    wanted = {(r.query_id, r.vec_id): r.distance for r in search.radius_search(index, vectors, queries, radius, inclusive, metric).collect()}

    def refused(*_):
        raise AssertionError("candidates were listed")

    monkeypatch.setattr(search, "candidate_lists", refused)
    monkeypatch.setattr(search, "COUNTED_QUERIES", 1)
    monkeypatch.setattr(search, "BLOCK_BYTES", 8 * DIM * 40)
    monkeypatch.setattr(search, "TILE", 16)
    monkeypatch.setattr(search, "HELD_HITS", 5)
    near = search.radius_search(index, vectors, queries, radius, inclusive, metric).collect()
    assert len(near) == len(wanted) > M
    assert {(r.query_id, r.vec_id): r.distance for r in near} == wanted
    cos = (x @ q.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1))
    hit = true_distances(x, q) <= radius if metric is L2 else cos > radius
    assert set(wanted) == {(j, i) for j, i in true_candidates(x, q) if hit[i, j - 1000]}


def test_narrow_buckets_list_their_pairs(tables, monkeypatch):
    vectors, queries = tables
    spread = queries.filter("query_id >= 1020")
    asked = search.Asked.of(spread)
    assert search._crowded(build_index(vectors, PARAMS), asked)
    narrow = IndexParams(DIM, num_functions=12, num_tables=6, bin_length=0.2, seed=3)
    assert not search._crowded(build_index(vectors, narrow), asked)


def test_cosine_screen_loses_no_pair():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 5)) * 10.0 ** rng.integers(-90, 90, (60, 1))
    x[:3] = 0
    x[3:6] = x[30:33] * (1 + 1e-15)
    for radius in (-0.2, 0.0, 0.9, 1.0):
        with np.errstate(all="ignore"):
            measure = np.array([COSINE.rows(np.broadcast_to(row, x.shape), x) for row in x])
        i, j, found = COSINE.near(x, x, radius, True)
        assert {*zip(i, j)} == {*zip(*np.nonzero(measure >= radius))}
        assert np.array_equal(found, measure[i, j])
