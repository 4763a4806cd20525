"""Changing a saved index by segments, pivots, probing, the collision model and sparse vectors."""

import json
import os
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal.functions import sparse
from vicinal.functions.vectors import COSINE, L2, dense_to_sparse
from vicinal.operators import search, tuning
from vicinal.operators.index import IndexParams, build_index
from vicinal.operators.probing import exact_knn_search, knn_probed, perturbations, probe_order
from vicinal.plans.jobs import answer_stream, index_vectors
from vicinal.sources import index_store
from vicinal.sources.index_store import (
    LiveIndex, Superseded, compact_index, delete_vectors, load_index, save_index, segments, upsert_vectors,
)
from vicinal.sources.messages import file_messages
from vicinal.sources.pivot_store import cells_of, load_pivot_vectors, save_pivot_vectors
from vicinal.streaming.answers import read_answers

DIM = 8
PARAMS = IndexParams(DIM, num_functions=4, num_tables=10, bin_length=2.0, seed=3)


def frame(spark, ids, x, id_col="vec_id", v_col="v"):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], f"{id_col} BIGINT, {v_col} ARRAY<DOUBLE>")


def pairs(df):
    return {(r.query_id, r.vec_id) for r in df.collect()}


def postings(index):
    return sorted((r.vec_id, r.table_id, tuple(r.bins), tuple(r.sig)) for r in index.whole.collect())


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names}


@pytest.fixture(scope="module")
def x():
    rng = np.random.default_rng(5)
    found = rng.standard_normal((200, DIM))
    found[:60] = found[0] + rng.standard_normal((60, DIM)) * 1e-3
    return found


# -- segments ----------------------------------------------------------------------------


def test_changes_equal_a_rebuild(spark, x, tmp_path):
    path = f"file://{tmp_path}/index"
    index_vectors(frame(spark, range(100), x[:100]), PARAMS, path, 4)
    before = files(tmp_path / "index" / "builds")
    now = dict(enumerate(x[:100]))

    def upsert(ids, v):
        now.update(zip(ids, v))
        return upsert_vectors(frame(spark, ids, v), path)

    def delete(ids):
        for i in ids:
            now.pop(i, None)
        return delete_vectors(spark.createDataFrame([(i,) for i in ids], "vec_id BIGINT"), path)

    def rebuilt():
        return build_index(frame(spark, now, now.values()), PARAMS)

    assert upsert(range(90, 140), x[150:200]) == 1
    assert delete([3, 95, 999, 3]) == 2
    assert upsert([3, 4], x[10:12]) == 3
    index = load_index(spark, path)
    assert postings(index) == postings(rebuilt())
    after = files(tmp_path / "index" / "builds")
    assert {f: t for f, t in after.items() if f in before} == before
    queries = frame(spark, range(20), x[:20] + 0.01, "query_id", "qv")
    for plan in ({}, {"broadcast_rows": 0, "salt_cap": 20}):
        assert pairs(search.candidates(index, queries, **plan)) == pairs(search.candidates(rebuilt(), queries))
    compacted = compact_index(spark, path)
    assert postings(compacted) == postings(rebuilt()) and compacted.fresh is None
    delete(range(50))
    assert postings(load_index(spark, path)) == postings(rebuilt())


def test_null_and_repeated_ids_of_changes(spark, x, tmp_path):
    path = f"file://{tmp_path}/index"
    index_vectors(frame(spark, range(20), x[:20]), PARAMS, path, 2)
    twice = frame(spark, [30, 30], [x[5], x[5]])
    upsert_vectors(twice, path)
    assert len(postings(load_index(spark, path))) == 21 * 10
    with pytest.raises(Exception, match="NULL vec_id"):
        delete_vectors(spark.createDataFrame([(None,)], "vec_id BIGINT"), path)
    upsert_vectors(twice.limit(0), path)
    assert len(postings(load_index(spark, path))) == 21 * 10


def test_a_segment_written_during_a_compaction_is_kept(spark, x, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/index"
    index_vectors(frame(spark, range(20), x[:20]), PARAMS, path, 2)
    real = index_store.save_index

    def slow(index, to, parts):
        upsert_vectors(frame(spark, [77], x[77:78]), to)  # by another writer, ahead of the publication
        real(index, to, parts)

    monkeypatch.setattr(index_store, "save_index", slow)
    index = compact_index(spark, path)
    assert {r.vec_id for r in index.whole.collect()} == {*range(20), 77}


def test_two_saves_at_once(spark, x, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/index"
    index = build_index(frame(spark, range(20), x[:20]), PARAMS)
    save_index(index, path, 2)
    monkeypatch.setattr(index_store, "next_build", lambda spark, records: (2, os.urandom(8).hex()))

    def save(n):
        try:
            save_index(build_index(frame(spark, range(n), x[:n]), PARAMS), path, 2)
            return n
        except Superseded:
            return None

    with ThreadPoolExecutor(2) as pool:
        ended = set(pool.map(save, (5, 7)))
    held = len({r.vec_id for r in load_index(spark, path).whole.collect()})
    assert held in ended and held in (5, 7)


def test_heavy_buckets_are_recorded(spark, x, tmp_path, monkeypatch):
    monkeypatch.setattr(index_store, "HEAVY_ROWS", 20)
    index = index_vectors(frame(spark, range(200), x), PARAMS, f"file://{tmp_path}/index", 2)
    counts = index.postings.groupBy("table_id", "bins").count().filter("count > 20").count()
    assert counts and index.heavy.count() == counts
    queries = frame(spark, range(100), x[:100] + 0.01, "query_id", "qv")
    plain = search.candidates(build_index(frame(spark, range(200), x), PARAMS), queries)
    large = search.candidates(index, queries, broadcast_rows=0, salt_cap=10)
    assert pairs(large) == pairs(plain)
    plan = large._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_row_groups_tell_their_buckets(spark, x, tmp_path):
    path = f"file://{tmp_path}/index"
    index = index_vectors(frame(spark, range(200), x), PARAMS, path, 1)
    keys = [r.key for r in index.postings.filter("table_id = 0").select("key").collect()]
    assert keys == sorted(keys)


def test_a_build_between_two_batches_answers_the_second(spark, x, tmp_path):
    path, inbox, out = f"file://{tmp_path}/index", tmp_path / "in", f"file://{tmp_path}/out"
    vectors = frame(spark, range(40), x[:40])
    index_vectors(vectors.filter("vec_id < 20"), PARAMS, path, 2)
    os.makedirs(inbox)
    live = {"n": 0}

    def put(name, rows):
        with open(inbox / name, "w") as f:
            for key, v in rows:
                f.write(json.dumps({"key": key, "value": "   ".join(map(repr, v))}) + "\n")

    def run():
        live["n"] += 1
        stream = answer_stream(
            file_messages(spark, f"file://{inbox}", 1), vectors, path, 0.5, True, out, f"file://{tmp_path}/cp", available_now=True
        )
        stream.awaitTermination()

    from vicinal.streaming import answers

    put("a", [("first", x[30].tolist())])
    put("b", [("second", x[30].tolist())])
    real = answers.Answerer._answer

    def then_change(self, messages, batch_id):
        real(self, messages, batch_id)
        if batch_id == 0:
            upsert_vectors(vectors.filter("vec_id >= 20"), path)
        elif batch_id == 1:
            index_vectors(vectors.filter("vec_id < 25"), PARAMS, path, 2)
            put("c", [("third", x[30].tolist())])

    answers.Answerer._answer = then_change
    try:
        run()
        run()
    finally:
        answers.Answerer._answer = real
    found = read_answers(spark, out).groupBy("query_id").agg(F.collect_set("neighbor_id").alias("ids")).collect()
    told = {r.query_id: set(r.ids) for r in found}
    by_batch = sorted(("first", "second"), key=lambda k: 30 in told.get(k, set()))
    assert 30 not in told.get(by_batch[0], set()) and 30 in told[by_batch[1]]
    assert 30 not in told.get("third", set())


def test_live_index_opens_only_what_changed(spark, x, tmp_path):
    path = f"file://{tmp_path}/index"
    index_vectors(frame(spark, range(20), x[:20]), PARAMS, path, 2)
    live = LiveIndex(spark, path)
    first = live.current()
    assert live.current() is first
    upsert_vectors(frame(spark, [50], x[50:51]), path)
    assert live.current() is not first and live.current().fresh is not None
    assert len(segments(spark, path, index_store._current(spark, path)["build"])) == 1


# -- pivots ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def clusters():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, DIM)) * 20
    return np.concatenate([c + rng.standard_normal((100, DIM)) for c in centres])


@pytest.mark.parametrize("block_bytes", [search.BLOCK_BYTES, 8 * DIM * 30])
@pytest.mark.parametrize("inclusive", [True, False])
def test_pivots_change_no_answer(spark, clusters, tmp_path, block_bytes, inclusive):
    path = f"file://{tmp_path}/pivots"
    vectors = frame(spark, range(2000), clusters)
    save_pivot_vectors(vectors, path, pivots=16, bands=4, sample=500)
    stored = load_pivot_vectors(spark, path)
    queries = frame(spark, range(200), clusters[::10] + 0.05, "query_id", "qv")
    radius = float(np.linalg.norm(clusters[0] - clusters[10] - 0.05))  # a distance that occurs
    found = search.exact_radius_search(stored, queries, radius, DIM, inclusive, block_bytes=block_bytes)
    plain = search.exact_radius_search(vectors, queries, radius, DIM, inclusive)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
    by_cosine = search.exact_radius_search(stored, queries, 0.99, DIM, metric=COSINE)
    assert pairs(by_cosine) == pairs(search.exact_radius_search(vectors, queries, 0.99, DIM, metric=COSINE))


def test_most_cells_are_passed_over(spark, clusters, tmp_path):
    path = f"file://{tmp_path}/pivots"
    save_pivot_vectors(frame(spark, range(2000), clusters), path, pivots=20, bands=4, sample=1000)
    stored = load_pivot_vectors(spark, path)
    cells = cells_of(stored)
    assert cells.n.sum() == 2000
    reached = cells.reached(clusters[:100], 1.0)
    read = (reached.any(0) * cells.n).sum() / 2000
    measured = (reached @ cells.n).sum() / (100 * 2000)
    assert read < 0.1 and measured < 0.1
    near = search.exact_radius_search(stored, frame(spark, range(100), clusters[:100], "query_id", "qv"), 1.0, DIM)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "cell" in plan.split("PartitionFilters: ")[1].split("]")[0]


def test_rounds_of_queries_move_no_vector(spark, clusters):
    vectors = frame(spark, range(500), clusters[:500])
    queries = frame(spark, range(90), clusters[:90], "query_id", "qv")
    found = search.exact_radius_search(vectors, queries, 2.0, DIM, block_bytes=8 * DIM * 20)
    assert pairs(found) == pairs(search.exact_radius_search(vectors, queries, 2.0, DIM))


# -- nearest neighbours ------------------------------------------------------------------


def truth(x, q, k, metric=L2):
    found = {}
    measure = metric.block(x, q)
    for j in range(len(q)):
        order = sorted(range(len(x)), key=lambda i: (measure[i, j] if metric.smaller_is_nearer else -measure[i, j], i))[:k]
        found[j] = [(i, pytest.approx(measure[i, j])) for i in order]
    return found


def ranked(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.distance))
    return found


@pytest.mark.parametrize("metric", [L2, COSINE])
def test_exact_nearest(spark, x, metric):
    y = np.concatenate([x, x[:50]])  # ties
    queries = frame(spark, range(30), x[:30] + 0.1, "query_id", "qv")
    found = exact_knn_search(frame(spark, range(250), y).repartition(3), queries, 7, DIM, metric)
    assert ranked(found) == truth(y, x[:30] + 0.1, 7, metric)


def test_every_query_has_k_answers(spark, x):
    vectors = frame(spark, range(200), x).cache()
    index = build_index(vectors, IndexParams(DIM, 8, 3, 0.7, seed=2))
    q = np.concatenate([x[50:90] + 0.05, x[:5] + 100])
    queries = frame(spark, range(45), q, "query_id", "qv")
    found = ranked(knn_probed(index, vectors, queries, 5))
    assert {j: len(v) for j, v in found.items()} == dict.fromkeys(range(45), 5)
    exact = truth(x, q, 5)
    assert all(found[j][0] == exact[j][0] for j in range(40, 45))  # far from all buckets: by the exact scan
    nearest = np.mean([found[j][0] == exact[j][0] for j in range(40)])
    assert nearest > 0.9
    few = ranked(knn_probed(index, vectors.limit(3), queries, 5))
    assert all(len(v) == 3 for v in few.values())
    assert knn_probed(index, vectors, queries.limit(0), 5).count() == 0


def test_probes_come_by_the_distance_to_their_edges():
    family = IndexParams(DIM, 4, 3, 1.0, seed=4).family()
    assert len(perturbations(4)) == 1 + 8 + 24
    x = np.random.default_rng(0).standard_normal((20, DIM))
    sig, table, pattern, patterns = probe_order(family, x)
    assert (pattern[:, : len(family.tables)] == 0).all()
    place = (x @ family.a.T + family.b) / family.bin_length
    groups = family.groups
    for q in range(20):
        cost = []
        for t, p in zip(table[q], pattern[q]):
            i, j = family.tables[t]
            members = groups[i] + groups[j]
            edges = [place[q, members[s]] - sig[q, members[s]] for s, _ in patterns[p]]
            cost.append(sum((e if step < 0 else 1 - e) ** 2 for e, (_, step) in zip(edges, patterns[p])))
        assert cost == sorted(cost)


# -- the model of collisions -------------------------------------------------------------


@pytest.mark.parametrize("kind", ["pstable", "sign"])
@pytest.mark.parametrize("n", [300, 1000, 3000])
def test_measured_recall_follows_the_model(spark, kind, n):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    step = rng.standard_normal((n, 32))
    step -= (step * x).sum(1)[:, None] * x
    step /= np.linalg.norm(step, axis=1)[:, None]
    near = 0.2
    q = x * np.cos(near) + step * np.sin(near) if kind == "sign" else x + near * step
    vectors, queries = frame(spark, range(n), x), frame(spark, range(n), q, "query_id", "qv")
    sampled = tuning.sampled_pairs(vectors, 32, kind, 300)
    tuned = tuning.tune(sampled, near, 32, 0.9, kind, seed=n)
    assert tuned.recall >= 0.9
    # The chance is over the draw of the functions too: mean over some families.
    met, load = [], []
    for seed in range(3):
        params = tuned.params.__class__(**{**tuned.params.__dict__, "seed": seed})
        found = pairs(search.candidates(build_index(vectors, params), queries))
        met.append(sum((i, i) in found for i in range(n)) / n)
        load.append(len(found) / n / n)
    assert abs(np.mean(met) - tuned.recall) < 0.03
    assert np.mean(load) < 3 * tuned.load + 2 / n


def test_no_settings_are_an_error():
    with pytest.raises(ValueError, match="no settings"):
        tuning.tune(np.array([1.0, 2.0]), 1.5, 8, recall=0.999999999, max_tables=3, functions=(24,), kind="sign")


def test_collision_chances_against_draws():
    rng = np.random.default_rng(0)
    a, b = rng.standard_normal(200_000), rng.random(200_000)
    for distance in (0.1, 0.7, 3.0):
        met = np.mean(np.floor(b) == np.floor(a * distance + b))
        assert abs(met - tuning.pstable_collision(distance, 1.0)) < 0.005


# -- sparse vectors ----------------------------------------------------------------------


def test_sparse_measures_and_hashes_equal_dense_ones(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((40, 30)) * (rng.random((40, 30)) < 0.2)
    v[5] = 0
    w = np.roll(v, 1, axis=0)
    w[7] = v[7]
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(v, w))], "i int, a array<double>, b array<double>")
    s = df.select("i", dense_to_sparse(F.col("a")).alias("a"), dense_to_sparse(F.col("b")).alias("b"))
    a, b = F.col("a"), F.col("b")
    shown = s.select(
        "i", sparse.sparse_dot(a, b).alias("dot"), sparse.sparse_l2(a, b).alias("l2"), sparse.sparse_cosine(a, b).alias("cos"),
        sparse.sparse_tanimoto(a, b).alias("tan"), sparse.sign_signature(a, 9, 12).alias("sign"),
        sparse.pstable_signature(a, 9, 12, 0.5).alias("bins"),
    )
    planes = sparse.plane_entries(9, np.arange(12), np.arange(30))
    offsets = np.random.default_rng([9, 1]).random(12) * 0.5
    for r in shown.collect():
        x, y = v[r.i], w[r.i]
        assert r.dot == pytest.approx(x @ y) and r.l2 == pytest.approx(np.linalg.norm(x - y), abs=1e-7)
        norm = np.linalg.norm(x) * np.linalg.norm(y)
        assert (r.cos is None) == (norm == 0) and (norm == 0 or r.cos == pytest.approx(x @ y / norm))
        below = x @ x + y @ y - x @ y
        assert (r.tan is None) == (below == 0) and (below == 0 or r.tan == pytest.approx(x @ y / below))
        assert r.sign == (planes @ x > 0).astype(int).tolist()
        assert r.bins == np.floor((planes @ x + offsets) / 0.5).astype(int).tolist()


def test_plane_entries_are_gaussian_and_apart():
    entries = sparse.plane_entries(1, np.arange(40), np.arange(5000))
    assert abs(entries.mean()) < 0.01 and abs(entries.std() - 1) < 0.01
    assert abs(np.mean(np.abs(entries) < 1) - 0.6827) < 0.01
    assert np.abs(np.corrcoef(entries) - np.eye(40)).max() < 0.08
    assert np.abs(np.corrcoef(entries[:, :200].T) - np.eye(200)).max() < 0.85


def test_sparse_vectors_of_a_large_dimension(spark):
    big = 2_000_000_000
    rows = [(big, [5, big - 1], [1.0, 2.0]), (big, [big - 1], [4.0])]
    df = spark.createDataFrame([(r,) for r in rows], "s struct<size:int,indices:array<int>,vals:array<double>>")
    bins = [r[0] for r in df.select(sparse.sign_signature(F.col("s"), 3, 8)).collect()]
    planes = sparse.plane_entries(3, np.arange(8), np.array([5, big - 1]))
    assert bins == [(planes @ [1, 2] > 0).astype(int).tolist(), (planes @ [0, 4] > 0).astype(int).tolist()]


@pytest.mark.parametrize("row", [(3, [5], [1.0]), (3, [1], [1.0, 2.0]), (3, [-1], [1.0]), (3, [1], [float("nan")])])
def test_broken_sparse_vectors_are_errors(spark, row):
    df = spark.createDataFrame([(row,)], "s struct<size:int,indices:array<int>,vals:array<double>>")
    with pytest.raises(Exception, match="sparse vectors|unequal length"):
        df.select(sparse.sign_signature(F.col("s"), 3, 8)).collect()
