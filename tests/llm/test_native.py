"""Mixing, shards and quality rules on awkward tables, beside plain loops."""

import zlib
from collections import Counter, defaultdict

import pytest

from tests.llm.data import DOCS, documents, table, with_extras
from vicinal.llm import mixing, quality, shards


def _words(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, documents())


def test_targets_share_the_total_and_stop(spark):
    sizes = table(spark, [("a", 1), ("b", 100), ("c", 1000), (None, 40), ("d", 0)], "source string, size bigint")
    found = {r.mix_source: r for r in mixing.source_rates(sizes, "source", "size").collect()}
    weights = {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}
    want, level_of = {}, set(weights)
    total, size = 1141, {"a": 1, "b": 100, "c": 1000, None: 40, "d": 0}
    while True:
        level = (total - sum(want.values())) / sum(weights[s] for s in level_of)
        over = {s for s in level_of if weights[s] * level > 3 * size[s]}
        if not over:
            break
        want |= {s: 3 * size[s] for s in over}
        level_of -= over
    want |= {s: weights[s] * level for s in level_of}
    assert {s: pytest.approx(v) for s, v in want.items()} == {s: r.target for s, r in found.items()}
    assert sum(r.target for r in found.values()) == pytest.approx(total)
    assert found["d"].rate == 0


def test_mix_emits_what_the_report_says(spark, docs):
    report = {r.doc_id: r for r in mixing.mix_report(docs).collect()}
    rows = Counter(r.doc_id for r in mixing.mix(docs).collect())
    for doc_id, r in report.items():
        assert r.size == len(_words(dict((d[0], d[1]) for d in documents())[doc_id]))
        assert r.taken == rows[doc_id] * r.size
        assert r.taken <= 3 * r.size
    assert sorted(map(tuple, mixing.mix_report(docs).collect())) == sorted(map(tuple, report.values()))


def test_mixed_tokens_come_near_the_targets(spark):
    rows = [(i, "x " * (1 + i % 90), "en", "big" if i % 3 else f"s{i % 5}", 0) for i in range(6000)]
    report = mixing.mix_report(table(spark, rows)).toPandas()
    by_source = report.assign(source=[r[3] for r in rows]).groupby("source").agg({"taken": "sum", "target": "first"})
    assert ((by_source.taken - by_source.target).abs() / by_source.target).max() < 0.1


def test_mix_keeps_columns_and_empty_tables(spark, docs):
    extra = with_extras(docs)
    assert mixing.mix(extra).columns == extra.columns
    assert mixing.mix(extra).count() == mixing.mix(docs).count()
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix_report(docs.limit(0)).count() == 0


def test_manifest(spark):
    rows = [*documents(), (7, "seven", "en", "a", 0), (7, "seven", "en", "a", 0), (None, None, None, None, None), (None, "t", None, None, 1)]
    found = shards.manifest(table(spark, rows)).collect()
    assert len(found) == len(rows)
    slots = defaultdict(list)
    texts = Counter((d, t) for d, t, *_ in rows)
    seen = Counter()
    sums = defaultdict(set)
    for d, t in texts:
        sums[d].add((8 + len((t or "").encode()), None if t is None else zlib.crc32(t.encode())))
    for r in found:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and 0 <= r.shard < 24
        assert r.grown_shard in (r.shard, 24)
        assert (r.size, r.text_crc32) in sums[r.doc_id]
        seen[r.doc_id] += 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len({r.shard for r in found if r.doc_id == 7}) == 1
    assert shards.manifest(table(spark, [], DOCS)).count() == 0


def test_weighted_shards_move_few_keys(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id")
    weights = (1.0, 2.0, 1.0, 0.0)
    before = {r.doc_id: r.shard for r in shards.assign(keys, weights).collect()}
    after = {r.doc_id: r.shard for r in shards.assign(keys, (*weights, 1.0)).collect()}
    share = Counter(before.values())
    assert set(share) == {0, 1, 2}
    assert abs(share[1] - 10_000) < 400 and abs(share[0] - 5_000) < 300
    moved = [k for k in before if before[k] != after[k]]
    assert all(after[k] == 4 for k in moved)
    assert abs(len(moved) - 4_000) < 300


def _base(text):
    words = _words(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (
        len(words),
        sum(len(w.decode()) for w in words),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_base_counts(spark, docs):
    extra = [(900, "a b c a b c", "en", "a", 0), (901, "a\na\n \n \na a a", "en", "a", 0), (902, "## $ x|<y>", "en", "a", 0)]
    rows = [*documents(), *extra]
    for r in quality.quality_report(table(spark, rows)).collect():
        want = _base(dict((d[0], d[1]) for d in rows)[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_thresholds_follow_the_group(spark):
    plain = "one two three four five six seven eight nine ten " * 1
    rows = []
    for i in range(80):
        words = [f"{plain.split()[(i * j) % 10]}{i}{j}" for j in range(60)]
        noisy = [w + "#" for w in words]
        rows.append((i, " ".join(words), "en", "prose", 0))
        rows.append((100 + i, " ".join(noisy), "xx", "code", 0))
    rows.append((500, " ".join(w + "#" for w in rows[0][1].split()), "en", "prose", 0))
    kept = {r.doc_id for r in quality.quality_filter(table(spark, rows)).collect()}
    assert kept == {r[0] for r in rows} - {500}


def test_quality_keeps_columns_repeats_and_empty_tables(spark, docs):
    extra = with_extras(docs)
    kept = quality.quality_filter(extra.unionAll(extra))
    assert kept.columns == extra.columns
    assert all(n == 2 for n in Counter(r.doc_id for r in kept.collect()).values())
    assert quality.quality_filter(docs.limit(0)).count() == 0
    assert quality.quality_report(docs.limit(0)).count() == 0


def test_fences_follow_their_group(spark):
    """A repeat that is common in one source is far out in another."""
    import random

    rng = random.Random(3)

    def text(repeats):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for _ in range(repeats):
            at = rng.randrange(0, 190)
            words += words[at : at + 3]
        return " ".join(words)

    rows = [(i, text(0), "en", "plain", 0) for i in range(300)]
    rows += [(1000 + i, text(rng.randrange(0, 12)), "en", "forum", 0) for i in range(300)]
    rows += [(5000, text(12), "en", "plain", 0), (6000, text(12), "en", "forum", 0)]
    kept = {r.doc_id for r in quality.quality_filter(table(spark, rows)).collect()}
    assert 6000 in kept and 5000 not in kept
    assert len(kept) >= 595


def test_slots_of_one_key_with_many_texts(spark):
    rows = [(None, f"text {i}", "en", "a", 0) for i in range(3000)] + [(i, "t", "en", "a", 0) for i in range(50)]
    found = shards.manifest(table(spark, rows)).collect()
    by_shard = defaultdict(list)
    for r in found:
        by_shard[r.shard].append(r.slot)
    assert sum(map(len, by_shard.values())) == 3050
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    assert len({r.shard for r in found if r.doc_id is None}) == 1
