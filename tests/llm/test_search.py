"""Near duplicates, substrings, line templates and decontamination beside plain loops."""

import random

import pyarrow as pa
import pytest

from tests.llm.data import DOCS, documents, prose, table, with_extras
from vicinal.llm import decontam, jaccard, substrings, templates
from vicinal.llm.components import components

PAIRS = "doc_id bigint, text string"


def _pairs(rows):
    return [(r[0], r[1]) for r in rows]


# -- n-gram Jaccard join ---------------------------------------------------------------


def _joined(rows, similarity=0.8):
    sets = {rows[i][0]: set(s.tolist()) for i, s in jaccard.token_sets(pa.array([t for _, t in rows], pa.string()), 5)}
    group, links = {d: d for d in sets}, dict.fromkeys(sets, 0)

    def find(d):
        while group[d] != d:
            d = group[d]
        return d

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and both >= similarity * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    return {d: (find(d), links[d]) for d in sets}


def _near_group(n, words=80, seed=5):
    """Near copies of one text, all different, and texts that only share a passage."""
    rng = random.Random(seed)
    base, passage = prose(rng, words, 10_000).split(), prose(rng, 12, 10_000)
    rows = []
    for i in range(n):
        text = list(base)
        text[rng.randrange(words)] = f"edit{i}"
        rows.append((i, " ".join(text)))
        rows.append((1000 + i, f"{prose(rng, 60, 10_000)} {passage} {prose(rng, 60, 10_000)}"))
    return rows


@pytest.mark.parametrize(
    "settings",
    [
        jaccard.Settings(),
        jaccard.Settings(bucket=4, block=3),
        jaccard.Settings(bucket=4, block=3, alike=2.0, levels=2),
    ],
)
def test_join_matches_all_pairs(spark, settings):
    for rows in (_pairs(documents()), _near_group(25)):
        got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join_report(table(spark, rows, PAIRS), settings).collect()}
        assert got == _joined(rows)


def test_join_of_copies_nulls_and_empty_tables(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A, b c d e f!"), (3, None), (4, ""), (5, ""), (6, "a b"), (7, "a b"), (None, "a b c d e f")]
    got = sorted(map(tuple, jaccard.join_report(table(spark, rows, PAIRS)).collect()), key=str)
    assert got == sorted(
        [(1, 1, 3), (1, 1, 3), (2, 1, 3), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 1), (7, 6, 1), (None, 1, 3)], key=str
    )
    assert jaccard.join_report(table(spark, [], PAIRS)).count() == 0
    kept = sorted(r.doc_id for r in jaccard.keep_one(table(spark, rows, PAIRS)).collect())
    assert kept == [1, 3, 4, 5, 6]


@pytest.mark.parametrize("settings", [jaccard.Settings(), jaccard.Settings(deeper=2), jaccard.Settings(levels=2)])
def test_recall_holds_where_every_bucket_splits(settings):
    rng = random.Random(8)
    texts = []
    for i in range(600):
        # 80 shared shingles; 10 own ones on both sides, or 20 on one.
        common, own = prose(rng, 84, 10**9), (10, 10) if i % 2 else (0, 20)
        texts += [f"{common} {prose(rng, k, 10**9)}" for k in own]
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    (found,) = jaccard._samples(settings)(iter([batch]))
    chosen = [{(c["run"], c["level"], c["t"]) for c in row} for row in found.column("chosen").to_pylist()]
    met = 0
    for a, b in zip(chosen[::2], chosen[1::2]):
        shared = {(run, level) for run, level, _ in a & b}
        met += sum(all((run, d) in shared for d in range(settings.levels)) for run in range(settings.runs))
    chance = met / (len(texts) // 2 * settings.runs)
    assert (1 - chance) ** settings.runs <= 1 - settings.recall


def test_keep_one_keeps_columns(spark):
    docs = with_extras(table(spark, documents()))
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    want = {d for d, (group, _) in _joined(_pairs(documents())).items() if d == group}
    assert {r.doc_id for r in kept.collect()} == want


def _passages(n, seed=6):
    """Documents in pairs of near copies, all of which share a passage of half their length."""
    rng = random.Random(seed)
    passage, rows = prose(rng, 80, 10**9), []
    for i in range(n // 2):
        own = prose(rng, 80, 10**9)
        rows += [(2 * i, f"{own} {passage}"), (2 * i + 1, f"{own} {passage} more")]
    return rows


@pytest.mark.parametrize("group", [lambda n: _near_group(n)[::2], _passages])
def test_tasks_grow_with_the_documents(spark, group):
    settings = jaccard.SETTINGS
    schema = f"c binary, chosen {jaccard._CHOSEN}, signature array<bigint>, sketch binary"
    for n in (800, 1600):
        rows = group(n)
        samples = table(spark, rows, PAIRS).select("text").mapInArrow(jaccard._samples(settings), schema).persist()
        tasks = jaccard._tasks(jaccard._without_repeats(jaccard._leaves(samples, settings)), settings)
        made = tasks.selectExpr("sum(size(tasks))").first()[0]
        samples.unpersist()
        assert made < 30 * n


def test_common_counts_in_blocks():
    import numpy as np

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 30)).astype(np.uint64) for _ in range(9)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    for i in range(9):
        for j in range(9):
            if i != j:
                assert jaccard.common_counts(sets, columns=7)[i, j] == want[i][j]
    across = jaccard.common_counts(sets[:4], sets[4:], columns=7)
    assert across.tolist() == [row[4:] for row in want[:4]]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(201, 200), (201, 200)]
    got = {r.node: r.label for r in components(table(spark, edges, "u int, v int")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)} | {200: 200, 201: 200}
    assert components(table(spark, [], "u int, v int")).count() == 0


# -- substrings ------------------------------------------------------------------------


@pytest.mark.parametrize("window, gram, shard", [(20, 8, 256), (20, 8, 1), (5, 2, 256), (5, 2, 1)])
def test_repeats_match_all_windows(spark, window, gram, shard):
    rows = _pairs(documents(seed=window + shard))
    found = substrings.remove_repeats(table(spark, rows, PAIRS), window, gram, shard)
    got = sorted(map(tuple, found.selectExpr("doc_id", "n_words", "n_removed", "sha2(cast(kept_text AS BINARY), 256)").collect()))
    assert got == substrings.brute_force(rows, window)


@pytest.mark.parametrize("least", [64, 1])
def test_repeats_of_few_words_everywhere(spark, monkeypatch, least):
    monkeypatch.setattr(substrings, "HOT_LEAST", least)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(60)))) for i in range(150)]
    found = substrings.remove_repeats(table(spark, rows, PAIRS), 6, 3)
    got = sorted(map(tuple, found.selectExpr("doc_id", "n_words", "n_removed", "sha2(cast(kept_text AS BINARY), 256)").collect()))
    assert got == substrings.brute_force(rows, 6)


def test_repeats_in_equal_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(4, text), (4, text), (9, f"{text} tail"), (None, text), (None, None), (5, None)]
    got = sorted((str(r.doc_id), r.n_removed, r.kept_text) for r in substrings.remove_repeats(table(spark, rows, PAIRS)).collect())
    assert got == sorted([("4", 0, text), ("4", 0, text), ("9", 30, "tail"), ("None", 30, ""), ("None", 0, ""), ("5", 0, "")])
    assert substrings.remove_repeats(table(spark, [], PAIRS)).count() == 0
    assert substrings.repeats_report(with_extras(table(spark, documents()))).count() == len(documents())


def test_automaton_against_all_substrings():
    rng = random.Random(2)
    for _ in range(60):
        automaton, known, n = substrings.Automaton(), set(), rng.choice([2, 3, 5])
        for _ in range(6):
            words = [rng.choice("abc") for _ in range(rng.randrange(1, 25))]
            want = []
            for i in range(len(words)):
                w = tuple(words[i - n + 1 : i + 1]) if i >= n - 1 else None
                want.append(w is not None and w in known)
                known.add(w)
            known.discard(None)
            assert automaton.covered(words, n) == want


# -- line templates --------------------------------------------------------------------


def test_lines_match_plain_loops(spark):
    rng = random.Random(4)
    rows = []
    for i in range(40):
        lines = [prose(rng, 9).replace("\n", " ") for _ in range(4)]
        lines.append(f"Copyright by the owner {rng.randrange(2000)} all rights reserved page {i}")
        if i % 3 == 0:
            lines.insert(0, f"posted by {rng.choice(['ann', 'bob', 'cy'])} on day {i}")
        if i % 9 == 0:
            lines += ["only here 1 2 3 four"] * 6
        rows.append((i, "\n".join(lines)))
    rows += [(90, None), (91, ""), (92, "\n\n \n"), (93, "x " * 5000)]
    found = templates.drop_templates(with_extras(table(spark, rows, PAIRS))).select("row.*", "n_lines", "n_dropped", "kept_text").collect()
    want = templates.brute_force(rows)
    assert {r.doc_id: r.kept_text for r in found} == want
    assert "Copyright" not in want[0] and want[90] is None and want[92] == "\n\n \n"
    assert templates.line_report(table(spark, [], PAIRS)).count() == 0


def _line_places(spark, rows):
    """Lines that stay, and those that plain loops keep."""
    found = templates.drop_templates(table(spark, rows, PAIRS)).select("row.*", "kept_text").collect()
    return {r.doc_id: r.kept_text for r in found}, templates.brute_force(rows)


@pytest.mark.parametrize(
    "line",
    [
        "{} replied to your comment on this page",
        "posted by {} in the archive of letters today",
        "the user {} {} has left this long conversation",
        "{} {} {} sent you a message about the house",
    ],
)
def test_variable_leading_words_are_wildcards(spark, line):
    rows = [(i, f"own{i} words{i} here\n" + line.format(f"Name{chr(97 + i % 26)}{chr(97 + i // 26)}", f"x{chr(97 + i)}z", f"y{chr(97 + i)}"))
            for i in range(26)]
    found, want = _line_places(spark, rows)
    assert found == want
    assert all(kept == f"own{i} words{i} here" for i, kept in found.items())


def test_rare_leading_words_alone_are_no_template(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    # Four variable words ahead, lines of two words, and names that only one document repeats.
    rows = [(i, f"a{c} b{c} c{c} d{c} is one of them\n{c}{c} left\n") for i, c in enumerate(letters)]
    rows += [(30, "Zoe replied to them all at once\n" * 9), (31, None), (32, ""), (33, "\n \n")]
    found, want = _line_places(spark, rows)
    assert found == want == {i: text for i, text in rows}


def test_repeated_rows_are_one_document_in_leading_words(spark):
    rows = [(1, "Anna replied to your comment on this page")] * 7 + [(i, "and so on") for i in range(2, 5)]
    found = templates.line_report(table(spark, rows, PAIRS)).collect()
    assert len(found) == 10 and not any(r.n_dropped for r in found)


def test_leading_words_counted_in_parts(monkeypatch):
    """Counts do not depend on how often a task tells what it has gathered."""
    import pyarrow as pa

    rng = random.Random(9)
    texts = ["\n".join(f"{rng.choice('abcdefgh')}q r{rng.choice('stuvw')} s" for _ in range(3)) for _ in range(60)]

    def rare(size, gathered):
        monkeypatch.setattr(templates, "_GATHERED", gathered)
        monkeypatch.setattr(templates, "_KNOWN", 4)
        monkeypatch.setattr("vicinal.llm.tokens.CHUNK_BYTES", 60)
        batches = [
            pa.record_batch([pa.array(range(i, i + size))] * 3 + [pa.array(texts[i : i + size])], names=["d", "o", "x", "text"])
            for i in range(0, 60, size)
        ]
        docs, full = {}, set()
        for told in templates._leads(templates._heads(iter(batches)), 20):
            for r in told.to_pylist():
                full.add(r["key"]) if r["d"] is None else docs.setdefault(r["key"], set()).add(r["d"])
        return {k: v for k, v in docs.items() if k not in full and len(v) < 20}

    whole = rare(60, 1 << 20)
    assert whole == rare(10, 1) == rare(5, 40)


# -- decontamination -------------------------------------------------------------------

QUESTION = "A train leaves Paris at 9 hours and travels 300 km before it meets Bob on the way home to Paris."


@pytest.mark.parametrize(
    "text, leaked",
    [
        (QUESTION, True),
        (f"Some words first. {QUESTION} And more.", True),
        (QUESTION.upper().lower(), True),
        (QUESTION.replace("Paris", "Rome").replace("300", "450").replace("Bob", "Tom"), True),
        # One value of the item may not become two.
        ("A train leaves Rome at 7 hours and travels 450 km before it meets Tom on the way home to Milan.", False),
        ("A train leaves Paris at once and nobody knows.", False),
        (None, False),
        ("", False),
    ],
)
def test_leaks(spark, text, leaked):
    bench = table(spark, [(1, QUESTION), (2, None), (3, ""), (4, "Too short.")], "item_id bigint, text string")
    docs = table(spark, [(7, text, "en", "a", 0)])
    assert decontam.leak_report(docs, bench).count() == int(leaked)
    assert decontam.decontaminate(docs, bench).count() == int(not leaked)


def test_leaks_with_one_inconsistent_slot_and_shared_values(spark):
    rng = random.Random(9)
    long = f"{prose(rng, 20, 5000)} in Paris {prose(rng, 18, 5000)} in Paris".replace(".", "").replace("\n", " ")
    sums = "the farmer puts 3 red apples and then another 5 green apples into the large old basket by the door"
    bench = table(spark, [(1, long), (2, sums)], "item_id bigint, text string")
    texts = [long[: -len("Paris")] + "Rome", sums.replace("3", "4").replace("5", "4"), sums.replace("3", "4").replace("5", "7")]
    docs = table(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)])
    found = {(r.doc_id, r.item_id): (r.n_windows - r.n_matched, r.n_changed) for r in decontam.leak_report(docs, bench).collect()}
    assert found == {(0, 1): (1, 0), (1, 2): (0, 2), (2, 2): (0, 2)}


def test_leaks_in_tables(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.choice([5, 7, 20, 60]), 5000)) for i in range(30)]
    rows, want = [], set()
    for i in range(60):
        text = prose(rng, 50, 5000)
        if i % 4 == 0:
            text += "\n" + items[i % 30][1] + "\n" + prose(rng, 20, 5000)
            want.add((i, i % 30))
        rows.append((i, text, "en", "a", 0))
    bench = table(spark, [*items, items[0]], "item_id bigint, text string")
    docs = with_extras(table(spark, rows + [rows[0]]))
    found = {(r.doc_id, r.item_id) for r in decontam.leak_report(docs, bench).collect()}
    assert found == want
    clean = decontam.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r[0] for r in rows if r[0] not in {d for d, _ in want})
    assert decontam.leak_report(docs, bench.limit(0)).count() == 0
    assert decontam.leak_report(docs.limit(0), bench).count() == 0
    assert DOCS
