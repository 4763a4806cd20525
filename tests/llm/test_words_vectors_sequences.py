"""Spelling variants, hard negatives and packing beside plain loops and round trips."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.data import documents, table, with_extras
from vicinal.llm import hardneg, packing, spelling

# -- spelling variants -----------------------------------------------------------------


def _variants(spark, counts, **settings):
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    found = spelling.variants(words, spelling.Settings(**settings)).collect()
    assert len(found) == len(counts)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found}


def test_variants_equal_a_comparison_of_all_words(spark):
    rng = random.Random(4)
    counts = {}
    for _ in range(400):
        word = "".join(rng.choice("abÀé") for _ in range(rng.randrange(1, 7)))
        counts[word] = int(5 ** rng.uniform(1, 6))
    assert _variants(spark, counts) == spelling.brute_force(counts)


def test_rows_of_equal_letters_ties_and_chains(spark):
    counts = {"aaab": 5, "aab": 30, "aabb": 30, "ab": 200, "b": 1500, "ba": 200, "zzzz": 5}
    found = _variants(spark, counts)
    assert found == spelling.brute_force(counts)
    assert found["aaab"] == ("aab", "b", 5, 2, 30)  # the smaller of two words of 30; then ab, then b
    assert found["zzzz"] == (None, "zzzz", 5, 0, None)


def test_words_with_the_terminator_nulls_and_no_words(spark):
    rows = [("ab\x00", 9), ("abc", 9), (None, 4), ("abd", None)]
    words = spark.createDataFrame(rows, "word string, n bigint")
    found = {r.word: r.n_near for r in spelling.variants(words).collect()}
    assert found == {"ab\x00": 0, "abc": 0}
    assert spelling.variants(words.limit(0)).count() == 0


def test_counts_of_words_and_slips(spark):
    text = "Variante ÀVARIANTE variante x" * 3 + " ×÷ßÿabc kurz"
    rows = [*((i, text) for i in range(300)), (None, text), (7, text), (900, None), (901, "")]
    docs = with_extras(spark.createDataFrame(rows, "doc_id bigint, text string"))
    expected = Counter()
    for doc_id, t in rows:
        run = ""
        for c in (t or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = _crc(f"{'null' if doc_id is None else doc_id}:{run}".encode())
                word = run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]
                expected[word] += len(word) >= 6
                run = ""
    expected = {w: n for w, n in expected.items() if n >= 5}
    assert len(expected) > 3
    for held in (400_000, 2):
        found = spelling.word_counts(docs, spelling.Settings(held=held))
        assert {r.word: r.n for r in found.collect()} == expected
    assert spelling.word_counts(docs.limit(0)).count() == 0


def _crc(data: bytes) -> int:
    """CRC-32 bit by bit."""
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 * (c & 1))
    return c ^ 0xFFFFFFFF


def test_a_prefix_across_batches_is_one_group(spark):
    counts = {a + "bcdef": 10 + i for i, a in enumerate("abcdefghijklmnopqrstuvwxyz")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert _variants(spark, counts) == spelling.brute_force(counts)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# -- hard negatives --------------------------------------------------------------------

VECTORS = "vec_id bigint, label int, v array<double>"


def _mined(rows, positives=5, negatives=10):
    """All products, sorted."""
    found = []
    for a, la, va in rows:
        if a % 10:
            continue
        scored = sorted((-sum(int(x) * int(y) for x, y in zip(va, v)), i, lab) for i, lab, v in rows if i != a and len(v) == len(va))
        for s, p, _ in [x for x in scored if x[2] == la][:positives]:
            near = [x for x in scored if x[2] != la and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            found += [(a, p, k, n, -s, -t) for k, (t, n, _) in enumerate(near, 1)]
    return sorted(found)


def _vectors(seed=1, n=240, d=6):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = np.floor(rng.normal(size=d) * rng.choice([3, 40, 500]))
        if i % 40 == 20:
            v[:] = 0
        if i % 9 == 4 and rows:
            v = np.array(rows[i // 2][2])
        rows.append((i, int(rng.integers(0, 3)), v.tolist()))
    return rows


@pytest.mark.parametrize(
    "settings",
    [hardneg.Settings(), hardneg.Settings(bucket=16, focus=6, block=5), hardneg.Settings(bucket=7, focus=1)],
)
@pytest.mark.parametrize("d", [2, 6])
def test_negatives_equal_all_products(spark, settings, d):
    from pyspark.sql import functions as F

    rows = _vectors(d=d)
    found = hardneg.mine(with_extras(spark.createDataFrame(rows, VECTORS)), F.col("vec_id") % 10 == 0, settings)
    assert sorted(map(tuple, found.collect())) == _mined(rows)


def test_coordinates_prune(spark):
    rng = np.random.default_rng(2)
    v = np.floor(np.concatenate([rng.normal(size=(200, 4)) + 40 * np.eye(4)[i] for i in range(4)]))
    bucket = hardneg.Bucket(np.arange(800), np.zeros(800), v)
    anchors = hardneg.Anchors(np.arange(8), np.zeros(8), v[::100], 2)
    least = 0.9 * anchors.length * bucket.longest
    kept = {}
    for rows, members in bucket.candidates(anchors, least):
        for i in rows:
            kept[int(i)] = set(range(800)) if members is None else set(members.tolist())
    scores = anchors.v @ v.T
    for i in range(8):
        assert set(np.flatnonzero(scores[i] >= least[i]).tolist()) <= kept.get(i, set())
        assert len(kept.get(i, ())) <= 220


def test_awkward_vectors(spark):
    from pyspark.sql import functions as F

    nan, inf = float("nan"), float("inf")
    sound = _vectors(n=40)
    rows = sound + [
        (100, None, [1.0] * 6),
        (110, 1, None),
        (120, 1, [nan] + [1.0] * 5),
        (130, 1, [inf] + [1.0] * 5),
        (140, 1, [None] + [1.0] * 5),
        (None, 1, [1.0] * 6),
        sound[7],
        sound[10],
    ]
    others = [(200, 1, [3.0, 4.0]), (201, 1, [3.0, 3.0]), (202, 0, [1.0, 2.0]), (210, 0, []), (211, 0, [])]
    frame = spark.createDataFrame(rows + others, VECTORS)
    found = hardneg.mine(frame, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, found.collect())) == _mined(sound + others)
    assert hardneg.mine(frame.limit(0), F.lit(True)).count() == 0
    assert hardneg.mine(frame, F.lit(False)).count() == 0


def test_large_whole_numbers_are_exact():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**20 + 1, 1.0], [2.0**60, 0.0]])
    assert hardneg.products(a, b).tolist() == [[2**60 + 2**40 + 3, 2**63 - 1]]


def test_report_moves_labels_and_floors(spark):
    rows = [(i, [x / 256 + 0.001, 1.0 / 256], i % 10) for i, x in zip(range(0, 200), itertools.cycle([90, 50, 30, 7]))]
    rows += [(500, [None, 1.0], 1), (600, [float("inf"), 1.0], 1), (700, None, 1)]
    found = hardneg.negatives_report(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"))
    plain = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [float(int(np.float32(x) * 256)) for x in v]) for i, v, lab in rows[:200]]
    expected = [r for r in _mined(plain) if r[0] % 100 == 0]
    assert sorted(map(tuple, found.collect())) == expected


# -- packing ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public.PATTERN


@pytest.fixture(scope="module")
def plain_ids():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    return lambda text: [*whole.encode(text or "", add_special_tokens=False).ids, 0]


AWKWARD = [
    "it's  we'LL\tyou're\r\n\n 12345 x²½ …",
    "<|endoftext|> a<|endoftext|>",
    "\x00\x01​　\xa0 漢字 é \U0001f600\U0001f1e9\U0001f1ea",
    " " * 5000,
    "a" * 20_000,
    "\n" * 3000 + "x",
]


def test_packed_ids_are_those_of_the_tokenizer(spark, vocabulary, plain_ids):
    rows = [(r[0], r[1]) for r in documents()] + [(1000 + i, t) for i, t in enumerate(AWKWARD)]
    rows += [(5, "same"), (5, "same"), (None, "no id"), (None, None)]
    docs = with_extras(spark.createDataFrame(rows, "doc_id bigint, text string")).repartition(5)
    settings = packing.Settings(capacity=300, batch_bytes=2000)
    packed = packing.pack(docs, *vocabulary, settings).collect()
    per_doc, per_sequence = defaultdict(list), defaultdict(list)
    for r in packed:
        per_sequence[r.sequence_id].append((r.offset, r.length))
        per_doc[r.doc_id].append(r)
    for found in per_sequence.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 300
    ids = {d: plain_ids(t) for d, t in rows}
    for d, t in {r for r in rows if r[0] not in (5, None)}:
        here, at = sorted(per_doc[d], key=lambda r: r.piece), 0
        for i, r in enumerate(here):
            assert (r.piece, r.start, r.length) == (i, at, len(r.ids) // 4)
            assert list(np.frombuffer(r.ids, "<u4")) == ids[d][at : at + r.length]
            assert r.length == 300 or i == 0
            at += r.length
        assert at == len(ids[d])
        assert len(here) == -(-at // 300)
    assert len(per_doc[5]) == 2 + len(packing.cuts(len(plain_ids(rows[5][1])), 300))
    assert sorted(len(r.ids) for r in per_doc[None]) == sorted(4 * len(plain_ids(t)) for t in ("no id", None))
    assert len(per_sequence) <= -(-sum(r.length for r in packed) // 300) + 1


def test_sequences_hold_their_documents(spark, vocabulary, plain_ids):
    docs = spark.createDataFrame([(i, "word " * (i % 50)) for i in range(200)], "doc_id bigint, text string")
    settings = packing.Settings(capacity=100)
    found = packing.sequences(packing.pack(docs, *vocabulary, settings)).collect()
    seen = []
    for r in found:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.n_tokens == len(ids) == sum(r.lengths) <= 100
        at = 0
        for doc_id, n in zip(r.doc_ids, r.lengths):
            assert ids[at : at + n] == plain_ids("word " * (doc_id % 50))
            seen.append(doc_id)
            at += n
    assert sorted(seen) == list(range(200))


def test_empty_table(spark, vocabulary):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack_report(docs, *vocabulary).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_fullest_combination(seed):
    rng = random.Random(seed)
    left = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(5)}
    room = rng.randrange(1, 60)
    best = max(
        (sum(x * n for x, n in zip(left, some)) for some in itertools.product(*(range(n + 1) for n in left.values()))),
        key=lambda s: s if s <= room else -1,
    )
    chosen = packing.fullest(left, room)
    assert sum(x * n for x, n in chosen.items()) == best
    assert all(n <= left[x] for x, n in chosen.items())


def test_plan_uses_every_piece_once_and_wastes_little():
    rng = np.random.default_rng(0)
    for counts in (
        Counter(np.clip(rng.lognormal(6, 1, 20_000).astype(int), 1, 2048).tolist()),
        {700: 100_000, 650: 50_000, 5: 3},
        {1025: 10},
        {2048: 4, 1: 1},
    ):
        plan = packing.bin_plan(counts, 2048)
        used = Counter()
        for times, chosen in plan:
            assert sum(x * n for x, n in chosen) <= 2048
            for x, n in chosen:
                used[x] += n * times
        assert used == Counter(counts)
    assert sum(t for t, _ in packing.bin_plan({1025: 10}, 2048)) == 10
