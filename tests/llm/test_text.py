"""Word kernel, language id, chats and URL rules."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.data import table, with_extras
from vicinal.llm import chat, langid, tokens, url_rules

# -- words -----------------------------------------------------------------------------


def test_words_and_hashes_of_batches(monkeypatch):
    texts = ["one two\tone", None, "", " \n ", "é漢 one", "x" * 500, "two one"]
    for size in (4_000_000, 8):
        monkeypatch.setattr(tokens, "CHUNK_BYTES", size)
        found, hashes = {}, {}
        for first, data, at in tokens.chunks(pa.array(texts)[0:]):
            words = tokens.split_words(data, at)
            for owner, a, b, h in zip(words.owner, words.begin, words.end, words.hashes()):
                word = data[a:b].tobytes()
                found.setdefault(first + int(owner), []).append(word)
                assert hashes.setdefault(word, h) == h
        assert found == {i: t.encode().split() for i, t in enumerate(texts) if t and t.split()}
        assert len(set(hashes.values())) == len(hashes)


def test_slices_of_arrow_arrays():
    sliced = pa.array(["a", "b c", None, "d"])[1:3]
    (_, data, at), = tokens.chunks(sliced)
    assert data.tobytes() == b"b c" and at.tolist() == [0, 3, 3]


def test_slide_min():
    values = np.random.default_rng(0).integers(0, 99, 50).astype(np.uint64)
    for width in (1, 2, 3, 7, 13, 60):
        got = tokens.slide_min(values, width)
        assert got.tolist() == [values[i : i + width].min() for i in range(50)]


def test_lowered():
    assert tokens.lowered(np.frombuffer("AzÉé×ß".encode(), np.uint8)).tobytes().decode() == "azéé×ß"


# -- language --------------------------------------------------------------------------


def _language_rows(n=240):
    rng = random.Random(1)
    parts = {"aa": ["th", "he", "ing", "ou"], "bb": ["sch", "ich", "ü", "ein"], "cc": ["ción", "ñ", "as", "el"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(parts))
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(8, 120))]
        rows.append((i, " ".join(words), lang, "s", 0))
    return rows


def test_held_out_languages(spark):
    rows = _language_rows()
    awkward = [(900, None, "aa", "s", 0), (901, "", "aa", "s", 0), (902, "12 + 3!", "bb", "s", 0), (None, rows[0][1], None, "s", 0), (903, rows[1][1] * 300, None, "s", 0)]
    small = langid.Settings(epochs=6)
    found = langid.language_report(with_extras(table(spark, rows + awkward)), small).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(rows) + len(awkward)
    held = [r for r in rows if got[r[0]].held_out]
    assert 40 < len(held) < 120
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.97 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[None].lang_pred == rows[0][2] and not got[None].held_out
    assert got[903].lang_pred == rows[1][2]
    assert all(0 <= r.score <= 1 for r in found)


def test_nothing_learned_and_empty(spark):
    docs = table(spark, [(1, "text", None, "s", 0)])
    assert [r.lang_pred for r in langid.language_report(docs).collect()] == ["und"]
    assert langid.language_report(docs.limit(0)).count() == 0


def test_gradients():
    net = langid.ByteNet(langid.Settings(window=12, embedding=3, filters=2), ["a", "b"])
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 256, (5, 12)).astype(np.uint8), np.array([0, 1, 1, 0, 1])
    loss = lambda: -net.log_probabilities(x)[np.arange(5), y].mean()
    for name, grad in net._gradients(x, y).items():
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        net.weights[name][at] += 1e-6
        up = loss()
        net.weights[name][at] -= 2e-6
        assert (up - loss()) / 2e-6 == pytest.approx(grad[at], rel=1e-3, abs=1e-7)
        net.weights[name][at] += 1e-6


# -- chats -----------------------------------------------------------------------------

TURNS = "conv_id bigint, turn bigint, role string, text string"


def _chats():
    rng = random.Random(2)
    rows = []
    for c in range(30):
        for t in range(rng.choice([1, 2, 5, 40])):
            role = "system" if t == 0 and c % 2 else ["user", "assistant"][t % 2]
            rows.append((c, t, role, " ".join(rng.choice(["hi", "<|end|>", "&lt;", "[INST]", "</s>", "wörd" * 9]) for _ in range(rng.randrange(60)))))
    rows += [(50, 0, "user", None), (50, 1, None, "x"), (50, 1, None, "x"), (51, None, "assistant", ""), (None, 0, "assistant", "y" * 9000), (None, 1, "assistant", "z " * 3000)]
    return rows


@pytest.mark.parametrize("settings", [chat.Settings(), chat.Settings(budget=40, history=1), chat.Settings(budget=60, history=0)])
def test_windows_round_trip(spark, settings):
    turns = chat.with_probe(spark, with_extras(table(spark, _chats(), TURNS)))
    windows = chat.format_chats(turns, settings)
    got = {r.conv_id: r for r in chat.chat_report(windows).collect()}
    chats = defaultdict(list)
    said = "</s>[INST] ok [/INST]"
    for c, t, role, text in [*_chats(), (-1, 0, "user", said), (-1, 1, "assistant", said)]:
        chats[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(chats)
    for c, own in chats.items():
        own.sort()
        loss = "".join(x for _, role, x in own if role == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for w in windows.collect():
        turns_of = chat.parse(w.formatted)
        if len(turns_of) - w.repeated > 1:
            assert w.tokens <= settings.budget
        system = [x for x in chats[w.conv_id][:1] if x[1] == "system"]
        if system:
            assert turns_of[0] == system[0][1:]
        assert w.repeated <= settings.history + 1


def test_no_chats(spark):
    assert chat.chat_report(chat.format_chats(table(spark, [], TURNS))).count() == 0


def test_escapes():
    for text in ("&", "&amp;lt;", "<[&#91;", "<|turn|>", "</s>[INST] ok [/INST]", "&lt;|end|&gt;"):
        spelled = chat.escape(text)
        assert chat.unescape(spelled) == text and "<" not in spelled and "[" not in spelled


# -- URLs ------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("https://a.B.NET/x?q#f", "a.b.net", "/x", "net/", "block"),
        ("https://example.net/en/1", "example.net", "/en/1", "example.net/en/", "allow"),
        ("https://www.example.net/EN/1", "www.example.net", "/EN/1", "net/", "block"),
        ("https://badexample.com/de/", "badexample.com", "/de/", None, "allow"),
        ("ftp://m.example.com/de/x", "m.example.com", "/de/x", "example.com/de/", "block"),
        ("http://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
        ("http://x.org/frx/", "x.org", "/frx/", None, "allow"),
        ("http://x.net", "x.net", "", None, "allow"),
        ("http://x.net?/", "x.net", "", None, "allow"),
        ("http://a.spam-farm.example.org/en", "a.spam-farm.example.org", "/en", None, "block"),
        ("http://spam-farm.example.org/fr/1", "spam-farm.example.org", "/fr/1", "org/fr/", "allow"),
        ("http://my-spam-farm.org/", "my-spam-farm.org", "/", None, "block"),
        ("no scheme.net/", "", "", None, "allow"),
        ("a://b://c.net/", "b:", "//c.net/", None, "allow"),
        ("://net/", "net", "/", "net/", "block"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ],
)
@pytest.mark.parametrize("block", [50_000, 1])
def test_verdicts(spark, url, host, path, rule, verdict, block):
    pages = table(spark, [(1, url, "own")], "page_id bigint, url string, host string")
    assert [tuple(r) for r in url_rules.judge_urls(pages, block=block).collect()] == [(1, host, path, rule, verdict)]


def test_rules_hang_on_their_rarest_token(spark):
    rules = [url_rules.host_rule("block", "common.com/rare/"), url_rules.host_rule("block", "com/")]
    pages = table(spark, [(i, f"http://common.com/{'rare/' if i == 0 else ''}", "") for i in range(9)], "page_id bigint, url string, html string")
    shown = pages.select("page_id", url_rules.host_of(pages.url).alias("host"), url_rules.path_of(pages.url).alias("path"))
    counts = url_rules.token_counts(shown, rules)
    assert counts == {"common": 9, "com": 9, "rare": 1}
    assert set(url_rules.rule_index(rules, counts)) == {"rare", "com"}
    assert url_rules.judge_urls(pages.limit(0)).count() == 0
    assert url_rules.judge_urls(pages, rules=()).count() == 9


def test_rules_of_a_table(spark):
    rules = url_rules.read_rules(
        spark.createDataFrame(
            [("host", "block", "bad.org/"), ("token", "block", "casino"), ("token", "block", "casino"), (None, "block", "x")],
            "kind string, verdict string, name string",
        )
    )
    assert len(rules) == 2
    urls = ["http://a.bad.org/x", "https://m.casino-win.de/", "https://big-casino.de", "https://casinos.de/casino", "https://x.de/?casino"]
    pages = table(spark, [(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    found = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge_urls(pages, rules).collect()}
    assert found == {0: ("bad.org/", "block"), 1: (None, "block"), 2: (None, "block"), 3: (None, "allow"), 4: (None, "allow")}


def test_documents_of_one_id_are_all_learned_from(spark):
    rows = [(7, f"der die das {i}", "de") for i in range(400)] + [(8, f"the of and {i}", "en") for i in range(40)]
    settings = langid.Settings()
    drawn = langid.training_sample(table(spark, rows, "doc_id bigint, text string, lang string"), settings)
    counts = {r.lang: r.n for r in drawn.groupBy("lang").count().withColumnRenamed("count", "n").collect()}
    assert counts["en"] == 40 and settings.per_lang * 0.9 <= counts["de"] <= settings.per_lang


def test_share_of_a_language_of_any_size(spark):
    k = spark.range(1).selectExpr("cast(9e9 as bigint) as k", "cast(1073741823 as bigint) as h")
    from pyspark.sql import functions as F

    assert k.select(F.col("k").cast("double") * F.pmod("h", F.lit(1 << 30))).first()[0] > 9e18
