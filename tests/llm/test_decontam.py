"""Decontamination beside plain loops that follow its description, and the cases it must catch."""

import random
import re
from collections import defaultdict

import pytest

from tests.llm.data import prose, table, with_extras
from vicinal.llm import decontam

ITEMS, DOCS = "item_id bigint, text string", "doc_id bigint, text string"
WORD = re.compile("[0-9A-Za-z\x80-\xff]+")


def _tokens(text):
    """Words as ``(begin, end, spelling, kind)`` over the text's bytes, numbers joined; kinds: number, unit, name, head, word."""
    raw = text.encode().decode("latin-1")
    spans = [list(m.span()) for m in WORD.finditer(raw)]
    joined = []
    for a, b in spans:
        if joined and a == joined[-1][1] + 1 and raw[a - 1] in ",." and raw[a].isdigit() and raw[joined[-1][2]].isdigit():
            joined[-1][1], joined[-1][2] = b, a
        else:
            joined.append([a, b, a])
    found = []
    for i, (a, b, _) in enumerate(joined):
        word = raw[a:b].encode("latin-1").decode(errors="replace")
        spelled = re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), word)
        head = i == 0 or any(c in '.!?:;\n\r"()[]' for c in raw[joined[i - 1][1] : a])
        if raw[a].isdigit():
            kind = "number"
        elif found and found[-1][3] == "number" and spelled in decontam.UNITS:
            kind = "unit"
        elif re.match("[A-ZÀ-ÖØ-Þ](?![A-Z])", word):
            kind = "head" if head else "name"
        else:
            kind = "word"
        found.append((a, b, spelled, kind))
    return raw, found


def _windows(text, whole):
    """``{(place, key): values}`` of all windows of a text; ``whole`` for items."""
    raw, tokens = _tokens(text)
    found, sparse = {}, set()
    readings = {"named": {"name"}, "both": {"name", "head"}, "plain": set()}
    for reading, names in readings.items():
        merged = []
        for i, (a, b, spelled, kind) in enumerate(tokens):
            is_name = kind in names
            if is_name and merged and merged[-1]["name"] and a == merged[-1]["end"] + 1 and raw[a - 1] == " ":
                merged[-1]["end"] = b
                merged[-1]["words"].append(i)
                continue
            hole = is_name or kind in ("number", "unit")
            shown = "<name>" if is_name else f"<{kind}>" if hole else spelled
            merged.append({"begin": a, "end": b, "name": is_name, "hole": hole, "shown": shown, "words": [i]})
        for k in range(decontam.SHORTEST, decontam.WINDOW + 1):
            if whole and k < decontam.WINDOW and len(merged) != k:
                continue
            for s in range(len(merged) - k + 1):
                window = merged[s : s + k]
                place = window[0]["words"][0]
                if sum(not w["hole"] for w in window) < min(decontam.LITERALS, k - 1):
                    if reading != "plain":
                        sparse.add((place, k))
                    continue
                kinds = {tokens[i][3] for w in window for i in w["words"]}
                if (reading == "both" and "head" not in kinds) or (reading == "plain" and "name" not in kinds):
                    continue
                values = [raw[w["begin"] : w["end"]].encode("latin-1").decode(errors="replace").lower() for w in window if w["hole"]]
                found[place, ("canonical", *(w["shown"] for w in window))] = values
    for k in range(decontam.SHORTEST, decontam.WINDOW + 1):
        if whole and k < decontam.WINDOW and len(tokens) != k:
            continue
        for s in range(len(tokens) - k + 1):
            kinds = [t[3] for t in tokens[s : s + k]]
            few = [sum(t in ("word", *more) for t in kinds) < min(decontam.LITERALS, k - 1) for more in (("head",), ())]
            if (s, k) in sparse or any(few):
                found[s, ("as it stands", *(t[2] for t in tokens[s : s + k]))] = []
    return found


def brute_force(docs, items):
    """``{(doc_id, item_id): (n_windows, n_matched, n_changed)}``."""
    sought = defaultdict(lambda: defaultdict(list))
    sizes = defaultdict(set)
    for item_id, text in items:
        for (place, key), values in _windows(text or "", True).items():
            sought[key][item_id].append((place, values))
            sizes[item_id].add(place)
    found = {}
    for doc_id, text in docs:
        aligned = defaultdict(list)
        for (at, key), values in _windows(text or "", False).items():
            for item_id, places in sought.get(key, {}).items():
                for place, theirs in places:
                    aligned[item_id, at - place].append((place, list(zip(theirs, values))))
        matched, changes = defaultdict(set), defaultdict(int)
        for (item_id, _), met in aligned.items():
            pairs = {p for _, some in met for p in some}
            sound = len({a for a, _ in pairs}) == len(pairs)
            kept = {place for place, some in met if sound or all(a == b for a, b in some)}
            matched[item_id] |= kept
            if kept:
                changes[item_id] = max(changes[item_id], sum(a != b for a, b in pairs) if sound else 0)
        for item_id, kept in matched.items():
            n = len(sizes[item_id])
            if kept and len(kept) >= min(decontam.LEAK, -(-n // 2)):
                found[doc_id, item_id] = (n, len(kept), changes[item_id])
    return found


def _found(spark, docs, items):
    report = decontam.leak_report(table(spark, docs, DOCS), table(spark, items, ITEMS))
    return {(r.doc_id, r.item_id): (r.n_windows, r.n_matched, r.n_changed) for r in report.collect()}


def _sentence(rng, n):
    """Words, numbers with and without separators, units, and names of one or two words, also at heads."""
    parts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.6:
            parts.append(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(12))}")
        elif kind < 0.75:
            parts.append(rng.choice(["7", "1,200", "2.5", "9 km", "10 hours", "1,2,3"]))
        elif kind < 0.9:
            parts.append(rng.choice(["Tom", "Ann Lee", "Île", "Bob"]))
        else:
            parts.append(rng.choice([". Then", ".\nTom", "! Ann Lee", "+", "(ABC", "é"]))
    return " ".join(parts)


@pytest.mark.parametrize("seed", range(4))
def test_leaks_equal_plain_loops(spark, seed):
    rng = random.Random(seed)
    items = [(i, _sentence(rng, rng.choice([4, 5, 6, 8, 12, 30]))) for i in range(25)] + [(90, None), (91, ""), (3, "a second part of item three here")]
    docs = []
    for i in range(50):
        text = _sentence(rng, 30)
        if i % 2 == 0:
            said = rng.choice(items)[1] or ""
            for a, b in rng.sample([("Tom", "Sam"), ("Ann Lee", "Eve"), ("1,200", "950"), ("2.5", "3"), ("km", "miles"), ("Bob", "Tom")], 3):
                said = said.replace(a, b)
            text = f"{text} {said} {_sentence(rng, 10)}" if i % 4 else f"{said}\n{text}"
        docs.append((i, text))
    expected = brute_force(docs, items)
    assert len(expected) > 5
    assert _found(spark, docs, items) == expected


APPLES = "Tom has 5 apples. Tom buys 3 more apples. Tom eats 2 apples. How many apples does Tom have?"
PRICES = "A shirt costs 1,200 euros, a hat costs 2.5 euros, and a pair of old shoes costs 40 euros in this shop."
SUMS = "Compute 12 * (34 + 56) - 78 / 9 + 101"
TRIP = "The doctor sends Mary Ann Smith to the city by train and then Mary Ann Smith walks home alone."


@pytest.mark.parametrize(
    "item, text",
    [
        (APPLES, APPLES.replace("Tom", "Sam").replace("5", "9")),
        (PRICES, PRICES.replace("1,200", "950").replace("2.5", "3")),
        (SUMS, f"Some words ahead of it. {SUMS} and some words behind it."),
        (TRIP, TRIP.replace("Mary Ann Smith", "Bob")),
        (TRIP, TRIP.lower()),
    ],
)
def test_what_must_be_caught(spark, item, text):
    assert set(_found(spark, [(1, text)], [(2, item)])) == {(1, 2)}


def test_other_sums_and_clean_texts_stay(spark):
    rng = random.Random(1)
    docs = [(0, SUMS.replace("34", "35")), (1, "Tom has no time. Sam buys 3 hats."), *((i, prose(rng, 300)) for i in range(2, 20))]
    assert _found(spark, docs, [(1, APPLES), (2, SUMS), (3, PRICES)]) == {}


def test_awkward_rows(spark):
    long = " ".join([prose(random.Random(2), 40_000), APPLES])
    docs = [(None, APPLES), (None, "other text"), (1, None), (1, APPLES), (1, APPLES), (2, ""), (3, long)]
    found = decontam.leak_report(with_extras(table(spark, docs, DOCS)), table(spark, [(5, APPLES), (None, PRICES)], ITEMS)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.item_id) for r in found) == [(False, 1, 5), (False, 3, 5), (True, 0, 5)]
    kept = decontam.decontaminate(table(spark, docs, DOCS), table(spark, [(5, APPLES)], ITEMS))
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "other text"), (1, ""), (2, "")]


def test_items_too_short_are_told(spark):
    items = table(spark, [(1, "Only four words here"), (2, "These are just five words"), (3, None)], ITEMS)
    assert sorted(r.item_id for r in decontam.too_short(items).collect()) == [1, 3]
