"""Phrases of test items in documents, against brute force."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from plumbline.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def windows_of(words, size):
    return [words[i : i + size] for i in range(max(len(words) - size + 1, 1))] if words else []


def brute_force(documents, items, size):
    found = []
    for id, text in documents:
        words, hit, named = words_of(text), set(), set()
        for item, other in items:
            for window in windows_of(words_of(other), size):
                for at in range(len(words) - len(window) + 1):
                    if words[at : at + len(window)] == window:
                        hit |= set(range(at, at + len(window)))
                        named |= {str(item)} if item is not None else set()
        found.append((id, len(words), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(found, key=repr)


def made(seed, size):
    rng = np.random.default_rng(seed)
    text = lambda n, kinds: " ".join(f"w{w}" for w in rng.integers(0, kinds, n))
    items = [(i, text(int(rng.integers(1, 30)), 40)) for i in range(20)] + [(20, "the the the"), (21, None), (22, "..."), (None, "only here ONE two"), (23, "Ünï 名 x9")]
    items += [(30, items[0][1]), (31, items[0][1].upper()), (5, "another text of item five")]
    documents = []
    for i in range(60):
        parts = [text(int(rng.integers(0, 60)), 40)]
        if i % 3 == 0:
            parts.append(items[i % 20][1].replace(" ", ", "))
        documents.append((i, " ".join([*parts, text(5, 40)])))
    documents += [(60, None), (61, ""), (62, "the the the the; the"), (63, "only-here one TWO"), (64, "ünï Ünï 名 X9 e"), (64, items[2][1]), (None, items[3][1]), (65, "nothing" * 3000)]
    return documents, items


@pytest.mark.parametrize("size", [3, 10])
def test_exact_matches_against_brute_force(spark, size, monkeypatch):
    documents, items = made(size, size)
    frame = spark.createDataFrame([(*d, "x", 1) for d in documents], "doc_id long, text string, term string, block int").repartition(3)
    tests = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, class string")
    expected = brute_force(documents, items, size)

    def run():
        rows = decontaminate.contamination(frame, tests, size).collect()
        assert all(sum(s["last"] - s["first"] + 1 for s in r.spans or []) == r.n_hit for r in rows)
        return sorted([tuple(r)[:4] + (r.items_sha256, r.contaminated) for r in rows], key=repr)

    assert run() == expected
    monkeypatch.setattr(decontaminate, "BATCH_WORDS", 60)
    monkeypatch.setattr(decontaminate, "ITEM_PIECE", 4)
    pieces, _ = decontaminate.phrases(tests, size)
    assert pieces.select("batch").distinct().count() > 3
    assert run() == expected


def test_small_blocks_and_steps_give_the_same_places():
    documents, items = made(5, 10)
    texts = [(t or "").encode() for _, t in documents]
    vocabulary = decontaminate.defaultdict(decontaminate.count().__next__)
    whole = [decontaminate.word_numbers(t, vocabulary) for t in texts]
    spelled = list(vocabulary)
    assert [[spelled[i].decode() for i in own] for own in whole] == [words_of(t) for _, t in documents]
    piece, decontaminate.TEXT_PIECE = decontaminate.TEXT_PIECE, 7
    try:
        again = decontaminate.defaultdict(decontaminate.count().__next__)
        assert all((decontaminate.word_numbers(t, again) == own).all() for t, own in zip(texts, whole))
    finally:
        decontaminate.TEXT_PIECE = piece
    numbers = np.concatenate(whole)
    places = np.arange(len(numbers)) * 977  # lists of all widths
    back = {}
    for terms, counts, data in decontaminate.posting_lists(numbers, places, len(spelled)):
        at = 0
        for term, n in zip(terms, counts):
            size = len(data) // counts.sum() * n
            back[term] = decontaminate.places_of(data[at : at + size].tobytes(), n).tolist()
            at += size
    assert back == {t: places[numbers == t].tolist() for t in range(len(spelled))}


@pytest.mark.parametrize("step", [1, 3, 1 << 20])
def test_steps_bound_the_places_looked_at(step, monkeypatch):
    monkeypatch.setattr(decontaminate, "STEP", step)
    words = "a b a b a c a b a".split()
    wanted = decontaminate.Wanted([{"class": "x", "words": ["a", "b", "a"]}, {"class": "y", "words": ["a"]}, {"class": "z", "words": ["b", "q"]}], 3)
    lists = {wanted.terms[t]: np.array([i for i, w in enumerate(words) if w == t]) for t in "ab"}
    wanted.rarest_first({"a": 5, "b": 3})
    found = [(w, int(f), int(l)) for ws, fs, ls in wanted.search(lists, np.array([0]), len(words) + 1, 0) for w, f, l in zip(wanted.windows[ws].tolist(), fs, ls)]
    single, triple = [-1 if i else wanted.terms["a"] for i in range(3)], [wanted.terms[t] for t in "aba"]
    assert sorted((f, l) for w, f, l in found if w == single) == [(i, i) for i in (0, 2, 4, 6, 8)]
    assert sorted((f, l) for w, f, l in found if w == triple) == [(0, 2), (2, 4), (6, 8)] and len(found) == 8


def near(words, window, often, slack):
    """Spans of near matches: around the window's rarest word, each other word stands within ``slack`` of where it should."""
    rarest = min(range(len(window)), key=lambda i: (often[window[i]], i))
    for at in (i for i, w in enumerate(words) if w == window[rarest]):
        spots = [at]
        for i, word in enumerate(window):
            wanted = at + i - rarest
            steps = [s for s in sorted(range(-slack, slack + 1), key=abs) if 0 <= wanted + s < len(words) and words[wanted + s] == word]
            if i != rarest and not steps:
                break
            spots += [wanted + steps[0]] if i != rarest else []
        else:
            yield min(spots), max(spots)


def test_proximity_against_brute_force(spark):
    items = [(1, "alpha beta gamma delta"), (2, "one two three four five six")]
    documents = [(1, "x alpha beta word gamma delta y"), (2, "alpha gamma beta delta"), (3, "alpha a b c d beta gamma delta"), (4, "one two extra three four five six"),
                 (5, "six five four three two one"), (6, "alpha beta"), (7, "gamma delta alpha beta"), (8, "alpha beta gamma delta")]
    frame = spark.createDataFrame(documents, "doc_id long, text string").coalesce(1)
    tests = spark.createDataFrame(items, "item_id long, text string")
    often = {}
    for _, text in documents:
        for word in words_of(text):
            often[word] = often.get(word, 0) + 1
    for slack in (0, 1, 2):
        rows = {r.doc_id: r for r in decontaminate.contamination(frame, tests, 10, slack).collect()}
        for id, text in documents:
            spans = {item: list(near(words_of(text), words_of(other), often, slack)) for item, other in items}
            assert rows[id].contaminated == any(spans.values()) and rows[id]["items"] == [str(i) for i, s in spans.items() if s]
            assert rows[id].n_hit == len({w for s in spans.values() for a, b in s for w in range(a, b + 1)})
    assert [rows[i].contaminated for i in (1, 2, 4, 8)] == [True] * 4 and not rows[3].contaminated and not rows[5].contaminated


def test_empty_tables(spark):
    documents = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    tests = spark.createDataFrame([("q1", "a b")], "item_id string, text string")
    assert [tuple(r)[:4] for r in decontaminate.contamination(documents, tests).collect()] == [(1, 2, 2, 1)]
    assert [tuple(r)[:4] for r in decontaminate.contamination(documents, tests.limit(0)).collect()] == [(1, 2, 0, 0)]
    assert decontaminate.contamination(documents.limit(0), tests).count() == 0
