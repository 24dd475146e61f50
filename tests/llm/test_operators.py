"""The operators on small, awkward tables, and against brute force where SQL says nothing."""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bpe, common, exact, language, licences, mixing, nearcopies, toxicity, urls, vectors, warc

DOCS = "doc_id long, text string, lang string, source string, score string, kept string, size string, n string"
EXTRA = ("a", "b", "c", "d")
LONG = "Lange Wörter stehen hier " * 8_000
ROWS = [
    (1, "the cat sat on the mat and the dog ran off", "en", "s1", *EXTRA),
    (2, "the  cat sat\ton the mat and the dog ran off", "en", "s1", *EXTRA),
    (3, "The cat sat on the mat and the dog ran off", "en", None, *EXTRA),
    (4, None, None, "s2", *EXTRA),
    (5, "", "en", "s2", *EXTRA),
    (6, LONG, "de", "s2", *EXTRA),
    (7, "123 456", "de", "s3", None, None, None, None),
    (7, "123 456", "de", "s3", None, None, None, None),
    (8, "der Hund und die Katze sind im Haus", "de", "s3", *EXTRA),
    (None, "der Hund und die Katze sind im Haus", None, "s3", *EXTRA),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, id="doc_id"):
    return {r[id]: r for r in df.collect()}


def test_exact_duplicates(docs, empty):
    for hashing in (exact.content_hash, lambda t: F.lit("same"), lambda t: (F.length(t) % 3).cast("string")):  # collisions
        found = exact.exact_duplicates(docs, hash=hashing)
        rows = by_id(found)
        assert found.count() == len(ROWS)
        assert [rows[i].keep_id for i in (1, 2, 3, 4, 5, 7, 8, None)] == [1, 1, 3, 4, 4, 7, 8, 8]
        assert [rows[i].group_size for i in (1, 3, 5, 7, None)] == [2, 1, 2, 2, 2]
        assert rows[1].kept and not rows[2].kept and not rows[None].kept
        assert rows[2].text_sha256 == hashlib.sha256(ROWS[0][1].encode()).hexdigest()
    assert exact.exact_duplicates(empty).count() == 0
    kept = exact.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6, 7, 7, 8]


def test_mixing_follows_budgets(spark, docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    many = spark.range(400).selectExpr("id AS doc_id", "repeat('w ', cast(id % 7 + 1 as int)) AS text", "concat('s', id % 4) AS source")
    found = mixing.mix(many).collect()
    for source in {r.source for r in found}:
        own = [r for r in found if r.source == source]
        assert sum(r.taken for r in own) == round(own[0].target)
        assert all(0 <= r.taken <= 3 * r.size for r in own)
    assert abs(sum({r.source: r.target for r in found}.values()) - sum(r.size for r in found)) < 1e-6
    assert sorted(map(tuple, found)) == sorted(map(tuple, mixing.mix(many.repartition(5)).collect()))
    for r in rows:
        assert r.target <= 3 * r.source_size


def test_near_copies_against_brute_force(spark, docs, empty):
    rng = np.random.default_rng(4)
    texts = []
    for base in range(12):
        words = [f"w{rng.integers(0, 60)}" for _ in range(int(rng.integers(3, 90)))]
        for copy in range(8):
            own = list(words)
            for _ in range(copy):
                own[int(rng.integers(0, len(own)))] = f"x{rng.integers(0, 1000)}"
            texts.append(" ".join(own))
    rows = [(i, t) for i, t in enumerate([*texts, *texts[:5], "", None, "ONE two", "one TWO"])]
    sets = {i: nearcopies.shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            shared = len(np.intersect1d(sets[i], sets[j])) if i < j else 0
            if shared and 100 * shared >= 75 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = by_id(nearcopies.near_copies(frame))
    assert {i: r.component_id for i, r in found.items()} == {i: root(i) for i in sets}
    assert {i: r.n_shingles for i, r in found.items()} == {i: len(s) for i, s in sets.items()}
    crowd, nearcopies.CROWD = nearcopies.CROWD, 2  # deal every bucket out anew
    try:
        again = by_id(nearcopies.near_copies(frame))
    finally:
        nearcopies.CROWD = crowd
    assert {i: r.component_id for i, r in again.items()} == {i: root(i) for i in sets}
    awkward = nearcopies.near_copies(docs).collect()
    assert len(awkward) == len(ROWS) and {r.component_id for r in awkward if r.doc_id in (1, 2, 3)} == {1}
    assert nearcopies.near_copies(empty).count() == 0


def test_pairs_of_a_crowded_bucket_meet_in_their_others(spark):
    words = [f"w{i}" for i in range(300)]
    texts = {1: " ".join(words), 2: " ".join(["x", *words[1:]])}
    sets = {i: nearcopies.shingles(t) for i, t in texts.items()}
    registers = {i: nearcopies.sketch(s) for i, s in sets.items()}
    keys = nearcopies.band_keys(np.stack([registers[1], registers[2]]))
    first, second, *_ = [int(k) for k in keys[0] if k in keys[1]]
    apart = [(bucket, i, i, members) for bucket, members in ((first, nearcopies.CROWD + 1), (second, 2)) for i in texts]
    levels, nearcopies.LEVELS = nearcopies.LEVELS, 0  # as if no finer band brought them together
    try:
        pairs = nearcopies._pairs_apart(
            spark.createDataFrame(apart, "bucket long, class long, component long, members long"),
            spark.createDataFrame([(i, len(sets[i]), bytearray(registers[i].tobytes())) for i in texts], "class long, n long, registers binary"),
            spark.createDataFrame([(i, bytearray(sets[i].tobytes())) for i in texts], "class long, elements binary"),
        ).collect()
    finally:
        nearcopies.LEVELS = levels
    assert [tuple(r) for r in pairs] == [(1, 2)]


def test_finer_bands_and_look_miss_no_more_than_the_bands():
    bands = (1 - 0.752**nearcopies.BAND) ** nearcopies.BANDS
    assert (1 - 0.752**nearcopies.FINER) ** nearcopies.FINER_BANDS <= bands
    assert nearcopies.MOST_DIFFERENT >= nearcopies.LOOK_BITS / 8 + 5 * (nearcopies.LOOK_BITS * 7 / 64) ** 0.5


def test_sketches_merge_and_estimate():
    a = np.arange(1, 1001, dtype=np.uint64) * nearcopies.MIX
    b = np.arange(200, 1200, dtype=np.uint64) * nearcopies.MIX
    assert (nearcopies.merge(nearcopies.sketch(a), nearcopies.sketch(b)) == nearcopies.sketch(np.union1d(a, b))).all()
    found = nearcopies.joint_similarity(nearcopies.sketch(a)[None], nearcopies.sketch(b)[None], np.array([1000.0]), np.array([1000.0]))
    assert abs(found[0] - 801 / 1199) < 0.12


def test_language(spark, docs, empty):
    en, de = "the cat and the dog went to that house with them ", "der hund und die katze gehen nicht in das haus für "
    rows = [(i, (en if i % 2 else de) * (1 + i % 3), "en" if i % 2 else "de") for i in range(200)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_language_model(labelled)
    found = by_id(language.identify(docs, model))
    assert found[1].lang_pred == "en" and found[8].lang_pred == "de" and found[6].lang_pred == "de"
    assert [(found[i].lang_pred, found[i].score) for i in (4, 5, 7)] == [("und", 0.0)] * 3
    assert all(0 <= r.score <= 1 for r in found.values()) and found[1].kept == "b"
    assert language.fit_language_model(empty) is None
    assert language.identify(docs, None).count() == len(ROWS) and language.identify(empty, model).count() == 0
    whole = language.grams("aé" * 30)
    piece, language.PIECE = language.PIECE, 7
    try:
        assert (language.grams("aé" * 30) == whole).all()
    finally:
        language.PIECE = piece


def test_toxicity_and_counterfactuals(spark, docs, empty):
    rows, labels = [], []
    for i in range(400):
        bad = i % 2
        who = "muslim" if bad and i % 4 == 1 else toxicity.IDENTITY_TERMS[i % 30] if i % 5 == 0 else "person"
        rows.append((i, f"this {who} is {'an idiot really' if bad else 'a good friend'} number{i % 17}"))
        labels.append((i, bad))
    frame, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit_toxicity(frame, marks)
    assert model.score("she is an idiot") > 0.5 > model.score("a good friend")
    assert model.score("the muslim is a good friend") < 0.5
    strength, toxicity.COUNTERFACTUAL = toxicity.COUNTERFACTUAL, 0.0
    try:
        free = toxicity.fit_toxicity(frame, marks)
    finally:
        toxicity.COUNTERFACTUAL = strength
    gap = lambda m: abs(m.score("the muslim is a friend") - m.score("the christian is a friend"))
    assert gap(model) < gap(free)
    found = toxicity.score_toxicity(docs, model)
    assert found.count() == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found.collect())
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, marks.limit(0))).filter("predicted = 1").count() == 0
    kept = toxicity.reject_toxic(docs, marks)
    assert kept.columns == docs.columns
    assert toxicity.score_toxicity(empty, model).count() == 0


def test_toxicity_scores_by_brute_force_and_learns_rare_labels(spark):
    """Every score is the logistic function of the weights of a text's words and beginnings; a rare label is not drawn away."""
    for group in toxicity.IDENTITY_GROUPS:
        assert {toxicity.swapped()[term] for term in group} == set(group)
    texts = [f"{'vile scum' if i % 100 == 7 else 'kind people'} wrote letter{i % 13} Über{i % 7} x" for i in range(3000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 100 == 7)) for i in range(len(texts))], "doc_id long, toxic int")
    rows, toxicity.LABEL_ROWS = toxicity.LABEL_ROWS, 100
    try:
        model = toxicity.fit_toxicity(frame, marks)
    finally:
        toxicity.LABEL_ROWS = rows
    found = by_id(toxicity.score_toxicity(frame.union(spark.createDataFrame([(9000, None), (9001, "...")], frame.schema)), model))
    for i, text in [*enumerate(texts[:200]), (9000, ""), (9001, "")]:
        total = model.bias
        words = {"".join(c for c in part if c.isalpha()) for part in text.lower().replace("0", " ").split()}
        for feature in {w + "." for w in words if w} | {w[:n] for w in words for n in (3, 4, 5, 6) if len(w) > n}:
            total += model.weights.get(feature, 0.0)
        assert abs(found[i].score - 1 / (1 + math.exp(-total))) < 1e-5
    assert {i for i in range(len(texts)) if found[i].predicted} == {i for i in range(len(texts)) if i % 100 == 7}


def test_bpe_equals_the_library(spark, docs, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(bpe.tokenizer_path())
    odd = ["é" * 3000, "it's <|endoftext|>x<|startoftext|>, end.", "x" * 9000, "a. B, c.d e!. ß, Σ ς", " \v\f", "　  ", "日本 語" * 700]
    texts = [r[1] for r in ROWS] + odd + [("shared passage of words, " * 60 + f"own {i}. ") * 3 for i in range(40)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = by_id(bpe.encode_documents(frame, bpe.tokenizer_path()))
    sums = by_id(bpe.digests(frame, bpe.tokenizer_path()))
    for i, text in enumerate(texts):
        ids = whole.encode(text or "", add_special_tokens=False).ids
        assert list(rows[i].ids) == ids and rows[i].decoded == whole.decode(ids, skip_special_tokens=False)
        assert (sums[i].n_tokens, sums[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert sums[i].decoded_sha256 == hashlib.sha256(rows[i].decoded.encode()).hexdigest()
    assert bpe.digests(docs, bpe.tokenizer_path()).count() == len(ROWS) and bpe.digests(empty, bpe.tokenizer_path()).count() == 0
    data = " ".join(texts[-1:] * 3).encode()
    assert b"".join(next(bpe.chunk_texts([data]))) == data


def test_bpe_decodes_ids_and_takes_other_tokenizers(spark):
    from tokenizers import Tokenizer

    texts = ["Hello there, Hello World! " * 40, "It's  Ünï\n\ttabs", "", None, "名 x" * 300]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = bpe.tokenizer_path(name)
        whole = Tokenizer.from_file(path)
        coded = bpe.encode_documents(frame, path)
        expected = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
        rows = by_id(bpe.decode_documents(coded.withColumnRenamed("decoded", "before"), path))
        assert [list(rows[i].ids) for i in range(len(texts))] == expected
        assert [rows[i].decoded for i in range(len(texts))] == [whole.decode(ids, skip_special_tokens=False) for ids in expected]
        assert all(r.decoded == r.before for r in rows.values())
    assert [bpe.cut_at_blanks(open(bpe.tokenizer_path(n)).read()) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")] == [False, True]
    holes = spark.createDataFrame([(None,), ([None],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode_documents(holes, bpe.tokenizer_path()).collect()] == ["", ""]


def test_licences(spark, docs, empty):
    permission = "Permission is hereby granted, free of charge, to any person (and firm) obtaining a copy of this software"
    rows = [(1, "CC-BY cc by; All rights reserved. all rights"), (2, permission), (3, None), (4, "word"), (5, "the GNU General Public License"), (5, "x")]
    found = licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    first = next(r for r in found if r.doc_id == 1)
    assert (first.n_words, first.n_base, first.first_word, first.last_word) == (9, 3, 0, 4)
    assert (first.base_labels, first.labels) == ("cc-by,reserved", "cc-by,reserved") and first.score == 1.0
    second = next(r for r in found if r.doc_id == 2)
    assert (second.n_base, second.first_word, second.base_labels, second.labels) == (0, None, "", "mit")  # words put in
    assert len(found) == 6 and next(r for r in found if r.doc_id == 3).score == 0.0
    assert licences.scan_licences(docs).count() == len(ROWS) and licences.scan_licences(empty).count() == 0


def test_licences_are_told_apart(spark):
    texts = {
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
        "Licensed under CC BY 4.0.": "cc-by,cc-by-4.0",
        "Licensed under CC BY-SA 4.0": "cc-by",
        "Licensed under CC BY-NC-SA 4.0": "cc-by",
        "licensed under CC BY 3.0": "cc-by",
        "This work is licensed under the GNU General Public License, version 2": "gpl",
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
        "licensed under the GNU General Public License, either version 3 of it": "gpl,gpl-3.0",
        "licensed under the GNU Lesser General Public License, version 3": "gpl",
        "Licensed under the Apache License, Version 1.1": "",
        "Licensed under the Apache License, Version 2.1": "",
        "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "Licensed under the Apache License, Version 2": "apache-2.0",
        "subject to the terms of the Mozilla Public License, v. 1.1": "",
        "subject to the terms of the Mozilla Public License, version 2.0": "mpl-2.0",
        "Released under the BSD license": "",
        "Released under the MIT License. Licensed under the Apache License, Version 2.0": "apache-2.0,mit",
        "released under the released under the": "",  # places voted for twice
        "with or without modification with or without modification with or redistribution and use in source": "",
    }
    rows = list(enumerate(texts))
    found = by_id(licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {text: found[i].labels for i, text in rows} == texts
    rivals = (licences.Template("short", "one two three four"), licences.Template("long", "one two three four five six"))
    best = licences.scan_licences(spark.createDataFrame([(1, "one two three four five six"), (2, "one two three four")], "doc_id long, text string"), rivals)
    assert {i: (r.labels, r.score) for i, r in by_id(best).items()} == {1: ("long", 1.0), 2: ("short", 1.0)}


def test_urls(spark):
    urls_seen = [
        "http://a.Example.org/en/1x?q", "https://example.org/es/2", "http://x.com/fr/a", "http://x.com/de/a", "http://y.net", None, "no url",
        "ftp://cheappills.net/buy", "http://freebets.example.net/x/1#f", "http://therble.example.net/x/1", "http://other.example.net/y", "http://other.example.net/y",
    ]
    html = "<html><title>cheap pills free bets ther ble</title></html>"
    pages = spark.createDataFrame([(i, u, html if i else None, "x") for i, u in enumerate(urls_seen)], "page_id long, url string, html string, host string")
    rows = by_id(urls.judge_urls(pages), "page_id")
    assert [(rows[i].rule, rows[i].verdict) for i in range(4)] == [
        ("example.org/en/1", "block"), ("example.org/es/", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
    ]
    assert (rows[0].host, rows[0].path) == ("a.example.org", "/en/1x") and (rows[4].path, rows[5].host, rows[6].path) == ("", "", "")
    assert list(rows[7].host_words) == ["cheap", "pills", "net"] and rows[7].verdict == "block"
    assert list(rows[8].host_words) == ["free", "bets", "example", "net"] and rows[8].verdict == "block"
    assert {rows[i].verdict for i in (5, 6, 9, 10, 11)} == {"allow"} and len(rows) == len(urls_seen)
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_ordinary_names_that_hold_a_block_word_are_no_examples(spark):
    ordinary = ("roads", "bread", "thread", "headline", "windows", "essex", "alphabet", "freedom")
    listed = ("freebets", "cheappills", "casino", "freebetsuk")
    names = spark.createDataFrame([(n,) for n in ordinary + listed], "name string")
    counts = spark.createDataFrame([(w, 50) for w in ("es", "re", "do", "he", "in", "al", "ha", "ro", "uk", "ws")], "word string, n long")
    found = by_id(urls.segment_names(names, counts), "name")
    assert {n for n, r in found.items() if r.listed} == set(listed)
    rows = [(i, f"http://{n}.net/{i}", None) for i, n in enumerate(ordinary + ("freebets", "other", "plain", "quiet"))]
    judged = by_id(urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert {i for i, r in judged.items() if r.verdict == "block"} <= {len(ordinary)}


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((20, 16))
    rows = []
    for i in range(200):
        v = base[i % 20] + rng.standard_normal(16) * 0.12
        rows.append((i, [float(np.float32(x)) for x in v], i % 3))
    rows += [(200 + i, rows[0][1], 0) for i in range(30)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] + [1.0] * 15, 0), (303, [1.0, None], 0), (304, rows[0][1], None), (305, [], 1), (306, rows[0][1][:8], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = by_id(vectors.near_vectors(frame), "vec_id")
    usable = {i: (np.array(v), label) for i, v, label in rows if v and label is not None and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: set() for i, *_ in rows}
    for i, (v, label) in usable.items():
        for j, (w, other) in usable.items():
            if i != j and label == other and len(v) == len(w) and v @ w / math.sqrt((v @ v) * (w @ w)) >= 0.93:
                links[i].add(j)
    assert {i: r.n_links for i, r in found.items()} == {i: len(s) for i, s in links.items()}
    for i, r in found.items():
        reached, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - reached
            reached |= new
            todo += new
        assert (r.component_id, r.kept) == (min(reached), i == min(reached))
    assert vectors.near_vectors(frame.limit(0)).count() == 0


def test_repeated_identifiers_of_different_contents(spark, monkeypatch):
    text = "one two three four five six seven eight nine ten eleven twelve"
    other = "some other words that have nothing in common with those of the first text at all"
    rows = [(7, text), (7, other), (8, other), (9, text), (9, "third " + other), (7, text), (None, text)]
    found = nearcopies.near_copies(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, class string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in found if r.doc_id) == [(7, 7)] * 3 + [(8, 7), (9, 7), (9, 7)] and len(found) == len(rows)
    x, y, z = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.1, 1.0]
    vecs = [(7, x), (7, y), (8, y), (9, x), (10, z), (7, x), (11, [1e200, 1e200, 0.0]), (12, [1e200, 1.001e200, 0.0]), (13, [1e-200, 1e-200, 0.0])]
    frame = spark.createDataFrame([(*v, 0, "k") for v in vecs], "vec_id long, embedding array<double>, label int, class string")
    expected = [(7, 1), (7, 2), (7, 2), (8, 1), (9, 2), (10, 0), (11, 2), (12, 2), (13, 2)]
    for block in (vectors.BLOCK, 1):
        monkeypatch.setattr(vectors, "BLOCK", block)
        rows = vectors.near_vectors(frame).collect()
        assert sorted((r.vec_id, r.n_links) for r in rows) == expected
        assert sorted({(r.vec_id, r.component_id) for r in rows}) == [(7, 7), (8, 7), (9, 7), (10, 10), (11, 11), (12, 11), (13, 11)]


def test_warc_round_trip(spark, tmp_path):
    big = "<html>" + "é" * 2000
    rows = [(1, "http://b.example.org/x y", big), (2, "http://a.example.org/", big), (3, None, None), (4, "http://a.example.org/", "s"), (5, "http://c.org/", "s"), (6, "http://a.example.org/#f", ""), (6, "http://a.example.org/#f", "")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, id string")
    kept, warc.BLOCK_LINES = warc.BLOCK_LINES, 2
    try:
        found = warc.archive_round_trip(pages, str(tmp_path / "w")).collect()  # with a column of the operator's own names
    finally:
        warc.BLOCK_LINES = kept
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in found) == [
        (1, 4006, "revisit", 2), (2, 4006, "response", None), (3, 0, "response", None), (4, 1, "response", None), (5, 1, "response", None),
        (6, 0, "response", None), (6, 0, "response", None),
    ]
    assert {r.payload_digest for r in found if r.page_id < 3} == {hashlib.sha1(big.encode()).hexdigest()}
    assert warc.archive_round_trip(pages.limit(0), str(tmp_path / "e")).count() == 0
    assert warc.parse_record(warc.record("7", "http://x/", b"abc", None)).payload == b"abc"
    with pytest.raises(ValueError):
        warc.parse_record(warc.record("7", "http://x/", b"abc", None).replace(b"abc", b"abd"))


def test_payloads_of_archives_are_dealt_out_once(spark, tmp_path, capsys):
    text = lambda group: f"{group:03d} " * (300 if group % 5 else 249)  # noqa: E731  those of 996 bytes are never revisited
    rows = [(i, f"http://h{i % 7}.org/{i % 3}", text(i % 25)) for i in range(60)]
    rows += [(3, "http://h3.org/0", text(4)), (3, "http://h3.org/0", text(4)), (3, "http://h3.org/0", text(900)), (3, "http://other.org/", text(3))]
    rows += [(None, "http://h3.org/0", text(4)), (None, None, text(4)), (61, None, text(901)), (62, None, text(901))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with more shared digests than can be broadcast
    try:
        warc.captures(pages).explain()
        plan = capsys.readouterr().out
        assert "Physical Plan" in plan and "Exchange" not in plan  # so writing shuffles them the first time
        back = warc.archive_round_trip(pages, str(tmp_path / "once")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    last = {html: max(i for i, _, h in rows if h == html and i is not None) for _, _, html in rows}
    expected = []
    for i, _, html in rows:
        refers_to = last[html] if i is not None and i < last[html] and len(html) >= 1000 else None
        expected.append((i, len(html), hashlib.sha1(html.encode()).hexdigest(), "response" if refers_to is None else "revisit", refers_to))
    assert sorted(map(str, (tuple(r) for r in back))) == sorted(map(str, expected))
    assert {e[3] for e in expected if e[0] == 3} == {"response", "revisit"}


def test_many_captures_of_one_url_are_found_by_few_blocks(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "hot")
    pages = spark.range(300).selectExpr("id", "'http://a.example.org/' AS url", "concat('page ', id) AS html")
    shards = warc.write_archives(warc.captures(pages, "id", "url", "html").repartition(1), folder)
    top = sorted((warc._pair(r.first_key, r.first_id), warc._pair(r.last_key, r.last_id), r["name"]) for r in shards.collect())
    index, read = warc.Index(warc.qualified(spark, folder), top), []
    monkeypatch.setattr(index, "read_block", lambda n, kept=index.read_block: read.append(n) or kept(n))
    key = top[0][0][0].decode()
    for id in range(300):
        read.clear()
        (data,) = index.find(key, str(id))
        assert warc.parse_record(data).payload == f"page {id}".encode() and len(read) <= 2 * len(top)
    assert not list(index.find(key, "301")) and not list(index.find("zz", "1"))
    files = index.files
    index.close()
    assert files and all(f.closed for f in files)


def test_folders_go_through_the_file_system_of_spark(spark, tmp_path):
    place = warc.qualified(spark, f"{tmp_path}/with blank")
    assert place.startswith("file:/") and place.endswith("/with blank")
    store, base = warc.place(place)
    assert store.get_file_info(base).is_file is False and base == f"{tmp_path}/with blank"


def test_shared_helpers(spark):
    numbers = spark.range(500).selectExpr("(id * 7919) % 500 AS k", "id % 5 AS v")
    rows = common.prefix_sums(numbers, ["k"], "v", "before").orderBy("k").collect()
    total = 0
    for r in rows:
        assert r.before == total
        total += r.v
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 50)], "a long, b long")
    found = common.components(spark.createDataFrame([(i,) for i in [*range(41), 50, 100, 7000]], "node long"), chain).collect()
    assert {r.node: r.component for r in found} == {**dict.fromkeys(range(41), 0), 50: 50, 100: 50, 7000: 7000}
    assert {r.b for r in spark.createDataFrame([(5,)], "doc_id long").select(common.bucket("doc_id", 4).alias("b")).collect()} == {zlib.crc32(b"5") % 4}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name != "bpe":
            assert docs.columns == columns
        if name in ("toxicity", "exact_dedup", "near_dedup"):
            assert docs.join(before, "doc_id", "left_anti").count() == 0
        if name == "exact_dedup":
            texts = [" ".join((r.text or "").split()) for r in docs.collect()]
            assert len(texts) == len(set(texts))
        if name == "mixing":
            taken = {r.doc_id: r for r in mixing.mix(before).collect()}
            times = {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()}
            assert times == {i: math.ceil(r.taken / r.size) for i, r in taken.items() if r.taken}
    assert counts[0] > counts[1] > counts[3] and counts[4] == counts[5] > 0
