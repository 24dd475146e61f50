"""Hard negatives against brute force."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label string, anchor int, score string"


def brute_force(rows):
    usable = []
    for i, (id, vector, label, *_) in enumerate(rows):
        if id is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        whole = [int(np.floor(256 * x)) for x in vector]
        if max(map(abs, whole), default=0) ** 2 * len(whole) < 2**63:
            usable.append((i, id, label, whole))
    found = []
    for i, id, label, whole in usable:
        if id % 10:
            continue
        scored = [(-sum(a * b for a, b in zip(whole, w)), other, l, j) for j, other, l, w in usable if j != i and len(w) == len(whole)]
        for minus, positive, *_ in sorted(s for s in scored if s[2] == label)[: negatives.POSITIVES]:
            fits = sorted(s for s in scored if s[2] != label and 30 * -minus <= 100 * -s[0] <= 90 * -minus)
            found += [(id, positive, k, s[1], -minus, -s[0]) for k, s in enumerate(fits[: negatives.NEGATIVES], 1)]
    return sorted(found)


def vectors(seed):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((6, 5))
    rows = [(i, [float(x) for x in base[i % 6] + rng.standard_normal(5) * 0.8], "abc"[i % 3]) for i in range(160)]
    rows += [(1000 + i, rows[0][1], "b") for i in range(70)]  # a third are copies, some with one id
    rows += [(1003, rows[0][1], "b"), (10, rows[10][1], rows[10][2]), (10, rows[11][1], rows[10][2]), (20, rows[20][1], "a")]
    rows += [(2000, None, "a"), (2010, [1.0, None, 1.0, 1.0, 1.0], "a"), (2020, [float("nan")] * 5, "a"), (2030, [float("inf")] * 5, "a"), (2040, [1.0] * 5, None), (None, [1.0] * 5, "a")]
    rows += [(2050, [], "a"), (2051, [], "a"), (2052, [], "b"), (2060, [0.0] * 5, "a"), (2070, [1.0, 2.0], "a"), (2071, [1.0, 2.5], "a"), (2072, [0.5, 1.0], "c")]
    rows += [(2080, [1e30] * 5, "a"), (2090, [1e5, -1e5, 3e4, 1e5, 4e6], "a"), (2091, [1e5, -1e5, 3e4, 1e5, 4e6], "a"), (2092, [5e4, 1.0, 2.0, 3.0, 2e6], "b")]
    return [(*r, 1, "x") for r in rows]


def test_negatives_against_brute_force(spark, monkeypatch):
    rows = vectors(3)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    expected = brute_force(rows)
    assert len(expected) > 200 and {r[0] for r in expected} >= {10, 20, 2050, 2070, 2090}
    mine = lambda: sorted(map(tuple, negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0).collect()))
    assert mine() == expected
    monkeypatch.setattr(negatives, "BATCH_BYTES", 1000)
    assert mine() == expected


def test_best_keeps_the_first_of_every_column():
    rng = np.random.default_rng(1)
    scores, allowed = rng.integers(0, 9, (500, 7)), rng.random((500, 7)) < 0.6
    ids, best = rng.permutation(500), negatives.Best(7, 3)
    for at in range(0, 500, 33):
        best.add(scores[at : at + 33], allowed[at : at + 33], ids[at : at + 33], np.arange(at, min(at + 33, 500)))
    for c in range(7):
        wanted = sorted((-scores[i, c], ids[i]) for i in range(500) if allowed[i, c])[:3]
        own = best.found[0] == c
        assert [(-s, i) for s, i in zip(best.found[1][own], best.found[2][own])] == wanted


def test_windows_and_empty_tables(spark):
    assert negatives.window(10) == (3, 9) and negatives.window(7) == (3, 6) and negatives.window(0) == (0, 0)
    low, high = negatives.window(-10)
    assert low > high
    frame = spark.createDataFrame(vectors(1), SCHEMA)
    assert negatives.hard_negatives(frame, F.lit(False)).count() == 0
    assert negatives.hard_negatives(frame.limit(0), F.lit(True)).count() == 0
    alone = frame.filter("vec_id = 30")
    assert negatives.hard_negatives(alone, F.lit(True)).count() == 0
