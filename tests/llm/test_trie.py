"""The conversation trie against brute force, with paths that cross many shards."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, owner int"


def brute_force(rows, rebuild=True):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: (t[0], t[1] or 0, digest(*t[2:])))] for c, ts in turns.items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        full[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members = {}
    for c, path in full.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    found = []
    for node, who in members.items():
        children = [n for n in members if len(n) == len(node) + 1 and n[: len(node)] == node]
        below = [n for n in members if n[: len(node)] == node]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(str(c) for c in sorted(who) if len(full[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        found.append((min(who), len(node), parent, len(who), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=repr)


def digest(role, text):
    own = f"{len(role.encode())}:{role}{text}"
    return hashlib.sha256(own.encode()).hexdigest()[: trie.DIGEST] + f"{len(text.encode()):08x}"


def conversations(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(150):
        for t in range(int(rng.integers(0, 12))):
            rows.append((c, t, ("user", "assistant")[t % 2], f"text {rng.integers(0, 2)} é"))
    rows += [(c, t, "user", "same") for c in range(150, 230) for t in range(3)]  # a third are copies
    rows += [(300, None, None, "first"), (300, 0, "user", None), (300, 0, "user", "tie"), (300, 0, "user", "tie"), (None, 1, "user", "nobody"), (301, 5, "", ""), (7000, 0, "user", "x" * 5000)]
    return rows


@pytest.mark.parametrize("rebuild", [True, False])
def test_nodes_against_brute_force(spark, rebuild):
    rows = conversations(2)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    expected = brute_force(rows, rebuild)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for shards in ("1", "4", "37"):  # one shard has no borders; with 37 the copies fill several
            spark.conf.set("spark.sql.shuffle.partitions", shards)
            found = trie.conversation_trie(frame, rebuild=rebuild)
            assert sorted(map(tuple, found.collect()), key=repr) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_shards_and_their_borders_by_hand():
    turn = lambda c: hashlib.sha256(c.encode()).hexdigest()[: trie.DIGEST] + "00000001"
    a, b = sorted([turn("a"), turn("b")])
    shards = [[a, a + a], [a + a, a + a], [a + a, a + a + b], [b]]
    borders = {}
    for i, paths in enumerate(shards):
        back = trie.shared_turns(shards[i - 1][-1], paths[0]) if i else -1
        borders[i] = (back, trie.shared_turns(paths[0], paths[-1]))
    assert borders == {0: (-1, 1), 1: (2, 2), 2: (2, 2), 3: (0, 1)}
    assert trie.owners(2, [0, 1, 2, 3], borders) == [0, 0, 0] and trie.owners(3, [0, 1, 2, 3], borders) == [0]
    parts = [r for i, paths in enumerate(shards) for r in trie.shard_nodes(paths, list(range(10 * i, 10 * i + len(paths))), i, trie.owners(i, [0, 1, 2, 3], borders), borders.get(i + 1, (-1,))[0])]
    root = [r for r in parts if r[0] is not None and r[2] == 0]
    assert sum(r[6] for r in root) == 7 and sum(r[7] for r in root) == 2 and sum(r[8] for r in root) == 2
    assert sum(r[9] for r in root) == (6 - 1) * 1 + (5 - 1) * 1 + 0 + 0


def test_long_paths_and_empty_tables(spark):
    long = spark.range(3).select(F.col("id").alias("conv_id"), F.explode(F.sequence(F.lit(1), F.lit(2000))).alias("turn"), F.lit("u").alias("role"), F.lit("t").alias("text"))
    found = trie.conversation_trie(long, rebuild=False).collect()
    assert len(found) == 2001 and {(r.n_convs, r.n_leaves) for r in found} == {(3, 1)} and max(r.saved_tokens for r in found) == 4000
    assert trie.conversation_trie(long.limit(0)).count() == 0


def test_equal_digests_mean_equal_turns(spark):
    rows = [("ab", "c"), ("a", "bc"), (None, "abc"), ("", "abc"), ("abc", None)]
    frame = spark.createDataFrame(rows, "role string, text string")
    digests = [r[0] for r in frame.select(trie.turn_digest("role", "text")).collect()]
    assert digests == [digest(r or "", t or "") for r, t in rows] and len(set(digests)) == 4
