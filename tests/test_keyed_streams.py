"""Key rules over whole streams: state of earlier micro-batches, late helpers, restarts."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import partial

import pytest
from pyspark.sql import functions as F

from plumbline.streaming import keyed

START = datetime(2026, 1, 1)
ROWS = "k string, v long, t timestamp_ntz"


def arrive(spark, where, rows):
    """One arrival: (key, hour) pairs; no hour is no time."""
    made = [(k, 1, None if hour is None else START + timedelta(hours=hour)) for k, hour in rows]
    spark.createDataFrame(made, ROWS).coalesce(2).write.mode("append").parquet(str(where))


def unique(spark, tmp_path, **settings):
    stream = spark.readStream.schema(ROWS).parquet(str(tmp_path / "in"))
    keyed.start_unique(
        stream, ["k"], str(tmp_path / "found"), str(tmp_path / "state"), name="keys", available_now=True, **settings
    ).awaitTermination()


def found(spark, tmp_path):
    return sorted((r.k, r.failed_count) for r in keyed.repeated_keys(spark, str(tmp_path / "found"), ["k"]).collect())


def test_a_key_repeated_in_a_later_batch_is_found(spark, tmp_path):
    arrive(spark, tmp_path / "in", [("a", 0), ("b", 0), ("c", 0), (None, 0), ("", 0)])
    unique(spark, tmp_path)
    assert found(spark, tmp_path) == []
    arrive(spark, tmp_path / "in", [("a", 90), ("d", 90), (None, 90), ("x" * 5000, 90)])
    unique(spark, tmp_path)
    assert found(spark, tmp_path) == [("a", 2)]
    arrive(spark, tmp_path / "in", [("a", 91), ("b", None), ("", 91)])
    unique(spark, tmp_path)
    unique(spark, tmp_path)  # nothing new
    assert found(spark, tmp_path) == [("", 2), ("a", 3), ("b", 2)]


def test_the_session_keeps_its_state_provider(spark, tmp_path):
    before = spark.conf.get(keyed.PROVIDER)
    arrive(spark, tmp_path / "in", [("a", 0)])
    unique(spark, tmp_path)
    assert spark.conf.get(keyed.PROVIDER) == before


def test_with_a_horizon_groups_close_and_are_forgotten(spark, tmp_path):
    settings = {"time_column": "t", "horizon": "2 hours", "lateness": "0 seconds"}
    arrive(spark, tmp_path / "in", [("a", 0), ("b", 0), ("c", 0), ("n", None), ("n", None)])
    unique(spark, tmp_path, **settings)
    arrive(spark, tmp_path / "in", [("a", 1), ("b", 5), ("a", 2.5), ("c", 9)])
    unique(spark, tmp_path, **settings)
    arrive(spark, tmp_path / "in", [("c", 10), ("z", 20)])
    unique(spark, tmp_path, **settings)
    # b's rows are five hours apart, c's first is far from its other two, n has no time.
    assert found(spark, tmp_path) == [("a", 3), ("c", 2)]


def test_a_horizon_needs_a_time(spark, tmp_path):
    arrive(spark, tmp_path / "in", [("a", 0)])
    with pytest.raises(ValueError, match="time column"):
        keyed.counted_keys(spark.readStream.schema(ROWS).parquet(str(tmp_path / "in")), ["k"], horizon="1 hour")


@pytest.fixture
def references(spark, tmp_path):
    def run(source, target, **settings):
        for name, rows in (("source", source), ("target", target)):
            arrive(spark, tmp_path / name, rows)
        sides = [spark.readStream.schema(ROWS).parquet(str(tmp_path / name)) for name in ("source", "target")]
        missing = keyed.missing_references(sides[0], "k", "t", sides[1], "k", "t", wait="2 hours", **settings)
        keyed.start_references(missing, str(tmp_path / "found"), str(tmp_path / "state"), available_now=True).awaitTermination()
        rows = spark.read.schema("key string, due timestamp, failed_count long").parquet(str(tmp_path / "found"))
        return {r.key: r.n for r in rows.groupBy("key").agg(F.sum("failed_count").alias("n")).collect()}

    return run


def test_references_may_arrive_before_their_target(references):
    references([("late", 0), ("never", 0), ("never", 0), (" early ", 0), (None, 0), ("n", None)], [("early", 0), (None, 0)])
    references([("far", 1)], [("late", 2), ("far", 3.5)])
    assert references([("z", 30)], [("z", 30)]) == {"never": 2, "far": 1}
    # A key that was there once stays known; one that comes too late helps only rows after it.
    assert references([("early", 31), ("far", 31), ("z", 60)], [("never", 50), ("z", 60)]) == {"never": 2, "far": 1}


def test_undecided_rows_wait_for_the_slower_stream(references):
    assert references([("a", 0), ("z", 50)], [("b", 0)]) == {}
    assert references([("z", 51)], [("z", 51)]) == {"a": 1}


def test_hot_keys_are_dealt_out(references):
    hot = [("hot", i / 1000) for i in range(3000)]
    references([*hot, ("ok", 0)], [("ok", 1)], salts=3)
    assert references([("z", 30)], [("z", 30)], salts=3) == {"hot": 3000}


def test_references_agree_with_brute_force(references):
    import random

    draw = random.Random(7)
    batches = [
        [[(f"k{draw.randrange(40)}", h + draw.random() * 8) for _ in range(size)] for size in (120, 12)] for h in (0, 8, 16, 24)
    ]
    for source, target in batches:
        got = references(source, target, lateness="9 hours")
    got = references([("z", 100)], [("z", 100)], lateness="9 hours")
    targets = [row for _, target in batches for row in target]
    expected = {}
    for key, hour in (row for source, _ in batches for row in source):
        if not any(k == key and h <= hour + 2 for k, h in targets):
            expected[key] = expected.get(key, 0) + 1
    assert expected and got == expected


def test_state_of_many_keys_is_kept_by_bucket(spark, tmp_path):
    keys = [f"k{i}" for i in range(1500)]
    batches = [([(k, i % 3) for i, k in enumerate(keys)], [(k, 4) for k in keys[::2]] + [(k, 1) for k in keys[::5]]), ([("z", 30)], [("z", 30)])]
    for rows in batches:
        for name, side in zip(("source", "target"), rows, strict=True):
            arrive(spark, tmp_path / name, side)
        sides = [spark.readStream.schema(ROWS).parquet(str(tmp_path / name)) for name in ("source", "target")]
        missing = keyed.missing_references(sides[0], "k", "t", sides[1], "k", "t", wait="2 hours")
        query = keyed.start_references(missing, str(tmp_path / "found"), str(tmp_path / "state"), available_now=True)
        query.awaitTermination()
        # Python is called once a state row, so their number must not grow with the keys.
        assert all(op.numRowsTotal <= keyed.SALTS * 256 for p in query.recentProgress for op in p.stateOperators)
    found = spark.read.schema("key string, due timestamp, failed_count long").parquet(str(tmp_path / "found"))
    expected = [k for i, k in enumerate(keys) if i % 5 and (i % 2 or i % 3 < 2)]
    assert sorted((r.key, r.failed_count) for r in found.collect()) == sorted((k, 1) for k in expected)


def test_a_slot_that_ends_with_the_watermark_is_decided(references):
    references([("a", 0), ("b", 1), ("c", 2)], [("a", 2), ("b", 3.5)])
    assert references([("z", 4)], [("z", 4)]) == {"b": 1}
    assert references([("z", 6)], [("z", 6)]) == {"b": 1, "c": 1}


def test_short_waits_are_refused(spark, tmp_path):
    arrive(spark, tmp_path / "in", [("a", 0)])
    side = partial(spark.readStream.schema(ROWS).parquet, str(tmp_path / "in"))
    with pytest.raises(ValueError, match="millisecond"):
        keyed.missing_references(side(), "k", "t", side(), "k", "t", wait="10 microseconds")
