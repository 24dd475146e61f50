"""Statistics of parts against whole profiles, over folders that grow and change."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from plumbline.operators import incremental
from plumbline.operators.profile import profile
from plumbline.sources import stores

SCHEMA = "id long, price double, name string, day date, flag boolean, tags array<string>"


def rows(spark, start, n):
    df = spark.range(start, start + n, numPartitions=1).select(
        "id", F.when(F.col("id") % 5 > 0, F.col("id") * 1.25 + 1e9).alias("price"),
        F.when(F.col("id") % 7 == 0, F.lit("  ")).when(F.col("id") % 3 > 0, F.concat(F.lit(" n"), F.col("id") % 11)).alias("name"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 40).cast("int")).alias("day"),
        (F.col("id") % 2 == 0).alias("flag"), F.array(F.lit("x")).alias("tags"),
    )
    return df


def write(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def check_against_profile(found, whole):
    n, columns = whole.count(), {c["column"]: c for c in profile(whole, quartiles=False).columns}
    found = {r["column"]: r for r in found.collect()}
    assert found.keys() == columns.keys()
    for name, c in columns.items():
        r = found[name]
        assert (r.row_count, r.non_null_count, r.null_rate) == (n, c["non_null_count"], c["null_rate"])
        assert abs(r.distinct_estimate - c["distinct_count"]) <= 4 * incremental.standard_error() * c["distinct_count"] + 0.5
        assert (r.blank_count, r.min_length, r.max_length) == (c.get("blank_count"), c.get("min_length"), c.get("max_length"))
        for own, low in ((r.low_number, c["min"]), (r.high_number, c["max"])):
            assert own is None or own == float(low)
        if name in ("name", "day", "flag"):
            assert (r.low_text, r.high_text) == (c["min"], c["max"])
        for own, other in ((r["mean"], c["mean"]), (r["stddev"], c["stddev"])):
            assert (own is None) == (other is None) and (own is None or math.isclose(own, other, rel_tol=1e-9))


def test_updates_read_only_new_files(spark, tmp_path):
    folder, store = str(tmp_path / "data"), str(tmp_path / "parts")
    write(rows(spark, 0, 3000), folder)
    write(rows(spark, 3000, 1), folder)
    assert incremental.update_parts(spark, folder, store) == 2
    check_against_profile(incremental.stored_profile(spark, folder, store), spark.read.parquet(folder))
    before = set(spark.read.parquet(folder).inputFiles())
    write(rows(spark, 2000, 2500), folder)  # some rows come twice
    new = [r.path for r in incremental.unread_files(spark, folder, store).collect()]
    read = set(incremental.read_files(spark, folder, new).inputFiles())
    assert len(read) == 1 and not read & before
    assert incremental.update_parts(spark, folder, store) == 1
    assert incremental.update_parts(spark, folder, store) == 0
    check_against_profile(incremental.stored_profile(spark, folder, store), spark.read.parquet(folder))


def test_files_that_are_empty_go_or_gain_columns(spark, tmp_path):
    folder, store = str(tmp_path / "data"), str(tmp_path / "parts")
    write(rows(spark, 0, 100), f"{folder}/load=1")
    write(rows(spark, 0, 0), f"{folder}/load=2")
    write(rows(spark, 50, 20).withColumn("more", F.col("id")).drop("tags"), f"{folder}/load=3")
    assert incremental.update_parts(spark, folder, store) == 3
    assert incremental.update_parts(spark, folder, store) == 0  # the file without rows is known
    found = {r["column"]: r for r in incremental.stored_profile(spark, folder, store).collect()}
    assert {r.row_count for r in found.values()} == {120}
    assert (found["more"].non_null_count, found["tags"].non_null_count, found["load"].high_number) == (20, 100, 3.0)
    whole = spark.read.option("mergeSchema", "true").parquet(folder)
    check_against_profile(incremental.stored_profile(spark, folder, store), whole)
    rows(spark, 500, 10).coalesce(1).write.mode("overwrite").parquet(f"{folder}/load=1")  # one file goes, one comes
    assert incremental.update_parts(spark, folder, store) == 1
    found = {r["column"]: r for r in incremental.stored_profile(spark, folder, store).collect()}
    assert found["id"].row_count == 30 and found["id"].high_number == 509


def test_a_file_recorded_twice_counts_once(spark, tmp_path):
    folder, store = str(tmp_path / "data"), str(tmp_path / "parts")
    write(rows(spark, 0, 50), folder)
    paths = [r.path for r in incremental.files_of(spark, folder).collect()]
    for batch in ("a", "b"):  # two updates at once
        stores.append(incremental.part_statistics(incremental.read_files(spark, folder, paths), incremental.FILE), store, batch)
    check_against_profile(incremental.stored_profile(spark, folder, store), spark.read.parquet(folder))


def test_days_unite_to_months(spark):
    df = rows(spark, 0, 20_000).withColumn("kind", F.when(F.col("id") % 4 > 0, F.col("id") % 4).cast("string"))
    days = incremental.part_statistics(df.drop("tags"), ["kind", "day"])
    weeks = incremental.combine(days.withColumn("week", F.weekofyear("day")), ["kind", "week"])
    for parts in (days, weeks):  # in one step or two
        found = {(r["kind"], r["column"]): r for r in incremental.summarise(incremental.combine(parts, ["kind"]), ["kind"]).collect()}
        for kind, size, values, mean, spread in df.groupBy("kind").agg(F.count("*"), F.countDistinct("price"), F.avg("price"), F.stddev_samp("price")).collect():
            r = found[kind, "price"]
            assert r.row_count == size and math.isclose(r["mean"], mean, rel_tol=1e-12) and math.isclose(r.stddev, spread, rel_tol=1e-9)
            assert abs(r.distinct_estimate - values) <= 4 * incremental.standard_error() * values


def test_odd_values_and_names(spark):
    df = spark.createDataFrame([("", 0.0, "a"), (None, -0.0, "a"), ("", None, "b")], "column string, rows double, part string")
    found = {r["column"]: r for r in incremental.summarise(incremental.combine(incremental.part_statistics(df, ["part"]))).collect()}
    assert (found["column"].non_null_count, found["column"].distinct_estimate, found["column"].blank_count, found["column"].low_text) == (2, 1, 2, None)
    assert (found["rows"].distinct_estimate, found["rows"].stddev) == (1, 0.0)
    assert incremental.part_statistics(df.limit(0), ["part"]).count() == 0
    with pytest.raises(ValueError):
        incremental.part_statistics(df, ["rows"])
