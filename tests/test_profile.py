from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.operators import privacy
from plumbline.operators.profile import fences, metadata_only, privacy_review, profile
from plumbline.operators.report import report_tables, write_report
from plumbline.operators.suggest import suggestions


def by_name(found):
    return {c["column"]: c for c in found.columns}


def test_basic_statistics(spark):
    df = spark.createDataFrame([(1, "Alice"), (2, "Bob"), (2, "Charlie")], "id int, name string")
    columns = by_name(profile(df))
    assert (columns["id"]["distinct_count"], columns["name"]["distinct_count"]) == (2, 3)
    assert (columns["name"]["min"], columns["name"]["max"]) == ("Alice", "Charlie")
    assert columns["id"]["null_rate"] == 0.0 and columns["id"]["inferred_type"] == "number"
    assert [f["value"] for f in columns["name"]["frequency"]] == ["Alice", "Bob", "Charlie"]


def test_blank_values(spark):
    found = profile(spark.createDataFrame([("   ",), ("ACTIVE",)], "code string"))
    (column,) = found.columns
    assert (column["null_rate"], column["blank_count"], column["blank_rate"], column["min"]) == (0.0, 1, 0.5, "ACTIVE")
    assert [f[3] for f in found.findings] == ["blank"]
    assert [f["value"] for f in column["frequency"]] == ["ACTIVE", "(blank)"]


def test_distinct_counts_are_exact(spark):
    df = spark.range(10_000).select("id", F.concat(F.lit("label-"), "id").alias("label"), F.lit(0.0).alias("z"))
    df = df.withColumn("z", F.when(F.col("id") % 2 == 0, F.lit(-0.0)).otherwise(F.col("z")))
    columns = by_name(profile(df.repartition(7)))
    assert [columns[n]["distinct_count"] for n in ("id", "label", "z")] == [10_000, 10_000, 1]


def test_odd_values_are_found(spark):
    names = ["Alice", "Bob", "Carol", "Dave", "Eve", "Frank", "Grace", "Heidi", "Ivan", "12345"]
    mails = [f"{n.lower()}@example.com" for n in names[:8]] + ["ivan@examplecom", "judy@example.com"]
    amounts = [1, 2, 3, 4, 5, 6, 7, 8, 9, 1000]
    df = spark.createDataFrame(list(zip(names, mails, amounts)), "name string, email string, amount int")
    found = profile(df)
    shown = {(f[2], f[3]): f[6] for f in found.findings}
    assert shown == {
        ("name", "number_in_text"): ["12345"],
        ("email", "malformed_email"): ["ivan@examplecom"],
        ("amount", "outlier"): ["1000"],
    }
    assert ("email", privacy.EMAIL_CATEGORY) in {(p[2], p[3]) for p in found.privacy}


def test_exactly_one_in_five_numbers_is_not_odd(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("5",)], "t string")
    assert profile(df).findings == []


def test_all_null_text_has_no_text_statistics(spark):
    (column,) = profile(spark.createDataFrame([(None,), (None,)], "t string")).columns
    assert column.get("blank_rate") is None and column["inferred_type"] == "text" and column["null_rate"] == 1.0


def test_nested_and_empty_sources(spark):
    df = spark.createDataFrame([([1, 2], {"a": 1}), ([1, 2], None)], "items array<int>, m map<string,int>")
    columns = by_name(profile(df))
    assert (columns["items"]["distinct_count"], columns["m"]["null_rate"]) == (1, 0.5)
    empty = profile(spark.createDataFrame([], "a int, b string"))
    assert empty.row_count == 0 and [c["null_rate"] for c in empty.columns] == [0.0, 0.0]


def test_database_text_variant(spark):
    rows = [("0", "20260101", "n/a"), ("1", "20260201", " "), ("2", "01/03/2026", "x")]
    columns = by_name(profile(spark.createDataFrame(rows, "label string, loaded string, note string"), database_text=True))
    assert columns["label"]["inferred_type"] == "numeric text"
    assert (columns["label"]["min"], columns["label"]["max"], columns["label"]["mean"]) == ("0.0", "2.0", 1.0)
    assert (columns["loaded"]["inferred_type"], columns["loaded"]["min"], columns["loaded"]["max"]) == (
        "date/time", "2026-01-01", "2026-03-01",
    )
    assert (columns["note"]["blank_count"], columns["note"]["min"]) == (1, "n/a")


def test_profile_does_not_depend_on_partitioning(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).cast("string").alias("t"), (F.col("id") / 3).alias("d"))
    one, many = (profile(df.repartition(n)) for n in (1, 9))
    for a, b in zip(one.columns, many.columns):
        assert {k: v for k, v in a.items() if k not in ("mean", "stddev")} == {k: v for k, v in b.items() if k not in ("mean", "stddev")}
        assert a["mean"] == pytest.approx(b["mean"]) if a["mean"] is not None else b["mean"] is None


def test_wide_tables_are_scanned_in_parts(spark):
    df = spark.range(10).select(*(F.col("id").alias(f"n{i}") for i in range(60)), *(F.col("id").cast("string").alias(f"t{i}") for i in range(20)))
    found = profile(df)
    assert len(found.columns) == 80 and {c["distinct_count"] for c in found.columns} == {10}


def test_fences():
    assert fences(1.0, 3.0) == (-2.0, 6.0)
    assert fences(2.0, 2.0) == (0.0, 0.0)


def test_privacy_names(spark):
    rows = privacy.review([("rijksregisternummer", "text"), ("medische_diagnose", "text"), ("contact_email", "email")], [])
    assert [(r[1], r[2], r[3]) for r in rows] == [
        ("high", "medische_diagnose", "Special category (Article 9): health"),
        ("high", "rijksregisternummer", "Personal data: direct identifier"),
        ("medium", "contact_email", "Personal data: contact detail"),
        ("medium", "contact_email", privacy.EMAIL_CATEGORY),
    ]


def test_name_table_agrees_with_single_names(spark):
    names = ["trace_id", "Date of Birth", "IP-address", "amount", "E_MAIL", "vakbond", "naam"]
    found = privacy.name_findings_frame(spark.createDataFrame([(n,) for n in names], "column string")).collect()
    assert {(r.column, r.category.partition(": ")[2]) for r in found} == {
        ("Date of Birth", "birth date"), ("IP-address", "address or location"), ("E_MAIL", "contact detail"), ("naam", "name"),
        ("vakbond", "political, religious or union"), ("trace_id", "racial or ethnic origin"),
    }
    value = ("high", "E_MAIL", "Personal data: contact detail", 3, "seen")
    assert privacy.review([("E_MAIL", "text")], [value]) == [(0, *value)]  # the later finding wins


PROFILE = "position int, column string, inferred_type string, null_rate double, blank_rate double, distinct_count long, min string, max string, min_length int, max_length int, sample_values array<string>"


def test_suggestions(spark):
    rows = [
        (0, "customer_id", "number", 0.0, None, 10, "1", "3", None, None, None),
        (1, "email", "email", 0.0, None, 10, None, None, None, None, None),
        (2, "status", "category", 0.0, None, 2, None, None, 6, 8, ["ACTIVE", "INACTIVE"]),
        (3, "created_at", "date/time", 0.0, None, 10, None, None, None, None, None),
        (4, "ordernummer", "number", 0.0, None, 9, None, None, None, None, None),
        (5, "partial", "category", 0.5, 0.1, 3, None, None, 1, 1, ["a"]),
    ]
    found = {r.name: r.config for r in suggestions(spark.createDataFrame(rows, PROFILE), F.lit(10)).collect()}
    assert found["customer_id must be unique"] == '{"columns":["customer_id"]}'
    assert found["customer_id must stay within range"] == '{"column":"customer_id","min":1,"max":3}'
    assert found["status must use allowed values"] == '{"column":"status","values":["ACTIVE","INACTIVE"]}'
    assert found["status must have an expected length"] == '{"column":"status","min_length":6,"max_length":8}'
    assert found["ordernummer must not contain duplicates"] == '{"columns":["ordernummer"]}'
    assert "created_at must be a valid date" in found and "email must be a valid email" in found
    assert [n for n in found if n.startswith("partial")] == ["partial must have an expected length"]


def test_report_tables(spark, tmp_path):
    df = spark.createDataFrame([("inactive",)] * 2 + [("active",)] * 8, "status string")
    found = profile(df)
    tables = report_tables("customers", found, found.findings_frame())
    assert list(tables) == ["summary", "findings", "columns", "frequencies", "privacy"]
    assert [tuple(r) for r in tables["frequencies"].collect()] == [("status", "active", 8, 0.8), ("status", "inactive", 2, 0.2)]
    assert tables["summary"].filter("metric = 'Rows'").first().value == "10"
    write_report(tables, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report" / "frequencies")).count() == 2


def test_metadata_export_holds_no_text_values(spark):
    df = spark.createDataFrame([("secret-1", 1), ("secret-2", 2), ("7", 900)], "t string, n int")
    found = profile(df)
    parts = {r.part: r.json for r in metadata_only(found.columns_frame(), found.findings_frame(), found.privacy_frame(), "s", 3).collect()}
    assert "secret" not in "".join(parts.values()) and '"max":"900"' in parts["columns"]


def test_profile_of_awkward_names_and_types(spark):
    df = spark.createDataFrame([(1, b"x", True), (2, b"x" * 99, None)], "`a.b` int, `raw` binary, `f lag` boolean")
    columns = by_name(profile(df))
    assert [columns[n]["distinct_count"] for n in ("a.b", "raw", "f lag")] == [2, 2, 1]
    assert columns["f lag"]["inferred_type"] == "boolean"


def test_many_odd_values_cost_no_group(spark):
    """Example values come from a per-task limit before the shuffle, not from gathering the group."""
    from plumbline.operators.profile import details

    df = spark.range(1000).select(F.col("id").cast("string").alias("t"))
    (examples,), _ = details(df, [], [(0, "number_in_text", F.col("t").isNotNull(), F.col("t"))], [])
    assert "WindowGroupLimit" in examples._jdf.queryExecution().executedPlan().toString()
    assert [r.value for r in examples.orderBy("value").collect()] == ["0", "1", "10", "100", "101"]


@pytest.mark.parametrize("limit", [4_000_000, 100, 3])
def test_exact_quartiles_at_any_spread(spark, monkeypatch, limit):
    from plumbline.operators import profile as p

    inf, nan = float("inf"), float("nan")
    rows = [(float(i * i % 7919), 5.0 if i % 3 else float(i), inf if i % 4 == 0 else 1.0, (-inf, inf)[i % 2], nan if i < 2000 else float(i), None if i % 2 else float(i % 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double")
    monkeypatch.setattr(p, "QUARTILE_VALUES", limit)  # so that bounds have to be narrowed
    wide = {"a": (0.0, 7919.0, 0.0, 7919.0), "b": (4.0, 5.5, 7.0, 9.0), "c": (1.0, inf, 1.0, inf), "d": (-inf, inf, -inf, inf), "e": (2000.0, 2001.0, nan, nan), "f": (0.0, 4.0, 0.0, 4.0)}
    found = p.exact_quartiles(df, wide)
    for k, name in enumerate("abcdef"):
        values = sorted((r[k] for r in rows if r[k] is not None), key=lambda v: (v != v, v))
        expected = tuple(values[-(-len(values) * q // 4) - 1] for q in (1, 3))
        assert str(found[name]) == str(expected)


def test_quartiles_take_two_passes_for_all_columns(spark, monkeypatch):
    from plumbline.operators import profile as p

    df = spark.range(100_000).selectExpr(*(f"cast(pmod(hash(id, {k}), 1000000007) as double) AS c{k}" for k in range(8)), "if(id % 4 = 0, cast(id as double), 5.0) AS ties", "if(id % 4 = 0, double('infinity'), 1.0) AS ends")
    queries = []
    monkeypatch.setattr(p, "collect_together", lambda frames, kept=p.collect_together: queries.append(len(frames)) or kept(frames))
    around = {name: r for name, r in zip(df.columns, df.agg(*(p._quartiles(F.col(c))["around"] for c in df.columns)).first(), strict=True)}
    found = p.exact_quartiles(df, around)
    assert queries == [2, 1]  # one counting pass over 10 columns in two parts, one pass for what lies between
    rows = df.collect()
    for name in df.columns:
        values = sorted(r[name] for r in rows)
        assert found[name] == (values[24_999], values[74_999])


def test_privacy_review_of_a_table_equals_the_profile(spark):
    df = spark.createDataFrame([(f"a{i}@b.example", "10.0.0.1" if i % 3 else "x", i, None, "BE12345678901234") for i in range(9)], "contact string, host string, n int, empty string, iban string")
    assert privacy_review(df).collect() == profile(df).privacy_frame().collect() != []
    assert privacy_review(df.select("n")).count() == 0


def test_of_findings_the_last_is_kept(spark):
    frame = spark.createDataFrame([(1, "a", "x"), (3, "a", "x"), (2, "a", "y")], "step int, column string, category string")
    assert sorted(tuple(r) for r in privacy.keep_last(frame, ["column", "category"], "step").collect()) == [(2, "a", "y"), (3, "a", "x")]


def test_frequency_keeps_blanks_beside_a_hundred_values(spark):
    df = spark.createDataFrame([(f"v{i}",) for i in range(100)] + [(" ",)] * 9 + [(None,)], "t string")
    frequency = {e["value"]: e["count"] for e in profile(df).columns[0].get("frequency", [])}
    assert not frequency or frequency["(blank)"] == 10


def test_suggestions_are_not_cut(spark):
    rows = [(i, f"c{i}", "number", 0.0, None, 10, "1", "9", None, None, None) for i in range(40)]
    frame = spark.createDataFrame(rows, PROFILE)
    assert suggestions(frame, F.lit(10)).count() > 50
    assert suggestions(frame, F.lit(10), limit=50).count() == 50
