from __future__ import annotations

import pytest

from plumbline.sources import catalog, csv, stores
from plumbline.spec import Connection

HOST = "jdbc:db2://host:50000/base"


def test_view_names_are_identifiers_and_unique():
    names = csv.view_names(["file:/a/2024 sales-data.csv", "/a/orders.csv", "/b/orders.csv", "/c/---.csv", "/d/x%20y.csv"])
    assert list(names) == ["t_2024_sales_data", "orders", "orders_2", "csv", "x_y"]


@pytest.mark.parametrize(
    "lines, expected",
    [(["a;b", '1;"x,y"'], ";"), (["a,b,c", "1,2,3"], ","), (["a\tb", "1\t2"], "\t"), (["a|b"], "|"), (["a"], ","), ([], ",")],
)
def test_delimiter(lines, expected):
    assert csv.sniff_delimiter(lines) == expected


@pytest.mark.parametrize(
    "content, encoding, multi_line",
    [
        ("a,b\n1,é\n".encode("latin-1"), "latin-1", False),
        ("a,b\n1,é\n".encode(), "utf-8", False),
        (b"\xef\xbb\xbfa,b\n1,2\n", "utf-8", False),
        ("a,b\n1,é\n".encode("utf-16"), "utf-16", True),
        (b'a,b\n1,"x\ny"\n', "utf-8", True),
    ],
)
def test_layout_and_reading(spark, tmp_path, content, encoding, multi_line):
    path = tmp_path / "f.csv"
    path.write_bytes(content)
    found = csv.layout(spark, str(path))
    assert (found.encoding, found.delimiter, found.multi_line) == (encoding, ",", multi_line)
    df = csv.read_csv(spark, str(path))
    assert df.columns == ["a", "b"] and df.count() == 1
    assert str(df.first().b) in {"é", "2", "x\ny"}


def test_folder_listing_is_relative_and_sorted(spark, tmp_path):
    for name in ("b.csv", "a/c.csv", "a/skip.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x\n1\n")
    folder = Connection(1, "files", "csv", {"base_path": str(tmp_path)})
    assert [r.name for r in catalog.list_targets(spark, folder).collect()] == ["a/c.csv", "b.csv"]
    single = Connection(1, "b", "csv", {"base_path": str(tmp_path)})
    assert [r.name for r in catalog.list_targets(spark, single).collect()] == ["b.csv"]


def test_schema_without_reading(spark):
    df = spark.createDataFrame([(1, "a")], "n int, t string")
    assert [(r.name, r.type) for r in csv.schema_frame(df).orderBy("position").collect()] == [("n", "int"), ("t", "string")]


def test_jdbc_options_pass_partitioning_and_wrap_queries():
    base = Connection(1, "db", "db2", {"url": HOST, "partitionColumn": "ID", "lowerBound": 0, "upperBound": 9, "numPartitions": 4})
    options = catalog.jdbc_options(base, sql="SELECT * FROM t;")
    assert options["dbtable"] == "(SELECT * FROM t) q"
    assert (options["lowerBound"], options["numPartitions"], options["fetchsize"]) == ("0", "4", "5000")
    assert catalog.jdbc_options(base, table="S.T")["dbtable"] == "S.T"
    with pytest.raises(ValueError):
        catalog.jdbc_options(base)


@pytest.mark.parametrize("kind, source_kind", [("csv", "table"), ("db2", "csv_file")])
def test_source_kind_must_suit_the_connection(spark, kind, source_kind):
    config = {"source_connection_id": 1, "source_kind": source_kind, "source_name": "x"}
    with pytest.raises(ValueError, match="read as csv_file|by table or by SQL"):
        catalog.load(spark, config, {1: Connection(1, "c", kind)})
    with pytest.raises(ValueError, match="No connection is known"):
        catalog.load(spark, config, {})


def test_catalog_tables_and_sql(spark):
    spark.range(3).createOrReplaceTempView("numbers_here")
    here = {1: Connection(1, "session", "spark")}
    by_name = {"source_connection_id": 1, "source_kind": "table", "source_name": "numbers_here"}
    by_sql = {"source_connection_id": 1, "source_kind": "sql", "source_sql": "SELECT * FROM numbers_here WHERE id > 0"}
    assert (catalog.load(spark, by_name, here).count(), catalog.load(spark, by_sql, here).count()) == (3, 2)
    spark.catalog.dropTempView("numbers_here")


def test_evidence_with_changing_columns_reads_as_one_table(spark, tmp_path):
    path = str(tmp_path / "e")
    for batch, row in (("b-1", '{"a":1}'), ("b-2", '{"a":2,"b":"x"}')):
        stores.append(spark.createDataFrame([(1, row)], "rule_id long, row_json string"), path, batch)
    stored = stores.read(spark, path).selectExpr("current_timestamp() AS execution_datetime", "rule_id", "row_json")
    rows = stores.widen_evidence(stored, "a int, b string").orderBy("a").collect()
    assert [(r.a, r.b) for r in rows] == [(1, None), (2, "x")]
    assert stores.search_evidence(stored, "X").count() == 1


def test_folder_of_part_files_is_one_table(spark, tmp_path):
    from plumbline.sources import catalog
    from plumbline.sources.stores import search_evidence
    from plumbline.spec import Connection

    spark.range(100).repartition(5).write.parquet(f"{tmp_path}/lake/orders.parquet")
    spark.range(7).coalesce(1).write.parquet(f"{tmp_path}/lake/customer")
    lake = Connection(1, "lake", "parquet", {"base_path": f"{tmp_path}/lake"})
    tables = catalog.connection_tables(spark, lake)
    assert {name: frame.count() for name, frame in tables.items()} == {"orders": 100, "customer": 7}
    spark.range(50).repartition(3).write.option("header", True).csv(f"{tmp_path}/files/orders")
    spark.range(4).coalesce(1).write.option("header", True).csv(f"{tmp_path}/files/parts")
    files = Connection(2, "files", "csv", {"base_path": f"{tmp_path}/files"})
    assert {n: f.count() for n, f in catalog.connection_tables(spark, files).items()} == {"orders": 50, "parts": 4}
    wide = spark.range(1000).selectExpr("cast(id as string) AS t")
    assert search_evidence(wide, "99").count() == 19
    assert search_evidence(wide, "99", shown=5).count() == 5


def test_files_of_a_folder_are_detected_one_by_one(spark, tmp_path):
    late = "x;y\n" + "".join(f"{i};v\n" for i in range(30))
    (tmp_path / "part-0.csv").write_bytes("k,name,note\n1,é,\"a;b\"\n2,ü,c\n".encode())
    (tmp_path / "part-1 b.csv").write_bytes("k;note;name\n3;d;ö\nx4;e;ä\n".encode())
    (tmp_path / "part-2.csv").write_bytes("k|name|note\n05|ß|f\n".encode("latin-1"))
    (tmp_path / "part-3.csv").write_bytes("k\tname\tnote\n6\t粀,|\tg\n".encode("utf-16"))
    rows = {(r.k, r.name, r.note) for r in csv.read_csv(spark, str(tmp_path)).collect()}
    assert rows == {("1", "é", "a;b"), ("2", "ü", "c"), ("3", "ö", "d"), ("x4", "ä", "e"), ("05", "ß", "f"), ("6", "粀,|", "g")}
    single = tmp_path / "one"
    single.mkdir()
    (single / "late.csv").write_text(late + "31;a,b\n")
    assert csv.read_csv(spark, str(single)).count() == 31 and csv.layout(spark, str(single)).delimiter == ";"


def _awkward_csv(rows: int) -> str:
    odd = ['plain', '"a, b"', '"line\nbreak"', '"say ""hi"""', '""', '5" disk', '"two\r\nbreaks\n\nhere"', 'x "y" z', '"q""\n"", r"', '"ends"tail', '']
    lines = ['k,"name\nof it",note']
    for i in range(rows):
        lines.append(f"{i},{odd[i % len(odd)]},{odd[(i * 7 + 3) % len(odd)]}")
    return "\n".join(lines) + "\n"


@pytest.mark.parametrize("split, encoding", [(60, "utf-8"), (150, "latin-1")])
def test_quoted_breaks_are_read_by_many_tasks_like_one(spark, tmp_path, split, encoding):
    path = tmp_path / "f.csv"
    path.write_bytes(_awkward_csv(40).replace("plain", "pläïn").encode(encoding))
    whole = csv.read_csv(spark, str(path), known=csv.CsvLayout(encoding, ",", True))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        found = csv.layouts(spark, str(path))
        assert [how.large for how in found] == [True] and next(iter(found)).encoding == encoding
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 3  # its lines are read by many tasks
        parts = csv.read_csv(spark, str(path))
        assert parts.schema == whole.schema
        rows = sorted(map(tuple, parts.collect()), key=repr)
        schema = "k string, name string, note string"
        given = csv.read_csv(spark, str(path), schema=schema).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == sorted(map(tuple, whole.collect()), key=repr)
    assert given == whole.count()


def test_line_functions_compose():
    import itertools

    import numpy as np

    from plumbline.sources import records

    kinds = [(False, False), (True, True), (False, True), (True, False)]
    for lines in itertools.product(kinds, repeat=4):
        outside, inside = (np.array([k[i] for k in lines]) for i in (0, 1))
        for begins in (False, True):
            state, states = begins, []
            for from_outside, from_inside in lines:
                states.append(state)
                state = from_inside if state else from_outside
            assert records.states_before(begins, outside, inside).tolist() == states
            assert records.composed(outside, inside)[begins] == state


def test_types_of_cut_records(spark):
    from plumbline.sources import records

    rows = [("1", "1", "1.5", "2024-01-05", "2024-01-05 10:00:00", "true", None, "x"), ("-7", "3000000000", "2", "2024-02-05", "2024-01-05T10:00:00Z", "False", None, "1")]
    texts = spark.createDataFrame(rows, "a string, `b.c` string, d string, e string, f string, g string, h string, i string")
    assert [f.dataType.simpleString() for f in records.typed(texts).schema] == ["int", "bigint", "double", "date", "timestamp", "boolean", "string", "string"]
