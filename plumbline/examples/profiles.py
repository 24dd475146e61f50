"""Registered queries for profiling, privacy review, suggestions and the report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.examples.registry import folder, registered, rule, table
from plumbline.operators import incremental, privacy
from plumbline.operators.profile import completeness, distinct_counts, metadata_only, privacy_review, profile, snapshots_by, source_key
from plumbline.operators.report import report_tables
from plumbline.operators.suggest import suggestions
from plumbline.plans.durable import scratch
from plumbline.plans.runner import Planner


def sql_source(spark: SparkSession, path: str, sql: str) -> DataFrame:
    """A source given as SQL over the folder's tables."""
    return Planner(spark, folder(path)).frame(rule(0, "row_count", sql))[1]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _per_column(columns: list[str], select: str, source: str) -> str:
    """The same SELECT for each of several columns; ``{c}`` is the column and ``{s}`` the source."""
    return " UNION ALL ".join(select.format(c=c, s=source) for c in columns)


NUMERIC = {
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax".split(),
    "customer": "c_custkey c_nationkey c_acctbal".split(),
    "events": "event_id user_id value".split(),
}


@registered(
    " UNION ALL ".join(
        _per_column(
            names,
            "SELECT '{c}' AS \"column\", 'number' AS inferred_type, count({c}) AS non_null_count, "
            "round(1 - count({c}) / count(*), 6)::DOUBLE AS null_rate, min({c})::DOUBLE AS lowest, max({c})::DOUBLE AS highest, "
            "round(avg({c}), 6)::DOUBLE AS mean, round(stddev_samp({c}), 6)::DOUBLE AS stddev FROM {s}",
            name,
        )
        for name, names in NUMERIC.items()
    )
)
def profile_numeric(spark: SparkSession, path: str) -> DataFrame:
    frames = [profile(table(spark, path, name).select(*names)).columns_frame() for name, names in NUMERIC.items()]
    return _union(frames).select(
        "column", "inferred_type", "non_null_count", "null_rate", F.col("min").cast("double").alias("lowest"),
        F.col("max").cast("double").alias("highest"), F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"),
    )


# Gaps and blanks are planted by the source: some values become NULL, some become spaces.
TEXT_SOURCE = (
    "SELECT nullif(p_brand, 'Brand#7') AS brand, CASE WHEN p_type = 'PROMO' THEN '   ' ELSE concat(' ', p_type, ' ') END AS type, "
    "p_name AS name FROM part"
)
DOCUMENT_SOURCE = "SELECT text, lang, source FROM documents"


@registered(
    " UNION ALL ".join(
        _per_column(
            names,
            "SELECT '{c}' AS \"column\", count({c}) AS non_null_count, round(1 - count({c}) / count(*), 6)::DOUBLE AS null_rate, "
            "count(*) FILTER (trim({c}) = '') AS blank_count, round(count(*) FILTER (trim({c}) = '') / count(*), 6)::DOUBLE AS blank_rate, "
            "min(nullif(trim({c}), '')) AS min, max(nullif(trim({c}), '')) AS max, min(length({c}))::INT AS min_length, "
            "max(length({c}))::INT AS max_length, count(DISTINCT {c}) AS distinct_count FROM ({s})",
            sql,
        )
        for sql, names in ((TEXT_SOURCE, ["brand", "type", "name"]), (DOCUMENT_SOURCE, ["text", "lang", "source"]))
    )
)
def profile_text(spark: SparkSession, path: str) -> DataFrame:
    frames = [profile(sql_source(spark, path, sql)).columns_frame() for sql in (TEXT_SOURCE, DOCUMENT_SOURCE)]
    return _union(frames).select(
        "column", "non_null_count", "null_rate", "blank_count", "blank_rate", "min", "max", "min_length", "max_length",
        "distinct_count",
    )


DATE_SOURCE = "SELECT o_orderdate AS stamp, CAST(o_orderdate AS DATE) AS day, date_format(o_orderdate, 'yyyy/MM/dd') AS slashed FROM orders"


@registered(
    "SELECT 'stamp' AS \"column\", 'date/time' AS inferred_type, min(o_orderdate)::VARCHAR AS min, max(o_orderdate)::VARCHAR AS max, "
    "count(DISTINCT o_orderdate) AS distinct_count FROM orders UNION ALL "
    "SELECT 'day', 'date/time', min(o_orderdate::DATE)::VARCHAR, max(o_orderdate::DATE)::VARCHAR, count(DISTINCT o_orderdate::DATE) "
    "FROM orders UNION ALL "
    "SELECT 'slashed', 'date/time', min(o_orderdate::DATE)::VARCHAR, max(o_orderdate::DATE)::VARCHAR, count(DISTINCT o_orderdate::DATE) "
    "FROM orders"
)
def profile_dates(spark: SparkSession, path: str) -> DataFrame:
    found = profile(sql_source(spark, path, DATE_SOURCE)).columns_frame()
    return found.select("column", "inferred_type", "min", "max", "distinct_count")


DISTINCT = {
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "documents": "doc_id text lang source n_chars",
    "pages": "page_id url html",
    "conversations": "conv_id turn role text",
    "embeddings": "vec_id embedding label",
}


@registered(
    " UNION ALL ".join(
        _per_column(names.split(), f"SELECT '{name}' AS source, '{{c}}' AS \"column\", count(DISTINCT {{c}}) AS distinct_count FROM {{s}}", name)
        for name, names in DISTINCT.items()
    )
)
def profile_distinct(spark: SparkSession, path: str) -> DataFrame:
    frames = []
    for name in DISTINCT:
        found = profile(table(spark, path, name), quartiles=False).columns_frame()
        frames.append(found.select(F.lit(name).alias("source"), "column", "distinct_count"))
    return _union(frames)


FREQUENCY = (
    "SELECT '{c}' AS \"column\", coalesce(nullif(trim({c}), ''), '(blank)') AS value, count(*) AS count, "
    "round(count(*) / (SELECT count(*) FROM ({s})), 6)::DOUBLE AS share FROM ({s}) GROUP BY 2"
)


@registered(_per_column(["brand", "type", "name"], FREQUENCY, TEXT_SOURCE))
def profile_frequency(spark: SparkSession, path: str) -> DataFrame:
    return profile(sql_source(spark, path, TEXT_SOURCE)).frequencies_frame()


@registered(
    "WITH q AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", quantile_disc({c}, 0.25)::DOUBLE AS q25, quantile_disc({c}, 0.75)::DOUBLE AS q75 FROM {t}"
        for t, c in (("documents", "n_chars"), ("customer", "c_acctbal"), ("part", "p_retailprice"), ("labels", "toxic"))
    ) + "), v AS (SELECT 'n_chars' AS \"column\", n_chars::DOUBLE AS v FROM documents UNION ALL SELECT 'c_acctbal', c_acctbal FROM customer "
    "UNION ALL SELECT 'p_retailprice', p_retailprice FROM part UNION ALL SELECT 'toxic', toxic FROM labels) "
    "SELECT \"column\", q25, q75, count(*) FILTER (q75 > q25 AND (v < q25 - 1.5 * (q75 - q25) OR v > q75 + 1.5 * (q75 - q25))) AS outliers "
    "FROM q JOIN v USING (\"column\") GROUP BY ALL"
)
def profile_quartile_outliers(spark: SparkSession, path: str) -> DataFrame:
    frames = []
    for name, column in (("documents", "n_chars"), ("customer", "c_acctbal"), ("part", "p_retailprice"), ("labels", "toxic")):
        found = profile(table(spark, path, name).select(column))
        beyond = found.findings_frame().filter("kind = 'outlier'").select("column", F.col("observed").cast("long").alias("outliers"))
        frames.append(
            found.columns_frame()
            .join(beyond, "column", "left")
            .select("column", "q25", "q75", F.coalesce("outliers", F.lit(0)).alias("outliers"))
        )
    return _union(frames)


# One column for every meaning, and the odd values each check looks for.
MEANING_SOURCE = """
SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN concat('c', c_custkey, '@mail') ELSE concat('c', c_custkey, '@mail.example') END AS email,
       CASE WHEN c_acctbal < 0 THEN 'unknown' ELSE concat('m', c_custkey, '@mail.example') END AS contact,
       CASE WHEN c_acctbal < 0 THEN 'none' ELSE CAST(c_acctbal AS STRING) END AS balance,
       CASE WHEN c_acctbal < 0 THEN CAST(c_custkey AS STRING) ELSE c_name END AS label,
       CASE WHEN c_acctbal < 0 THEN '2024-13-01' ELSE concat('2024-01-', 10 + c_nationkey % 20) END AS since,
       c_mktsegment AS segment, c_name AS name, c_acctbal < 0 AS overdrawn, c_nationkey AS nation
FROM customer"""
MEANING_ORACLE = MEANING_SOURCE.replace("AS STRING", "AS VARCHAR")
_DUCK_EMAIL = r"^[^@\s]+@[^@\s]+$"
_DUCK_STRICT = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
_SHARES = (
    "SELECT '{c}' AS \"column\", count({c}) AS n, count(DISTINCT {c}) AS d, count(try_cast({c} AS DOUBLE)) AS numeric, "
    f"count(*) FILTER (regexp_matches({{c}}, '{_DUCK_EMAIL}')) AS loose, "
    f"count(*) FILTER (regexp_matches({{c}}, '{_DUCK_STRICT}')) AS strict, count(try_cast({{c}} AS DATE)) AS dates FROM ({{s}})"
)
_TEXT_COLUMNS = ["email", "contact", "balance", "label", "since", "segment", "name"]


@registered(
    "SELECT \"column\", CASE WHEN dates / n >= 0.8 THEN 'date/time' WHEN loose / n >= 0.8 THEN 'email' "
    "WHEN numeric / n >= 0.8 THEN 'numeric text' WHEN d <= 10 THEN 'category' ELSE 'text' END AS inferred_type "
    f"FROM ({_per_column(_TEXT_COLUMNS, _SHARES, MEANING_ORACLE)}) UNION ALL "
    "SELECT 'overdrawn', 'boolean' UNION ALL SELECT 'nation', 'number'"
)
def profile_meaning(spark: SparkSession, path: str) -> DataFrame:
    return profile(sql_source(spark, path, MEANING_SOURCE)).columns_frame().select("column", "inferred_type")


@registered(
    f"WITH s AS ({_per_column(_TEXT_COLUMNS, _SHARES, MEANING_ORACLE)}) "
    "SELECT \"column\", 'malformed_email' AS kind, loose - strict AS observed FROM s WHERE loose / n >= 0.8 AND loose > strict UNION ALL "
    "SELECT \"column\", 'not_email', n - loose FROM s WHERE loose / n >= 0.8 AND n > loose UNION ALL "
    "SELECT \"column\", 'number_in_text', numeric FROM s WHERE loose / n < 0.8 AND numeric > 0 AND numeric / n <= 1 - 0.8::DOUBLE UNION ALL "
    "SELECT \"column\", 'text_in_numbers', n - numeric FROM s WHERE loose / n < 0.8 AND numeric / n >= 0.8 AND numeric < n"
)
def profile_findings(spark: SparkSession, path: str) -> DataFrame:
    found = profile(sql_source(spark, path, MEANING_SOURCE)).findings_frame()
    return found.filter("kind <> 'placeholder'").select("column", "kind", F.col("observed").cast("long").alias("observed"))


@registered(
    f"WITH s AS ({MEANING_ORACLE}), odd AS ("
    f"SELECT 'email' AS \"column\", 'malformed_email' AS kind, email AS v FROM s WHERE NOT regexp_matches(email, '{_DUCK_STRICT}') UNION "
    f"SELECT 'contact', 'not_email', contact FROM s WHERE NOT regexp_matches(contact, '{_DUCK_EMAIL}') UNION "
    "SELECT 'balance', 'text_in_numbers', balance FROM s WHERE try_cast(balance AS DOUBLE) IS NULL UNION "
    "SELECT 'label', 'number_in_text', label FROM s WHERE try_cast(label AS DOUBLE) IS NOT NULL) "
    "SELECT \"column\", kind, string_agg(v, ', ' ORDER BY v) AS examples FROM "
    "(SELECT * FROM odd QUALIFY row_number() OVER (PARTITION BY \"column\", kind ORDER BY v) <= 5) GROUP BY ALL"
)
def profile_examples(spark: SparkSession, path: str) -> DataFrame:
    found = profile(sql_source(spark, path, MEANING_SOURCE)).findings_frame()
    return found.filter("kind <> 'placeholder'").select("column", "kind", F.array_join("examples", ", ").alias("examples"))


@registered(
    "SELECT 'p_type' AS \"column\", string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS sample_values FROM part UNION ALL "
    "SELECT 'p_name', NULL UNION ALL "
    "SELECT 'role', string_agg(DISTINCT role, ',' ORDER BY role) FROM conversations UNION ALL "
    "SELECT 'o_orderstatus', string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) FROM orders"
)
def profile_sample_values(spark: SparkSession, path: str) -> DataFrame:
    frames = [
        profile(table(spark, path, name).select(*columns)).columns_frame()
        for name, columns in (("part", ["p_type", "p_name"]), ("conversations", ["role"]), ("orders", ["o_orderstatus"]))
    ]
    return _union(frames).select("column", F.array_join("sample_values", ",").alias("sample_values"))


PLACEHOLDER_SOURCE = (
    "SELECT CASE p_type WHEN 'PROMO' THEN ' n/a ' WHEN 'SMALL' THEN 'Unknown' WHEN 'LARGE' THEN 'x**x' WHEN 'MEDIUM' THEN '-' "
    "ELSE p_type END AS type, CASE p_brand WHEN 'Brand#7' THEN '***' ELSE p_brand END AS brand, p_name AS name FROM part"
)


@registered(
    "WITH f AS (" + _per_column(["type", "brand", "name"], FREQUENCY, PLACEHOLDER_SOURCE) + ") "
    "SELECT \"column\", value, count AS observed FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY count DESC, value) AS n FROM f) "
    "WHERE n <= 10 AND (upper(value) IN ('***', 'N/A', 'NA', 'NONE', 'NULL', 'UNKNOWN', 'UNSPECIFIED', '-') OR contains(value, '**'))"
)
def profile_placeholders(spark: SparkSession, path: str) -> DataFrame:
    found = profile(sql_source(spark, path, PLACEHOLDER_SOURCE)).findings_frame().filter("kind = 'placeholder'")
    return found.select("column", F.col("examples")[0].alias("value"), F.col("observed").cast("long").alias("observed"))


@registered(
    _per_column(
        ["brand", "type", "name"],
        "SELECT '{c}' AS \"column\", round_even((round(1 - count({c}) / count(*), 6) + round(count(*) FILTER (trim({c}) = '') / count(*), 6)) * 100, 1)"
        "::DOUBLE AS missing_or_blank_percent, round_even(count(DISTINCT {c}) / count({c}) * 100, 1)::DOUBLE AS distinct_percent FROM ({s})",
        TEXT_SOURCE,
    )
)
def profile_completeness(spark: SparkSession, path: str) -> DataFrame:
    return completeness(profile(sql_source(spark, path, TEXT_SOURCE)).columns_frame())


DATABASE_SOURCE = (
    "SELECT concat(' ', o_custkey, '.5 ') AS amount, date_format(o_orderdate, 'dd/MM/yyyy') AS slashed, "
    "date_format(o_orderdate, 'yyyyMMdd') AS compact, o_orderpriority AS priority, "
    "CASE o_orderstatus WHEN 'F' THEN ' ' ELSE date_format(o_orderdate, 'dd-MM-yyyy') END AS partly FROM orders"
)


@registered(
    "SELECT 'amount' AS \"column\", 'numeric text' AS inferred_type, (min(o_custkey) + 0.5)::DOUBLE::VARCHAR AS min, "
    "(max(o_custkey) + 0.5)::DOUBLE::VARCHAR AS max, round(avg(o_custkey + 0.5), 6)::DOUBLE AS mean, 0::BIGINT AS blank_count FROM orders UNION ALL "
    "SELECT 'slashed', 'date/time', min(o_orderdate)::DATE::VARCHAR, max(o_orderdate)::DATE::VARCHAR, NULL, 0 FROM orders UNION ALL "
    "SELECT 'compact', CASE WHEN TRUE THEN 'date/time' END, min(o_orderdate)::DATE::VARCHAR, max(o_orderdate)::DATE::VARCHAR, NULL, 0 FROM orders UNION ALL "
    "SELECT 'priority', 'text', min(o_orderpriority), max(o_orderpriority), NULL, 0 FROM orders UNION ALL "
    "SELECT 'partly', 'text', min(strftime(o_orderdate, '%d-%m-%Y')), max(strftime(o_orderdate, '%d-%m-%Y')), NULL, "
    "(SELECT count(*) FROM orders WHERE o_orderstatus = 'F') FROM orders WHERE o_orderstatus <> 'F'"
)
def profile_database_text(spark: SparkSession, path: str) -> DataFrame:
    found = profile(sql_source(spark, path, DATABASE_SOURCE), database_text=True).columns_frame()
    return found.select("column", "inferred_type", "min", "max", F.round("mean", 6).alias("mean"), "blank_count")


@registered(
    "SELECT '3:table:' || url AS source_key, 'page' AS origin FROM pages UNION ALL "
    "SELECT '3:sql:' || substr(sha1(trim(html, chr(9) || chr(10) || chr(13) || ' ')), 1, 12), 'query' FROM pages"
)
def source_keys(spark: SparkSession, path: str) -> DataFrame:
    pages = table(spark, path, "pages")
    named = pages.select(source_key(F.lit(3), F.lit("table"), F.concat(F.lit(" "), "url"), F.lit(None).cast("string")).alias("source_key"), F.lit("page").alias("origin"))
    unnamed = pages.select(source_key(F.lit(3), F.lit("sql"), F.lit("  "), F.col("html")).alias("source_key"), F.lit("query").alias("origin"))
    return named.unionByName(unnamed)


@registered(
    "WITH c AS (SELECT count(*) AS n, count(DISTINCT doc_id) AS di, min(doc_id) AS a, max(doc_id) AS b, avg(doc_id) AS m, count(DISTINCT text) AS dt, count(DISTINCT lang) AS dl, "
    "count(DISTINCT source) AS ds, count(DISTINCT n_chars) AS dn, min(n_chars) AS e, max(n_chars) AS f, avg(n_chars) AS g FROM documents) "
    "SELECT t.* FROM c, LATERAL (VALUES ('row_count', n::VARCHAR), ('source', '\"documents\"'), "
    "('doc_id', 'number|bigint|' || di || '|' || a || '|' || b || '|' || round(m, 3)), ('text', 'text|string|' || dt), "
    "('lang', CASE WHEN dl <= 10 THEN 'category' ELSE 'text' END || '|string|' || dl), ('source name', CASE WHEN ds <= 10 THEN 'category' ELSE 'text' END || '|string|' || ds), "
    "('n_chars', 'number|bigint|' || dn || '|' || e || '|' || f || '|' || round(g, 3))) AS t(part, content)"
)
def profile_metadata_only(spark: SparkSession, path: str) -> DataFrame:
    """What is handed on about the documents: the listed figures of each column, and no text of any of them."""
    found = profile(table(spark, path, "documents"), quartiles=False)
    exported = metadata_only(found.columns_frame(), found.findings_frame(), found.privacy_frame(), "documents", found.row_count)
    listed = exported.filter("part = 'columns'").select(
        F.inline(F.from_json("json", "array<struct<column:string,type:string,inferred_type:string,distinct_count:bigint,min:string,max:string,mean:double>>"))
    )
    mean = F.round("mean", 3).cast("string")
    content = F.concat_ws("|", "inferred_type", "type", "distinct_count", "min", "max", mean)
    name = F.when(F.col("column") == "source", "source name").otherwise(F.col("column"))
    return exported.filter("part IN ('row_count', 'source')").select("part", F.col("json").alias("content")).unionByName(listed.select(name.alias("part"), content.alias("content")))


WORDS = r"SELECT DISTINCT word FROM (SELECT unnest(string_split_regex(text, '\s+')) AS word FROM documents) WHERE word <> ''"


@registered(
    f"WITH w AS (SELECT word AS \"column\", regexp_replace(lower(word), '[^a-z0-9]', '', 'g') AS n FROM ({WORDS})) SELECT \"column\", CASE "
    + " ".join(f"WHEN regexp_matches(n, '{'|'.join(parts)}') THEN '{category}'" for category, _, parts in privacy.NAME_SIGNALS)
    + " END AS category FROM w WHERE category IS NOT NULL"
)
def privacy_names(spark: SparkSession, path: str) -> DataFrame:
    """Every distinct word of the documents taken as a column name."""
    words = table(spark, path, "documents").select(F.explode(F.split("text", r"\s+")).alias("column")).filter("column <> ''").distinct()
    return privacy.name_findings_frame(words).select("column", "category")


# Words of the documents hold a few real identifiers; identifiers of orders and events are planted.
WORD_SOURCE = r"SELECT explode(split(text, '\\s+')) AS word FROM documents"
ORDER_IDENTIFIERS = (
    "SELECT concat(' be', lpad(CAST(o_orderkey AS STRING), 14, '0')) AS account, "
    "concat(date_format(o_orderdate, 'yy.MM.dd'), '-123.', lpad(CAST(o_custkey % 100 AS STRING), 2, '0')) AS register, "
    "CASE WHEN o_orderstatus = 'F' THEN concat('10.', o_custkey % 256, '.0.1') ELSE 'none' END AS host FROM orders"
)


@registered(
    r"WITH t AS (SELECT unnest(string_split_regex(text, '\s+')) AS word FROM documents) "
    r"SELECT 'word' AS column_name, 'Personal data: email address' AS category, 'medium' AS severity, "
    r"count(*) FILTER (regexp_matches(word, '^[^@\s]+@[^@\s]+\.[^@\s]+$')) AS observed FROM t HAVING observed > 0 UNION ALL "
    r"SELECT 'word', 'Personal data: IP address', 'medium', count(*) FILTER (regexp_matches(word, '^[0-9]{1,3}(\.[0-9]{1,3}){3}$')) AS o FROM t HAVING o > 0 UNION ALL "
    r"SELECT 'word', 'Personal data: IBAN-like financial identifier', 'medium', count(*) FILTER (regexp_matches(upper(word), '^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$')) AS o FROM t HAVING o > 0 UNION ALL "
    r"SELECT 'account', 'Personal data: IBAN-like financial identifier', 'medium', count(*) FROM orders UNION ALL "
    r"SELECT 'register', 'Personal data: Belgian national-register-number-like identifier', 'high', count(*) FROM orders UNION ALL "
    r"SELECT 'host', 'Personal data: IP address', 'medium', count(*) FROM orders WHERE o_orderstatus = 'F'"
)
def privacy_values(spark: SparkSession, path: str) -> DataFrame:
    frames = [privacy_review(sql_source(spark, path, sql)) for sql in (WORD_SOURCE, ORDER_IDENTIFIERS)]
    found = _union(frames).filter("observed IS NOT NULL")
    return found.select(F.col("column").alias("column_name"), "category", "severity", "observed")


SUGGEST_SOURCE = """
SELECT c_custkey AS customer_id, c_nationkey AS nation_key, concat('c', c_custkey, '@mail.example') AS email, c_mktsegment AS segment,
       nullif(c_name, 'Customer#000000001') AS label, CAST('2024-01-05' AS DATE) AS since
FROM customer"""


@registered(
    "WITH s AS (SELECT count(*) AS n, min(c_custkey) AS a, max(c_custkey) AS b, min(c_nationkey) AS c, max(c_nationkey) AS d, "
    "min(length(c_custkey::VARCHAR)) + 14 AS e, max(length(c_custkey::VARCHAR)) + 14 AS f, "
    "'[' || string_agg(DISTINCT '\"' || c_mktsegment || '\"', ',' ORDER BY '\"' || c_mktsegment || '\"') || ']' AS g, "
    "min(length(c_mktsegment)) AS h, max(length(c_mktsegment)) AS i, "
    "min(length(nullif(c_name, 'Customer#000000001'))) AS j, max(length(nullif(c_name, 'Customer#000000001'))) AS k FROM customer) "
    "SELECT t.* FROM s, LATERAL (VALUES "
    "('not_null', 'customer_id', 'customer_id must not be null', '{\"column\":\"customer_id\"}'), "
    "('unique', 'customer_id', 'customer_id must be unique', '{\"columns\":[\"customer_id\"]}'), "
    "('value_range', 'customer_id', 'customer_id must stay within range', '{\"column\":\"customer_id\",\"min\":' || a || ',\"max\":' || b || '}'), "
    "('not_null', 'nation_key', 'nation_key must not be null', '{\"column\":\"nation_key\"}'), "
    "('value_range', 'nation_key', 'nation_key must stay within range', '{\"column\":\"nation_key\",\"min\":' || c || ',\"max\":' || d || '}'), "
    "('not_null', 'email', 'email must not be null', '{\"column\":\"email\"}'), "
    "('unique', 'email', 'email must be unique', '{\"columns\":[\"email\"]}'), "
    r"""('regex', 'email', 'email must be a valid email', '{"column":"email","pattern":"^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$"}'), """
    "('length', 'email', 'email must have an expected length', '{\"column\":\"email\",\"min_length\":' || e || ',\"max_length\":' || f || '}'), "
    "('not_null', 'segment', 'segment must not be null', '{\"column\":\"segment\"}'), "
    "('allowed_values', 'segment', 'segment must use allowed values', '{\"column\":\"segment\",\"values\":' || g || '}'), "
    "('length', 'segment', 'segment must have an expected length', '{\"column\":\"segment\",\"min_length\":' || h || ',\"max_length\":' || i || '}'), "
    "('length', 'label', 'label must have an expected length', '{\"column\":\"label\",\"min_length\":' || j || ',\"max_length\":' || k || '}'), "
    "('not_null', 'since', 'since must not be null', '{\"column\":\"since\"}'), "
    "('date_validity', 'since', 'since must be a valid date', '{\"column\":\"since\"}')) AS t(rule_type, \"column\", name, config)"
)
def suggest_rules(spark: SparkSession, path: str) -> DataFrame:
    found = profile(sql_source(spark, path, SUGGEST_SOURCE), quartiles=False)
    return suggestions(found.columns_frame(), F.lit(found.row_count))


@registered(
    "SELECT 'Rows' AS metric, count(*)::VARCHAR AS value FROM orders UNION ALL SELECT 'Source', 'orders' UNION ALL "
    "SELECT 'Columns profiled', '6' UNION ALL SELECT 'Drift findings', '0' UNION ALL SELECT 'High-severity findings', '0' UNION ALL "
    "SELECT 'GDPR review flags', '0'"
)
def report_summary(spark: SparkSession, path: str) -> DataFrame:
    found = profile(table(spark, path, "orders"))
    tables = report_tables("orders", found, found.findings_frame())
    return tables["summary"].filter("metric <> 'Profiled at (UTC)'").select("metric", "value")


@registered(
    "SELECT 'o_orderstatus' AS field, o_orderstatus AS value, count(*) AS count, round(count(*) / (SELECT count(*) FROM orders), 6)::DOUBLE AS share "
    "FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*), round(count(*) / (SELECT count(*) FROM orders), 6)::DOUBLE "
    "FROM orders GROUP BY 2"
)
def report_frequencies(spark: SparkSession, path: str) -> DataFrame:
    found = profile(table(spark, path, "orders"))
    return report_tables("orders", found, found.findings_frame())["frequencies"]


@registered(
    "SELECT event_type, ts::DATE AS day, \"column\", null_rate, distinct_count, round(mean, 8)::DOUBLE AS mean, round(stddev, 8)::DOUBLE AS stddev FROM ("
    "SELECT event_type, ts::DATE AS ts, 'value' AS \"column\", 0.0::DOUBLE AS null_rate, count(DISTINCT value) AS distinct_count, avg(value) AS mean, "
    "stddev_samp(value) AS stddev FROM events GROUP BY 1, 2 UNION ALL "
    "SELECT event_type, ts::DATE, 'user_id', round(count(*) FILTER (user_id = 8) / count(*), 6), count(DISTINCT nullif(user_id, 8)), avg(nullif(user_id, 8)), "
    "stddev_samp(nullif(user_id, 8)) FROM events GROUP BY 1, 2)"
)
def profile_by_source_and_day(spark: SparkSession, path: str) -> DataFrame:
    """A profile snapshot for every event type and day in one query."""
    events = sql_source(spark, path, "SELECT event_type, CAST(ts AS DATE) AS day, value, nullif(user_id, 8) AS user_id FROM events")
    _, columns = snapshots_by(events, ["event_type", "day"])
    return columns.withColumns({"mean": F.round("mean", 8), "stddev": F.round("stddev", 8)})


GROWING = {"number": "o_orderkey o_custkey o_totalprice".split(), "text": "o_orderstatus o_orderpriority".split(), "day": ["o_orderdate"]}
MERGED = {
    "number": "NULL::BIGINT AS blank_count, min({c})::DOUBLE AS low_number, max({c})::DOUBLE AS high_number, NULL::VARCHAR AS low_text, "
    "NULL::VARCHAR AS high_text, round(avg({c}), 6)::DOUBLE AS mean, round(stddev_samp({c}), 6)::DOUBLE AS stddev, NULL::INT AS min_length, NULL::INT AS max_length",
    "text": "count(*) FILTER (trim({c}) = ''), NULL, NULL, min(nullif(trim({c}), '')), max(nullif(trim({c}), '')), NULL, NULL, min(length({c}))::INT, max(length({c}))::INT",
    "day": "NULL, NULL, NULL, min({c})::VARCHAR, max({c})::VARCHAR, NULL, NULL, NULL, NULL",
}


@registered(
    " UNION ALL ".join(
        _per_column(names, "SELECT '{c}' AS \"column\", count(*) AS row_count, count({c}) AS non_null_count, " + MERGED[kind] + " FROM {s}", "orders")
        for kind, names in GROWING.items()
    )
)
def profile_incremental(spark: SparkSession, path: str) -> DataFrame:
    """A folder that receives orders in two loads: each update reads the new files only, the profile is merged from what is kept."""
    where = scratch(spark, "growing")
    orders = table(spark, path, "orders").select(*(name for names in GROWING.values() for name in names))
    for is_open in (True, False):
        orders.filter(F.col("o_orderstatus").eqNullSafe("O") == is_open).write.mode("append").parquet(f"{where}/orders")
        incremental.update_parts(spark, f"{where}/orders", f"{where}/parts")
    found = incremental.stored_profile(spark, f"{where}/orders", f"{where}/parts").drop("null_rate", "distinct_estimate")
    return found.withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)})


@registered(
    "SELECT event_type, 'user_id' AS \"column\", count(DISTINCT user_id) AS distinct_count, TRUE AS within_bound FROM events GROUP BY 1 UNION ALL "
    "SELECT event_type, 'value', count(DISTINCT value), TRUE FROM events GROUP BY 1"
)
def profile_sketched_distinct(spark: SparkSession, path: str) -> DataFrame:
    """Distinct values of a month from the united sketches of its days, held against the exact counts within four standard errors."""
    events = sql_source(spark, path, "SELECT event_type, CAST(ts AS DATE) AS day, user_id, value FROM events")
    days = incremental.part_statistics(events, ["event_type", "day"])
    month = incremental.summarise(incremental.combine(days, ["event_type"]), ["event_type"]).select("event_type", "column", "distinct_estimate")
    plain = events.drop("day")
    names = F.array(*(F.lit(name) for name in plain.columns))
    exact = distinct_counts(plain, ["event_type"]).select("event_type", F.get(names, F.col("position")).alias("column"), "distinct_count")
    error = F.abs(F.col("distinct_estimate") - F.col("distinct_count"))
    bound = 4 * incremental.standard_error() * F.col("distinct_count") + 0.5
    return exact.join(month, ["event_type", "column"]).select("event_type", "column", "distinct_count", (error <= bound).alias("within_bound"))
