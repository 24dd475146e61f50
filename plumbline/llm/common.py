"""What several operators share: reading inputs, joins that withstand hot keys, prefix sums, connected components."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plumbline.plans.durable import cut_lineage

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A key is hot when it holds at least one row in so many; so at most this many keys can be hot.
HOT_SHARE = 1_000

# One thread for each task's matrix products and encoders: Spark runs the tasks side by side.
for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
    os.environ.setdefault(_name, "1")


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/{name}.parquet")


def extended(rows: DataFrame, more: str) -> T.StructType:
    """The schema of ``rows`` with further columns, given as DDL."""
    return T.StructType([*rows.schema.fields, *T.StructType.fromDDL(more).fields])


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def bucket(column: str, modulus: int) -> Column:
    """The remainder by which the contracts split rows: crc32 of the identifier as text; a null counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


def share(*columns: str | Column) -> Column:
    """A number from 0 to 1 that depends on the values only."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)).cast("double") / float(1 << 40)


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Left join of rows to a table with one row for each key, where column ``count`` has the key's number of rows.

    A key with at least 1/1000 of ``total`` rows is hot: there can be a thousand of those at most, whatever the data, so they
    are broadcast and their rows stay where they are. All others meet by an ordinary join on the keys. ``table`` should be
    materialised; its other columns are appended to the rows.
    """
    values = [c for c in table.columns if c not in keys]
    is_hot = F.col(count) * HOT_SHARE >= F.lit(total)
    hot = table.filter(is_hot).select(*keys, F.struct(*values).alias("__hot"))
    cold = table.filter(~is_hot).select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.lit(0).cast("long").alias("__spread"), F.struct(*values).alias("__cold"))
    spread = F.when(F.col("__hot").isNull(), F.lit(0).cast("long")).otherwise(F.monotonically_increasing_id() + 1)
    found = rows.join(F.broadcast(hot), keys, "left").withColumn("__own_spread", spread)
    on = [F.col(k) == F.col(f"__k_{k}") for k in keys] + [F.col("__own_spread") == F.col("__spread")]
    joined = found.join(cold, on, "left").withColumn("__found", F.coalesce("__hot", "__cold"))
    return joined.select(*rows.columns, *(F.col(f"__found.{v}").alias(v) for v in values))


def prefix_sums(rows: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Rows with ``out``: the sum of ``value`` over all rows before them in ``order``, which must be a total order.

    Rows are range-partitioned and written once; each partition's total goes to the driver (one number for each partition),
    and partitions then add up on their own. Sums stay exact in 64 bits.
    """
    ranged = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    totals = ranged.groupBy("__part").agg(F.sum(value).alias("n")).collect()
    before, running = {}, 0
    for row in sorted(totals, key=lambda r: r["__part"]):
        before[row["__part"]] = running
        running += row["n"] or 0
    schema = extended(rows, f"`{out}` bigint")
    names = rows.columns

    def add_up(batches):
        carried = None
        for batch in batches:
            if not len(batch):
                continue
            if carried is None:
                carried = before[int(batch["__part"].iloc[0])]
            sizes = batch[value].astype("int64")
            upto = sizes.cumsum() + carried
            batch[out] = upto - sizes
            carried = int(upto.iloc[-1])
            yield batch[[*names, out]]

    return ranged.mapInPandas(add_up, schema)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b) of different nodes; nodes without edges are their own.

    Smallest labels travel over edges and are then followed to their own labels, so chains shorten by halves; every round is
    written to the shared folder. Labels are aggregated on the map side before they are dealt out, and rounds touch only
    nodes that have an edge.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        heard = both.join(labels, both.a == labels.node).groupBy(F.col("b").alias("other")).agg(F.min("component").alias("heard"))
        nearer = labels.join(heard, labels.node == heard.other, "left").select(
            "node", F.col("component").alias("was"), F.least("component", "heard").alias("component")
        )
        nearer = cut_lineage(nearer)
        roots = nearer.select(F.col("node").alias("root"), F.col("component").alias("further"))
        jumped = nearer.join(roots, nearer.component == roots.root, "left").select(
            "node", "was", F.least("component", "further").alias("component")
        )
        jumped = cut_lineage(jumped)
        changed = jumped.filter(F.col("was") != F.col("component")).limit(1).count()
        labels = jumped.select("node", "component")
        if not changed:
            break
    linked = labels.select(F.col("node").alias("__node"), "component")
    return nodes.join(linked, F.col("node") == F.col("__node"), "left").select("node", F.coalesce("component", "node").alias("component"))
