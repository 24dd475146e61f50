"""A prefix trie of conversations: sorted shards finish their own nodes, nodes that cross shard borders add up partial results."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from plumbline.llm.common import join_counted, read, text_of
from plumbline.plans.durable import cut_lineage

#: Conversations take their first turns from the first of so many; a hash of the identifier says how many, below this number.
GROUP, MOST_SHARED = 5, 9
#: Hexadecimal digits of a turn in a path: of the SHA-256 of its role and text, and of the number of bytes of the text.
DIGEST, LENGTH = 32, 8
TURN = DIGEST + LENGTH
#: Bytes of paths in a shard, about, with so many for the rest of a row: what a task holds.
SHARD_BYTES, ROW_BYTES = 1 << 24, 32
COUNTS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
FOUND = (
    "owner long, shard long, depth long, conv_id long, parent_owner long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends binary, ends_sha256 string"
)


def turn_digest(role: str, text: str) -> Column:
    """What a turn is known by: the same for equal role and text only. It ends in the number of the text's bytes."""
    own = F.concat(F.octet_length(text_of(role)).cast("string"), F.lit(":"), text_of(role), text_of(text))
    size = F.lower(F.hex(F.octet_length(text_of(text)).cast("long")))
    return F.concat(F.substring(F.sha2(own, 256), 1, DIGEST), F.lpad(size, LENGTH, "0"))


def conversation_paths(conversations: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, path): the digests of a conversation's turns one after another, in the order of ``turn``, null first.

    Turns of one number follow each other by digest. Texts stay where they are: a turn travels as 40 characters, so a
    conversation of 50 million turns is still one row. Rows without identifier take no part.
    """
    turns = conversations.filter(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), turn_digest(role, text).alias("digest"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "digest")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda t: t["digest"]), "").alias("path"))


def rebuilt(paths: DataFrame) -> DataFrame:
    """The paths with their first h turns from conversation c - c % 5 (none if that is absent), where h is crc32(c) % 9."""
    number = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST_SHARED)).cast("int")
    own = paths.select("conv_id", "path", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("leader"), (number * TURN).alias("shared"))
    heads = paths.filter(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("leader"), F.substring("path", 1, (MOST_SHARED - 1) * TURN).alias("head"))
    head = F.coalesce(F.col("head").substr(F.lit(1), F.col("shared")), F.lit(""))
    tail = F.col("path").substr(F.col("shared") + 1, F.length("path"))
    return own.join(heads, "leader", "left").select("conv_id", F.concat(head, tail).alias("path"))


def shared_turns(first: str, second: str) -> int:
    """How many turns two paths have in common at their beginning."""
    if first == second:
        return len(first) // TURN
    low, high = 0, min(len(first), len(second)) // TURN
    while low < high:  # the longest prefix that agrees, by halves
        middle = (low + high + 1) // 2
        low, high = (middle, high) if first[: middle * TURN] == second[: middle * TURN] else (low, middle - 1)
    return low


def skeleton(shards: DataFrame) -> dict[int, tuple[int, int]]:
    """The trie of the paths at which the range partitioning splits, by shard: (turns shared with the shard before, -1 for the
    first, and turns that all its own paths share). Two numbers a shard are all that the driver gets and sends to the tasks.

    A node with conversations in two shards is a common beginning of the paths on both sides of a border; all others lie in one.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            back = [shared_turns(a, b) if isinstance(a, str) else -1 for a, b in zip(batch["before"], batch["first"])]
            inside = [shared_turns(a, b) for a, b in zip(batch["first"], batch["last"])]
            yield pd.DataFrame({"shard": batch["shard"], "back": back, "inside": inside})

    ends = shards.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    bordered = ends.withColumn("before", F.lag("last").over(W.orderBy("shard")))  # a row for each shard
    return {r["shard"]: (r["back"], r["inside"]) for r in bordered.mapInPandas(compare, "shard long, back long, inside long").collect()}


def owners(shard: int, order: list[int], borders: dict[int, tuple[int, int]]) -> list[int]:
    """The shards in which the nodes begin that reach into ``shard`` from before, by depth."""
    reach = borders[shard][0]
    found = [shard] * (reach + 1)
    at = order.index(shard) - 1
    while reach >= 0:
        begins = min(borders[order[at]])  # nodes of this depth and less come from still further before
        for depth in range(begins + 1, reach + 1):
            found[depth] = order[at]
        reach, at = min(reach, begins), at - 1
    return found


class Open:
    """A node whose conversations are being read."""

    __slots__ = ("depth", "size", "goes_back", "owner", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends", "extended", "children")

    def __init__(self, depth: int, size: int, goes_back: bool, owner: int):
        self.depth, self.size, self.goes_back, self.owner = depth, size, goes_back, owner
        self.conv_id, self.n_convs, self.n_children, self.n_leaves = None, 0, 0, 0
        self.saved = 0 if goes_back else -size  # the first member saves nothing
        self.ends, self.extended, self.children = [], False, []


def shard_nodes(paths: list[str], ids: list[int], shard: int, back: list[int], ahead: int) -> list[tuple]:
    """The nodes of one sorted shard: finished ones, and the shard's part of those that reach into a neighbour.

    Every number is a sum over shards: a node counts as child, and its text once against the savings, where it begins; as a leaf
    where it ends. So parts are put together by one reduction and no second walk over the trie is needed.
    """
    rows, begins = [], len(back) - 1

    def open_node(path: str, depth: int, with_first: int) -> Open:
        goes_back = depth <= min(begins, with_first)
        size = int(path[depth * TURN - LENGTH : depth * TURN], 16) if depth else 0
        return Open(depth, size, goes_back, back[depth] if goes_back else shard)

    def close(node: Open, parent: Open | None, on_last: bool) -> None:
        goes_on = on_last and node.depth <= ahead
        node.saved += node.n_convs * node.size
        if not node.extended and not goes_on:
            node.n_leaves += 1
        crossing = node.goes_back or goes_on
        text = ",".join(map(str, node.ends)).encode()
        for child in node.children:  # finished but for their parent's name
            child[5] = None if crossing else node.conv_id
            child[4] = node.owner if crossing else None
            rows.append(tuple(child))
        node.children = []
        own = [node.owner if crossing else None, shard, node.depth, node.conv_id, None, None, node.n_convs, node.n_children, node.n_leaves, node.saved]
        own += [text, None] if crossing else [None, hashlib.sha256(text).hexdigest()]
        if parent is None:
            rows.append(tuple(own))
            return
        parent.extended = True
        parent.conv_id = node.conv_id if parent.conv_id is None else min(parent.conv_id, node.conv_id)
        parent.n_convs += node.n_convs
        parent.n_children += not node.goes_back
        parent.n_leaves += node.n_leaves
        parent.saved += node.saved
        parent.children.append(own)

    stack = [open_node("", 0, 0)]
    before = ""
    for path, id in zip(paths, ids):
        common, length = shared_turns(before, path), len(path) // TURN
        while len(stack) - 1 > common:
            node = stack.pop()
            close(node, stack[-1], False)
        with_first = shared_turns(paths[0], path) if length > common else 0
        stack += [open_node(path, depth, with_first) for depth in range(common + 1, length + 1)]
        top = stack[-1]
        top.ends.append(id)
        top.conv_id = id if top.conv_id is None else min(top.conv_id, id)
        top.n_convs += 1
        before = path
    while stack:
        node = stack.pop()
        close(node, stack[-1] if stack else None, True)
    return rows


def shard_task(borders: dict[int, tuple[int, int]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    order = sorted(borders)
    names = [c.strip().split(" ")[0] for c in FOUND.split(",")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paths, ids, shard = [], [], None
        for batch in batches:
            if len(batch):
                shard = int(batch["shard"].iloc[0])
                paths += batch["path"].tolist()
                ids += batch["conv_id"].tolist()
        if shard is None:
            return
        later = order.index(shard) + 1
        ahead = borders[order[later]][0] if later < len(order) else -1
        rows = shard_nodes(paths, ids, shard, owners(shard, order, borders), ahead)
        for at in range(0, len(rows), 10_000):
            made = pd.DataFrame(rows[at : at + 10_000], columns=names)
            for name in names[:-2]:
                made[name] = made[name].astype("Int64")
            yield made

    return work


def digest_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of each crossing node's identifiers, from the parts of its shards one after another."""
    key, digest = None, None
    for batch in batches:
        rows = []
        for owner, depth, ends in zip(batch["owner"], batch["depth"], batch["ends"]):
            if key != (owner, depth):
                if key is not None:
                    rows.append((*key, digest.hexdigest()))
                key, digest = (owner, depth), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ends)
        yield pd.DataFrame(rows, columns=["owner", "depth", "sha"]).astype({"owner": "int64", "depth": "int64"})
    if key is not None:
        yield pd.DataFrame([(*key, digest.hexdigest())], columns=["owner", "depth", "sha"])


def prefix_trie(paths: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, path): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.

    Conversations are range-partitioned by path and identifier, so that copies, even if they are a third of all, spread over
    many shards. Each shard walks its own rows once. The root and other nodes that reach over a border give one part a shard;
    those are added up and then name the parents of the nodes below them. The identifiers of conversations that end at such a
    node are digested in a stream, from one piece of text a shard.
    """
    spark = paths.sparkSession
    paths = cut_lineage(paths.select(F.col("conv_id").cast("long").alias("conv_id"), "path"))
    size = paths.agg(F.sum(F.length("path") + ROW_BYTES)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    ranged = paths.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    ranged = cut_lineage(ranged.withColumn("shard", F.spark_partition_id().cast("long")))
    borders = skeleton(ranged)
    found = cut_lineage(ranged.mapInPandas(shard_task(borders), FOUND))
    parts = found.filter("owner IS NOT NULL")
    whole = parts.groupBy("owner", "depth").agg(F.min("conv_id").alias("conv_id"), F.max("parent_owner").alias("parent_owner"), *(F.sum(c).alias(c) for c in COUNTS))
    ended = parts.filter(F.octet_length("ends") > 0).select("owner", "depth", "shard", "ends")
    digests = ended.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "shard").mapInPandas(digest_ends, "owner long, depth long, sha string")
    crossing = cut_lineage(whole.join(digests, ["owner", "depth"], "left").withColumn("ends_sha256", F.coalesce("sha", F.sha2(F.lit(""), 256))))
    named = found.filter("owner IS NULL")
    rest = ["depth", "conv_id", *COUNTS, "ends_sha256"]
    below = named.filter("parent_owner IS NOT NULL").select("parent_owner", *rest).unionByName(crossing.filter("parent_owner IS NOT NULL").select("parent_owner", *rest))
    parents = crossing.select(F.col("owner").alias("parent_owner"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("above"), "n_children")
    total = crossing.agg(F.sum("n_children")).first()[0] or 0
    joined = join_counted(below.withColumnRenamed("n_children", "own_children"), parents, ["parent_owner", "depth"], "n_children", total)
    out = lambda df, parent, children="n_children": df.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", F.col(children).alias("n_children"), "n_leaves", "saved_tokens", "ends_sha256"
    )
    inner = out(named.filter("parent_owner IS NULL"), F.col("parent_conv_id"))
    top = out(crossing.filter("parent_owner IS NULL"), F.lit(None).cast("long"))
    return inner.unionByName(top).unionByName(out(joined, F.col("above"), "own_children"))


def conversation_trie(conversations: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rebuild: bool = True) -> DataFrame:
    """The prefix trie of all conversations; see :func:`prefix_trie`. ``rebuild`` gives them the first turns of their leaders.

    A null role or text is an empty one; null turns come first, and turns of one number in the order of their digests, so repeated
    rows are turns of their own. Rows without conv_id belong to no conversation and take no part; turnless conversations end at the
    root. An empty table has no nodes, not even a root. Other columns are not read, so their names cannot clash.
    """
    paths = conversation_paths(conversations, id, turn, role, text)
    return prefix_trie(rebuilt(cut_lineage(paths)) if rebuild else paths)


def op12_prefix_trie(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations; see :func:`conversation_trie`."""
    return conversation_trie(read(spark, path, "conversations"))


OP12_SQL = f"""
WITH RECURSIVE turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT DISTINCT conv_id, conv_id - conv_id % {GROUP} AS leader,
  xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(len(conv_id::VARCHAR)), lambda i: ascii((conv_id::VARCHAR)[i + 1])::BIGINT),
    lambda crc, byte: list_reduce([xor(crc, byte)] || range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) % {MOST_SHARED} AS h FROM turns),
rebuilt AS (
  SELECT c.conv_id, place, role, text FROM convs c JOIN turns t ON t.conv_id = c.leader AND place <= h
  UNION ALL SELECT c.conv_id, h + place, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND place > h),
ordered AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth, sha256(length(role)::VARCHAR || ':' || role || text) AS own, strlen(text) AS bytes FROM rebuilt),
members AS (
  SELECT conv_id, 0::BIGINT AS depth, '' AS path, 0::BIGINT AS bytes FROM convs
  UNION ALL SELECT o.conv_id, o.depth, m.path || o.own, o.bytes FROM members m JOIN ordered o ON o.conv_id = m.conv_id AND o.depth = m.depth + 1),
lengths AS (SELECT conv_id, max(depth) AS turns FROM members GROUP BY conv_id),
nodes AS (SELECT path, depth, bytes, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE turns = depth), '') AS ends
  FROM members JOIN lengths USING (conv_id) GROUP BY path, depth, bytes),
counted AS (SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.path[: 64 * n.depth] = n.path) AS n_children FROM nodes n),
below AS (SELECT n.path, count(*) FILTER (WHERE d.n_children = 0) AS n_leaves, sum((d.n_convs - 1) * d.bytes) AS saved_tokens
  FROM counted n JOIN counted d ON d.path[: 64 * n.depth] = n.path GROUP BY n.path)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM counted n JOIN below USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[: 64 * (n.depth - 1)] AND p.depth = n.depth - 1
"""
