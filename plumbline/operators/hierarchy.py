"""Rule groups: a graph of groups inside groups, resolved to rules, checked for cycles, rolled up over run history.

``edges`` is ``(parent_id, child_id)``, ``members`` is ``(group_id, rule_id)``, ``groups`` and ``rules`` are ``(id)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from plumbline.operators.history import latest_per_rule, worst_status
from plumbline.plans.durable import cut_lineage
from plumbline.spec import Rule


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``(start_id, group_id)`` for every group reached from each start by one or more edges; cycles are fine.

    Paths are doubled: what is reached by up to n edges, followed by a jump of exactly n, reaches up to 2n, and two jumps of n are
    one of 2n. So a chain a thousand deep takes ten rounds. All pairs found so far are one written table.
    """
    jumps = cut_lineage(edges.select(F.col("parent_id").alias("near"), F.col("child_id").alias("far")).distinct())
    first = starts.select(F.col("id").alias("start_id")).distinct().join(jumps, F.col("start_id") == F.col("near"))
    seen = cut_lineage(first.select("start_id", F.col("far").alias("group_id")))
    while True:
        further = seen.join(jumps, seen.group_id == jumps.near).select("start_id", F.col("far").alias("group_id")).distinct()
        new = cut_lineage(further.join(seen, ["start_id", "group_id"], "left_anti"))
        if new.isEmpty():
            return seen
        seen = cut_lineage(seen.unionByName(new))
        again = jumps.select(F.col("near").alias("from"), F.col("far").alias("near"))
        jumps = cut_lineage(again.join(jumps, "near").select(F.col("from").alias("near"), "far").distinct())


def closure(edges: DataFrame, groups: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Every start with itself and all existing groups below it. Missing groups end the walk."""
    starts = (groups if starts is None else starts).select("id").join(groups.select("id"), "id", "left_semi").distinct()
    known = edges.join(groups.select(F.col("id").alias("child_id")), "child_id", "left_semi")
    itself = starts.select(F.col("id").alias("start_id"), F.col("id").alias("group_id"))
    return itself.unionByName(reachable(known, starts)).distinct()


def resolve(closed: DataFrame, edges: DataFrame, members: DataFrame, groups: DataFrame, rules: DataFrame) -> DataFrame:
    """Per start group: how many rules it stands for, and how many rule and group references lead nowhere."""
    held = closed.join(members, "group_id").join(rules.select(F.col("id").alias("rule_id"), F.lit(True).alias("known")), "rule_id", "left")
    lost_groups = (
        edges.join(groups.select(F.col("id").alias("child_id")), "child_id", "left_anti")
        .groupBy(F.col("parent_id").alias("group_id"))
        .agg(F.count(F.lit(1)).alias("lost"))
    )
    # Rules counted per (group, rule) first, so a rule reachable on many paths is one row.
    per_rule = held.groupBy("start_id", "rule_id").agg(F.max("known").alias("known"), F.count(F.lit(1)).alias("n"))
    per_group = per_rule.groupBy("start_id").agg(
        F.count_if(F.col("known")).alias("rules"), F.sum(F.when(F.col("known").isNull(), F.col("n"))).alias("missing_rules")
    )
    missing = closed.join(lost_groups, "group_id").groupBy("start_id").agg(F.sum("lost").alias("missing_groups"))
    zero = F.lit(0).cast("long")
    return (
        closed.select("start_id").distinct()
        .join(per_group, "start_id", "left")
        .join(missing, "start_id", "left")
        .select(
            F.col("start_id").alias("group_id"),
            F.coalesce("rules", zero).alias("rules"),
            F.coalesce("missing_rules", zero).alias("missing_rules"),
            F.coalesce("missing_groups", zero).alias("missing_groups"),
        )
    )


def group_rules(closed: DataFrame, members: DataFrame, rules: DataFrame) -> DataFrame:
    """``(group_id, rule_id)``: the existing rules of each start group and of all groups below it, each once."""
    known = members.join(rules.select(F.col("id").alias("rule_id")), "rule_id", "left_semi")
    return closed.join(known, "group_id").select(F.col("start_id").alias("group_id"), "rule_id").distinct()


def rules_to_run(resolved: DataFrame, group_id: int, rules: Sequence[Rule]) -> list[Rule]:
    """The rules of one group, for a batch run. Only ids of configured rules reach the driver."""
    mine = resolved.filter(F.col("group_id") == group_id).select("rule_id").distinct()
    wanted = {row.rule_id for row in mine.collect()}
    return [rule for rule in rules if rule.id in wanted]


def inner_edges(edges: DataFrame) -> DataFrame:
    """Edges that can lie on a loop: groups without parents or without children are stripped until none is left."""
    edges = cut_lineage(edges.select("parent_id", "child_id").distinct())
    left, before = edges.count(), None
    while left and left != before:
        inside = edges.join(edges.select(F.col("child_id").alias("parent_id")), "parent_id", "left_semi")
        inside = inside.join(edges.select(F.col("parent_id").alias("child_id")), "child_id", "left_semi")
        edges = cut_lineage(inside.select("parent_id", "child_id"))
        left, before = edges.count(), left
    return edges


def _followed(chain: DataFrame, side: str, singles: int) -> DataFrame:
    """``(node, end)``: where a walk over single nodes comes out; on a loop of single nodes it stays among them."""
    walk = cut_lineage(chain.select("node", F.col(side).alias("end")))
    for _ in range(max(singles, 1).bit_length() + 1):  # each round doubles the steps of all walks
        jump = walk.select(F.col("node").alias("end"), F.col("end").alias("on"))
        walk = cut_lineage(walk.join(jump, "end", "left").select("node", F.coalesce("on", "end").alias("end")))
        if walk.join(walk.select(F.col("node").alias("end")), "end", "left_semi").isEmpty():
            break
    return walk


def strong_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of the groups that reach each other, for all groups left when those without a way in or out are stripped.

    The smallest group that reaches a group is its colour; the groups of a colour that lead back to the one it is named after are one
    component. Then these are taken out, and the rest is coloured again. Each round of each walk costs no more than the edges.
    """
    found, left = None, inner_edges(edges)
    while not left.isEmpty():
        nodes = left.select(F.col("parent_id").alias("node")).union(left.select(F.col("child_id").alias("node"))).distinct()
        colours = cut_lineage(nodes.withColumn("colour", F.col("node")))
        while True:
            heard = left.join(colours, left.parent_id == colours.node).groupBy(F.col("child_id").alias("node")).agg(F.min("colour").alias("heard"))
            nearer = colours.join(heard, "node", "left").select("node", F.col("colour").alias("was"), F.least("colour", "heard").alias("colour"))
            nearer = cut_lineage(nearer)
            changed = nearer.filter(F.col("was") != F.col("colour"))
            colours = nearer.select("node", "colour")
            if changed.isEmpty():
                break
        own = colours.select(F.col("node").alias("parent_id"), "colour"), colours.select(F.col("node").alias("child_id"), F.col("colour").alias("other"))
        inside = cut_lineage(left.join(own[0], "parent_id").join(own[1], "child_id").filter("colour = other").select("parent_id", "child_id"))
        back = cut_lineage(colours.filter(F.col("node") == F.col("colour")).select("node"))
        new = back
        while not new.isEmpty():
            step = inside.join(new, inside.child_id == new.node).select(F.col("parent_id").alias("node")).distinct()
            new = cut_lineage(step.join(back, "node", "left_anti"))
            back = cut_lineage(back.unionByName(new))
        part = colours.join(back, "node", "left_semi").select("node", F.col("colour").alias("component"))
        found = cut_lineage(part if found is None else found.unionByName(part))
        rest = left.join(back.select(F.col("node").alias("parent_id")), "parent_id", "left_anti")
        left = inner_edges(rest.join(back.select(F.col("node").alias("child_id")), "child_id", "left_anti"))
    return found if found is not None else left.select(F.col("parent_id").alias("node"), F.col("child_id").alias("component"))


def groups_in_cycles(edges: DataFrame) -> DataFrame:
    """Groups that contain themselves, found without pairs of them.

    Groups with one way in and one way out are walked over by doubling: such a walk either never leaves, and then all of it is a
    loop, or it is one edge between two other groups. Of the graph left, groups that cannot lie on a loop are stripped, and the
    rest has components; a walk lies on a loop where both its ends are in one.
    """
    edges = cut_lineage(edges.select("parent_id", "child_id").distinct())
    ways_in = edges.groupBy(F.col("child_id").alias("node")).agg(F.count(F.lit(1)).alias("in"), F.min("parent_id").alias("behind"))
    ways_out = edges.groupBy(F.col("parent_id").alias("node")).agg(F.count(F.lit(1)).alias("out"), F.min("child_id").alias("ahead"))
    single = (F.col("in") == 1) & (F.col("out") == 1) & (F.col("behind") != F.col("node"))
    chain = cut_lineage(ways_in.join(ways_out, "node").filter(single).select("node", "behind", "ahead"))
    singles = chain.count()
    ends = _followed(chain, "ahead", singles).select("node", F.col("end").alias("ahead"))
    ends = cut_lineage(ends.join(_followed(chain, "behind", singles).select("node", F.col("end").alias("behind")), "node"))
    names = chain.select("node")
    around = ends.join(names.select(F.col("node").alias("ahead")), "ahead", "left_semi").select("node")
    across = cut_lineage(ends.join(names.select(F.col("node").alias("ahead")), "ahead", "left_anti").select("node", "behind", "ahead"))
    others = edges.join(names.select(F.col("node").alias("parent_id")), "parent_id", "left_anti").join(names.select(F.col("node").alias("child_id")), "child_id", "left_anti")
    core = cut_lineage(others.select("parent_id", "child_id").union(across.select("behind", "ahead")).distinct())
    parts = cut_lineage(strong_components(core))
    loops = core.filter("parent_id = child_id").select(F.col("parent_id").alias("node"))
    large = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    together = parts.join(large, "component", "left_semi").select("node").union(loops)
    first, last = (parts.select(F.col("node").alias(side), F.col("component").alias(f"{side}_part")) for side in ("behind", "ahead"))
    between = across.join(first, "behind").join(last, "ahead").filter(F.col("behind_part") == F.col("ahead_part")).select("node")
    return around.union(together).union(between).select(F.col("node").alias("group_id")).distinct()


def ancestors(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """``(group_id, ancestor_id)``: every group that directly or indirectly contains a target."""
    upward = edges.select(F.col("child_id").alias("parent_id"), F.col("parent_id").alias("child_id"))
    found = reachable(upward, targets)
    return found.select(F.col("start_id").alias("group_id"), F.col("group_id").alias("ancestor_id")).filter("group_id <> ancestor_id")


def would_create_cycle(edges: DataFrame, group_id: int, children: list[int]) -> bool:
    """Whether putting the children under the group closes a loop."""
    if group_id in children:
        return True
    starts = edges.sparkSession.createDataFrame([(c,) for c in children], "id long")
    return not reachable(edges, starts).filter(F.col("group_id") == group_id).isEmpty()


def rollup(resolved: DataFrame, runs: DataFrame) -> DataFrame:
    """Per group: worst latest status of its rules, newest start, failed rows of the latest runs, runs in all.

    ``resolved`` is ``(group_id, rule_id)``. Runs are reduced to one row per rule before they meet the groups.
    """
    latest = latest_per_rule(runs)
    return (
        resolved.join(latest, "rule_id", "left")
        .groupBy("group_id")
        .agg(
            worst_status(F.col("status")).alias("last_status"),
            F.max("started_at").alias("last_run"),
            F.sum("failed_count").alias("last_failed"),
            F.coalesce(F.sum("runs"), F.lit(0)).alias("runs"),
        )
    )
