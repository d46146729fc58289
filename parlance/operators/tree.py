"""Message-tree linearisation.

Semantics: the root is the first node (map order) whose parent is empty
(null, '' or '0'); nodes are emitted in preorder following ``children``
left to right across all branches; child ids with no node are skipped; a
node is visited once (cycle guard); nodes not reachable from the root are
dropped.

Plan: for well-formed trees (every node listed by at most one parent) the
order is computed with pointer doubling. Each node carries (anc, top,
path, depth): ``path`` holds the sibling ordinals of the branching points
on the way down (only where a parent has more than one child, so a linear
chain of n messages keeps an empty path instead of an n-long one).
Each round is one join on (conv_id, node) of the nodes that have not reached
their end, and halves their remaining distance, so a conversation of depth d
needs ceil(log2 d) rounds of fewer and fewer rows; each round's output is
checkpointed to the shared folder (no lineage growth).
Sorting by (path, depth) inside a conversation is the preorder.

Conversations where a node is listed by two parents (a DAG, or a child
repeated) need the visit-once rule of a real DFS; only those conversations
go to an exact per-conversation DFS in ``applyInPandas``. A group there is
one conversation, i.e. one export record.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.plans.ranks import grouped_rank

ORDER_SCHEMA = "conv_id string, node_id string, pos bigint"


def _empty_parent(c):
    return c.isNull() | c.isin("", "0")


def roots(nodes: DataFrame) -> DataFrame:
    """First node in map order with an empty parent, per conversation."""
    return nodes.where(_empty_parent(F.col("parent"))).groupBy("conv_id").agg(
        F.min_by("node_id", "map_pos").alias("root"))


def edges(nodes: DataFrame, root: DataFrame) -> DataFrame:
    """Parent -> child edges from ``children`` lists, child ids without a
    node and edges back into the root dropped."""
    ex = nodes.select("conv_id", F.col("node_id").alias("src"),
                      F.posexplode(F.coalesce("children", F.array())).alias("child_ord", "dst"))
    existing = nodes.select("conv_id", F.col("node_id").alias("dst"))
    e = ex.join(existing, ["conv_id", "dst"], "left_semi").join(root, "conv_id")
    return e.where(F.col("dst") != F.col("root")).select("conv_id", "src", "dst", F.col("child_ord").cast("bigint").alias("child_ord"))


def linearise_tree(nodes: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(conv_id, node_id, pos) with pos 0-based preorder of reachable
    nodes. ``nodes`` needs conv_id, node_id, map_pos, parent, children."""
    nodes = nodes.select("conv_id", "node_id", "map_pos", "parent", "children")
    root = roots(nodes)
    # Edges carry the conversation's root and a "complex" flag (some node
    # listed by two parents); computed once and stored, every later step
    # reads the stored edges.
    e = edges(nodes, root)
    indeg = e.groupBy("conv_id", "dst").agg(F.count(F.lit(1)).alias("n"))
    complex_convs = indeg.where("n > 1").select("conv_id").distinct()
    e = e.join(complex_convs.withColumn("_complex", F.lit(True)), "conv_id", "left") \
        .withColumn("_complex", F.coalesce("_complex", F.lit(False))).checkpoint(eager=True)
    has_complex = e.where("_complex").limit(1).count() > 0
    complex_convs = e.where("_complex").select("conv_id").distinct()
    simple_e = e.where(~F.col("_complex")).drop("_complex")
    fanout = simple_e.groupBy("conv_id", "src").agg(F.count(F.lit(1)).alias("fanout"))
    simple_nodes = (nodes.join(complex_convs, "conv_id", "left_anti") if has_complex else nodes).join(root, "conv_id")

    # initial pointers: each node's unique listing parent
    up = simple_e.join(fanout, ["conv_id", "src"]).select(
        "conv_id", F.col("dst").alias("node_id"), F.col("src").alias("anc"),
        F.when(F.col("fanout") > 1, F.array(F.col("child_ord"))).otherwise(F.array().cast("array<bigint>")).alias("path"))
    state = simple_nodes.select("conv_id", "node_id", "root").join(up, ["conv_id", "node_id"], "left").select(
        "conv_id", "node_id", "root", "anc",
        F.coalesce("anc", "node_id").alias("top"),
        F.coalesce("path", F.array().cast("array<bigint>")).alias("path"),
        F.when(F.col("anc").isNull(), 0).otherwise(1).cast("bigint").alias("depth"))

    if max_rounds is None:
        biggest = nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 1
        max_rounds = max(1, math.ceil(math.log2(max(biggest, 2)))) + 1
    # Nodes that reached their end leave the rounds: a round joins and stores
    # the others alone, and looks their ancestors up among all.
    state = state.checkpoint(eager=True)
    ended, active = [state.where(F.col("anc").isNull())], state.where(F.col("anc").isNotNull())
    for _ in range(max_rounds):
        if active.limit(1).count() == 0:
            break
        known = reduce(DataFrame.unionByName, [*ended, active])
        a = known.select("conv_id", F.col("node_id").alias("anc"), F.col("anc").alias("a_anc"), F.col("top").alias("a_top"),
                         F.col("path").alias("a_path"), F.col("depth").alias("a_depth"))
        moved = active.join(a, ["conv_id", "anc"]).select(
            "conv_id", "node_id", "root", F.col("a_anc").alias("anc"), F.col("a_top").alias("top"),
            F.concat("a_path", "path").alias("path"), (F.col("a_depth") + F.col("depth")).alias("depth")).checkpoint(eager=True)
        ended.append(moved.where(F.col("anc").isNull()))
        active = moved.where(F.col("anc").isNotNull())

    # reachable: the chain ends at the chosen root (cycles never end)
    reach = reduce(DataFrame.unionByName, ended).where(F.col("top") == F.col("root"))
    simple_order = grouped_rank(reach.select("conv_id", "node_id", "path", "depth"), ["conv_id"],
                                ["path", "depth"], "_rank") \
        .select("conv_id", "node_id", (F.col("_rank") - 1).alias("pos"))

    # The exact branch starts Python workers; skip it when no conversation
    # needs it.
    if not has_complex:
        return simple_order
    cn = nodes.join(complex_convs, "conv_id", "left_semi").select(
        F.col("conv_id").cast("string").alias("conv_id"), "node_id", "map_pos", "parent", "children")
    exact = cn.groupBy("conv_id").applyInPandas(_dfs_group, ORDER_SCHEMA)
    key_type = nodes.schema["conv_id"].dataType
    return simple_order.unionByName(exact.withColumn("conv_id", F.col("conv_id").cast(key_type)))


def _dfs_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Visit-once preorder of one conversation: every level of the walk is an
    iterator over the children still to try."""
    pdf = pdf.sort_values("map_pos")
    kids = dict(zip(pdf["node_id"], (() if c is None else tuple(c) for c in pdf["children"]), strict=True))
    starts = pdf["node_id"][[p is None or p in ("", "0") for p in pdf["parent"]]]
    place: dict[str, int] = {}
    levels = [iter(starts[:1])]
    while levels:
        node = next((n for n in levels[-1] if n in kids and n not in place), None)
        if node is None:
            levels.pop()
        else:
            place[node] = len(place)
            levels.append(iter(kids[node]))
    return pd.DataFrame({"conv_id": pdf["conv_id"].iloc[0], "node_id": list(place), "pos": list(place.values())})
