"""Ingest: raw exports -> stored ``headers`` and ``messages`` tables.

read (S1/S2) -> records (S3) -> messages from trees (W1) or flat lists
(S4/S5) -> chat roles, non-empty (P1/P2) -> at least two messages (P3) ->
dedup last-wins (W2). Records are keyed by their scan id until dedup, so
duplicate conversation ids in different files never mix their nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.sources import export as S
from parlance.operators.tree import linearise_tree
from parlance.plans.materialize import materialize
from parlance.plans.ranks import grouped_rank


def record_messages(hdr: DataFrame) -> DataFrame:
    """Messages of every record (rec = scan id), all roles, in order."""
    # The mapping is exploded once into a columnar node table: the tree steps
    # read its structure columns only, the text is read once more, for the join.
    nodes = materialize(S.tree_nodes(hdr).withColumn("conv_id", F.col("file_pos")).drop("file", "file_pos"), "nodes")
    order = linearise_tree(nodes)
    tree_msgs = nodes.where("has_message").join(order, ["conv_id", "node_id"]).select(
        F.col("conv_id").alias("rec"), "pos", F.coalesce("role", F.lit("unknown")).alias("role"), "content",
        F.coalesce("msg_time", F.lit(0.0)).alias("ts"))
    flat = S.flat_messages(hdr).select(F.col("file_pos").alias("rec"), "pos", "role", "content", "ts")
    return tree_msgs.unionByName(flat)


def dedup_last_wins(hdr: DataFrame) -> DataFrame:
    """Per conversation id keep the record from the last file; within a
    file the reference's newest-first order makes the oldest, then the
    later-positioned record win."""
    # max_by is algebraic: it pre-aggregates map-side, so an id repeated
    # across many files never lands in one task.
    winner = hdr.groupBy("conv_id").agg(F.max_by("file_pos", F.struct(
        F.col("file"), (-F.col("create_time")).alias("t"), F.col("file_pos"))).alias("file_pos"))
    return hdr.join(winner, ["conv_id", "file_pos"], "left_semi")


def ingest(spark: SparkSession, path: str, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(headers, messages) of an export file or directory."""
    return ingest_raw(S.read_export(spark, path, glob))


def ingest_raw(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, messages) from raw records carrying ``file`` and ``file_pos``.

    The records are written once as parquet (VARIANT content included): the
    JSON files are parsed a single time and every later step, including the
    pointer-doubling rounds, reads columnar data."""
    raw = materialize(raw, "raw-records")
    hdr = S.conversation_headers(raw)
    msgs = materialize(S.chat_messages(record_messages(hdr)), "record-messages")
    counts = msgs.groupBy("rec").agg(F.count(F.lit(1)).alias("message_count"),
                                     F.count_if(F.col("role") == "user").alias("user_messages"))
    kept = hdr.select("conv_id", "title", "create_time", "update_time", "file", F.col("file_pos").alias("rec"),
                      F.col("file_pos")).join(counts.where("message_count >= 2"), "rec")
    winners = dedup_last_wins(kept)
    joined = msgs.join(winners.select("rec", "conv_id"), "rec")
    out_msgs = grouped_rank(joined, ["rec"], ["pos"], "_rank").select(
        "conv_id", (F.col("_rank") - 1).alias("pos"), "role", "content", "ts")
    headers = winners.select("conv_id", "title", "create_time", "update_time", "message_count", "user_messages", "file")
    return materialize(headers, "ingest-headers"), materialize(out_msgs, "ingest-messages")
