"""Exchange pairs and their follow-ups.

Pair indices are a running count inside the conversation, which is one
record of the export and so bounded by what a row can hold. The window and
the grouping on (conv_id, pair_index) share one shuffle by conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.formats import NO_REPLY, NO_SUMMARY, PAIR_BATCH, USER_JOIN
from parlance.functions.text import snippet



def message_pairs(msgs: DataFrame) -> DataFrame:
    """W4 + W5: pairs(conv_id, pair_index, user, assistant).

    Gaps and islands: a message's pair is the number of assistant messages
    before it. Consecutive user texts merge with a blank line; an assistant
    with no pending user gets ''; a trailing user gets '(no reply)'."""
    # A running frame, so a conversation is streamed through, not held.
    before = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    tagged = msgs.select(
        "conv_id", "pos", "role", "content",
        F.coalesce(F.sum((F.col("role") == "assistant").cast("bigint")).over(before), F.lit(0)).cast("bigint").alias("pair_index"))
    grouped = tagged.groupBy("conv_id", "pair_index").agg(
        F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("pos", "content")))).alias("_users"),
        F.max(F.when(F.col("role") == "assistant", F.col("content"))).alias("_assistant"),
    )
    return grouped.select(
        "conv_id", "pair_index",
        F.array_join(F.transform("_users", lambda x: x["content"]), USER_JOIN).alias("user"),
        F.coalesce("_assistant", F.lit(NO_REPLY)).alias("assistant"),
    )


def pair_chunks(pairs: DataFrame, n: int = PAIR_BATCH) -> DataFrame:
    """W6 per conversation: chunk = floor(pair_index / n); pair indices are
    dense from 0, so no window is needed."""
    return pairs.withColumn("chunk", F.floor(F.col("pair_index") / n).cast("bigint"))


def valid_ranges(flags: DataFrame) -> DataFrame:
    """Keep ranges whose start and end are JSON integers."""
    from parlance.functions.json import is_int
    return flags.where(is_int("flag", "$.start") & is_int("flag", "$.end")).select(
        "conv_id", "range_ord",
        F.variant_get("flag", "$.start", "bigint").alias("start"),
        F.variant_get("flag", "$.end", "bigint").alias("end"))


def range_slices(ranges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs with start <= pair_index <= end, per range.

    The range is expanded to its pair indices with a guarded
    ``sequence(start, least(end, last_pair))`` and equi-joined on
    (conv_id, pair_index): no range nested-loop join. Clipping at the
    conversation's last pair bounds the expansion by the conversation size
    even for absurd ends; a reversed range expands to nothing."""
    last = pairs.groupBy("conv_id").agg(F.max("pair_index").alias("_last"))
    r = ranges.join(last, "conv_id")
    hi = F.least(F.col("end"), F.col("_last"))
    lo = F.greatest(F.col("start"), F.lit(0))
    expanded = r.where(lo <= hi).select(
        "conv_id", "range_ord", "start", "end",
        F.explode(F.sequence(lo, hi)).alias("pair_index"))
    return expanded.join(pairs, ["conv_id", "pair_index"])


def range_key(start="start", end="end"):
    return F.concat(F.col(start).cast("string"), F.lit("-"), F.col(end).cast("string"))


def attach_one_liners(pairs: DataFrame, summaries: DataFrame, n: int = PAIR_BATCH) -> DataFrame:
    """One-liner per pair from parsed (conv_id, chunk, pair_index,
    one_liner, item_ord) rows of the pair's own chunk: last entry per index
    wins, negative indices dropped, missing -> '(no summary)'. Adds the
    80-column snippets (F7)."""
    last = (
        summaries.where(F.col("pair_index") >= 0)
        .groupBy("conv_id", "chunk", "pair_index")
        .agg(F.max_by("one_liner", "item_ord").alias("one_liner"))
    )
    return pair_chunks(pairs, n).join(last, ["conv_id", "chunk", "pair_index"], "left").select(
        "conv_id", "pair_index",
        snippet("user").alias("user_snippet"),
        snippet("assistant").alias("assistant_snippet"),
        F.coalesce("one_liner", F.lit(NO_SUMMARY)).alias("one_liner"),
    )
