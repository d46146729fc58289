"""Aggregations (A1-A8) over headers and labels.

None of these reads message text: they take ``headers`` (one row per
conversation, no text) or the message table projected to (conv_id, role),
so Catalyst prunes the text column at the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import fmt_time

# Histogram bins: label and exclusive upper bound (the last bin takes the rest).
from parlance.functions.formats import HIGH_RELEVANCE, HISTOGRAM_BINS  # noqa: E402


def message_counts(msgs: DataFrame, min_messages: int | None = None,
                   with_update_time: bool = False) -> DataFrame:
    """A1 (+P3/P4): message_count and user_messages per conversation.

    Partial aggregation runs map-side, so the shuffle carries one row per
    conversation per input partition."""
    aggs = [F.count(F.lit(1)).alias("message_count"),
            F.count_if(F.col("role") == "user").alias("user_messages")]
    if with_update_time:
        aggs.append(F.max("ts").alias("update_time"))
    out = msgs.groupBy("conv_id").agg(*aggs)
    if min_messages is not None:
        out = out.where(F.col("message_count") >= min_messages)
    return out


def min_messages(headers: DataFrame, n: int = 4) -> DataFrame:
    """Keep conversations with at least ``n`` messages."""
    return headers.where(F.col("message_count") >= n)


def parse_summary(headers: DataFrame, min_msgs: int = 4) -> DataFrame:
    """A2 (+O7): one row: total, after filter, skipped, oldest, newest,
    rounded average message count over the kept conversations."""
    kept = F.col("message_count") >= min_msgs
    return headers.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(kept).alias("after_filter"),
        F.count_if(~kept).alias("skipped"),
        fmt_time(F.min(F.when(kept, F.col("create_time")))).alias("oldest"),
        fmt_time(F.max(F.when(kept, F.col("create_time")))).alias("newest"),
        F.round(F.sum(F.when(kept, F.col("message_count"))) / F.count_if(kept)).cast("bigint").alias("avg_messages"),
    )


def corpus_stats(headers: DataFrame, state: DataFrame, min_msgs: int = 4) -> DataFrame:
    """A4: raw, filtered, labelled, unlabelled, total messages and the
    rounded average (denominator at least 1), in one aggregation pass."""
    kept = F.col("message_count") >= min_msgs
    hit = headers.select("conv_id", "message_count").join(
        state.select("conv_id", F.lit(True).alias("_hit")), "conv_id", "left")
    agg = hit.agg(
        F.count(F.lit(1)).alias("raw"),
        F.count_if(kept).alias("filtered"),
        F.count_if(kept & F.col("_hit").isNotNull()).alias("labelled"),
        F.coalesce(F.sum(F.when(kept, F.col("message_count"))), F.lit(0)).cast("bigint").alias("total_messages"),
    )
    return agg.select(
        "raw", "filtered", "labelled",
        (F.col("filtered") - F.col("labelled")).alias("unlabelled"),
        "total_messages",
        F.round(F.col("total_messages") / F.greatest(F.lit(1), F.col("filtered"))).cast("bigint").alias("avg_messages"),
    )


def category_breakdown(labelled: DataFrame) -> DataFrame:
    """A5: per category count, average relevance (2 dp), count >= 0.7;
    count-desc with slug as the tie-break."""
    ex = labelled.select(F.explode("categories").alias("slug"), "relevance_score")
    return (
        ex.groupBy("slug")
        .agg(
            F.count(F.lit(1)).alias("conversations"),
            F.round(F.avg("relevance_score"), 2).alias("avg_relevance"),
            F.count_if(F.col("relevance_score") >= HIGH_RELEVANCE).alias("high_relevance"),
        )
        .orderBy(F.col("conversations").desc(), "slug")
    )


def label_counts(labelled: DataFrame) -> DataFrame:
    """Conversations per label, count-desc."""
    return (
        labelled.select(F.explode("categories").alias("slug"))
        .groupBy("slug").agg(F.count(F.lit(1)).alias("conversations"))
        .orderBy(F.col("conversations").desc(), "slug")
    )


def _bin(score):
    expr = None
    for label, upper in HISTOGRAM_BINS:
        cond = score < upper if upper is not None else None
        if expr is None:
            expr = F.when(cond, F.lit(label))
        elif cond is not None:
            expr = expr.when(cond, F.lit(label))
        else:
            expr = expr.otherwise(F.lit(label))
    return expr


def relevance_histogram(labelled: DataFrame) -> DataFrame:
    """Five fixed bins over scores > 0; empty bins kept, nothing at all
    when no score is positive."""
    spark = labelled.sparkSession
    bins = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(HISTOGRAM_BINS)], "bin_ord int, bin string")
    counts = (
        labelled.where(F.col("relevance_score") > 0)
        .groupBy(_bin(F.col("relevance_score")).alias("bin"))
        .agg(F.count(F.lit(1)).alias("conversations"))
    )
    out = bins.join(counts, "bin", "left").select(
        "bin_ord", "bin", F.coalesce("conversations", F.lit(0)).cast("bigint").alias("conversations"))
    # Five rows: the empty-window total is trivial here.
    total = F.sum("conversations").over(Window.partitionBy())
    return out.withColumn("_total", total).where("_total > 0").drop("_total").orderBy("bin_ord")


def category_index(labelled: DataFrame, cats: DataFrame) -> DataFrame:
    """Per configured category: count and average relevance (3 dp, 0
    when empty). A conversation listing a slug twice counts once."""
    members = labelled.select("conv_id", F.explode(F.array_distinct("categories")).alias("slug"), "relevance_score")
    stats = members.groupBy("slug").agg(
        F.count(F.lit(1)).alias("count"),
        F.round(F.avg("relevance_score"), 3).alias("avg_relevance"),
    )
    # stats has one row per slug, so this join is as small as the taxonomy.
    return cats.select("slug", "name").join(stats, "slug", "left").select(
        "slug", "name",
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
        F.coalesce("avg_relevance", F.lit(0.0)).alias("avg_relevance"),
    )


def exported_total(labelled: DataFrame, cats: DataFrame) -> DataFrame:
    """A7 total: distinct conversations in at least one exported slug."""
    members = labelled.select("conv_id", F.explode("categories").alias("slug"))
    return (
        members.join(cats.select("slug"), "slug", "left_semi")
        .agg(F.count_distinct("conv_id").alias("total_conversations"))
    )


def concat_ordered(df: DataFrame, key: str, order: str, value: str, sep: str = "\n",
                   chunk: int = 1000) -> DataFrame:
    """Ordered concatenation in bounded pieces: (key, chunk, text) with
    at most ``chunk`` values per row (a parameter of the output's shape); the chunks of a key joined by ``sep``
    in chunk order give the whole text. A key with a huge number of values
    is therefore split over many groups instead of one task."""
    from parlance.plans.ranks import grouped_rank
    ranked = grouped_rank(df.select(key, order, value), [key], [order], "_r")
    g = ranked.withColumn("chunk", F.floor((F.col("_r") - 1) / chunk).cast("bigint")).groupBy(key, "chunk").agg(
        F.array_sort(F.collect_list(F.struct("_r", F.col(value).alias("_v")))).alias("_p"))
    return g.select(key, "chunk", F.array_join(F.transform("_p", lambda x: x["_v"]), sep).alias("text"))
