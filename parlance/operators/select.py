"""Selection, hydration and ordering.

Ordering convention (PHP sorts are stable over newest-first input; Spark
sorts are not): every sort ends in the explicit tie-break
``create_time desc, conv_id asc``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.formats import NO_SUMMARY_AVAILABLE, STUB_FACTS, STUB_SUMMARY, STUB_TAGS
from parlance.functions.text import fmt_time, php_trim

def _empty():
    return F.array().cast("array<string>")


def newest_order() -> list[Column]:
    return [F.col("create_time").desc(), F.col("conv_id").asc()]


def relevance_order() -> list[Column]:
    return [F.col("relevance_score").desc()] + newest_order()


def newest_first(df: DataFrame) -> DataFrame:
    """O1."""
    return df.orderBy(*newest_order())


def by_relevance(df: DataFrame) -> DataFrame:
    """O2."""
    return df.orderBy(*relevance_order())


def first_n(df: DataFrame, n: int) -> DataFrame:
    """``--limit`` first N in newest order (a top-k: TakeOrdered)."""
    return df.orderBy(*newest_order()).limit(n)


def hydrate(headers: DataFrame, state: DataFrame, mode: str = "label") -> DataFrame:
    """Restore labels from state.

    mode "label": hits get defaults ['other'], [], '', [], 0.5 for missing
    fields; mode "stats": [] and 0. Rows without a state row keep empty
    labels and score 0."""
    cat_default = F.array(F.lit("other")) if mode == "label" else _empty()
    score_default = F.lit(0.5) if mode == "label" else F.lit(0.0)
    s = state.select(
        "conv_id", F.lit(True).alias("_hit"),
        F.col("categories").alias("_cats"), F.col("tags").alias("_tags"), F.col("summary").alias("_summary"),
        F.col("key_facts").alias("_facts"), F.col("relevance_score").alias("_score"))
    j = headers.join(s, "conv_id", "left")
    hit = F.col("_hit").isNotNull()
    return j.select(
        *[c for c in headers.columns],
        F.when(hit, F.coalesce("_cats", cat_default)).otherwise(_empty()).alias("categories"),
        F.when(hit, F.coalesce("_tags", _empty())).otherwise(_empty()).alias("tags"),
        F.when(hit, F.coalesce("_summary", F.lit(""))).otherwise(F.lit("")).alias("summary"),
        F.when(hit, F.coalesce("_facts", _empty())).otherwise(_empty()).alias("key_facts"),
        F.when(hit, F.coalesce(F.col("_score").cast("double"), score_default)).otherwise(F.lit(0.0)).alias("relevance_score"),
    )


def labelled(df: DataFrame) -> DataFrame:
    """Conversations with at least one category."""
    return df.where(F.size("categories") > 0)


def in_category(df: DataFrame, slug: str) -> DataFrame:
    """P5."""
    return df.where(F.array_contains("categories", slug))


def min_relevance(df: DataFrame, x: float) -> DataFrame:
    """P7 (inclusive)."""
    return df.where(F.col("relevance_score") >= x)


def id_frame(spark: SparkSession, values: list[str], key_type: str = "string") -> DataFrame:
    """P8 input: a repeatable, comma-separated option -> (ord, conv_id) rows,
    trimmed, blanks dropped, request order kept."""
    raw = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "opt_ord int, opt string")
    ex = raw.select("opt_ord", F.posexplode(F.split("opt", ",")).alias("part_ord", "part"))
    ids = ex.select("opt_ord", "part_ord", php_trim("part").alias("conv_id")).where(F.col("conv_id") != "")
    # The request order is a struct: no bound on the ids of one option.
    return ids.select(F.struct("opt_ord", "part_ord").alias("ord"), F.col("conv_id").cast(key_type).alias("conv_id"))


def by_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Semi-join on the requested ids."""
    return df.join(ids.select("conv_id"), "conv_id", "left_semi")


def by_id(df: DataFrame, conv_id) -> DataFrame:
    """Point lookup; the caller treats an empty result as not found."""
    return df.where(F.col("conv_id") == F.lit(conv_id))


def pick_category(cats: DataFrame, slug: str) -> DataFrame:
    """P10."""
    return cats.where(F.col("slug") == slug)


def lookup_ordered(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows in requested order, repeats kept; ``found`` is false for
    ids with no row."""
    j = ids.join(df.withColumn("_found", F.lit(True)), "conv_id", "left")
    return j.withColumn("found", F.col("_found").isNotNull()).drop("_found").orderBy("ord")


def by_category(df: DataFrame, cats: DataFrame) -> DataFrame:
    """Conversation x configured category (many-to-many); the planner
    broadcasts the category table while its bytes allow."""
    ex = df.select("*", F.explode("categories").alias("slug"))
    return ex.join(cats.select("slug", F.col("name").alias("category_name")), "slug")


def with_enhanced(df: DataFrame, enhanced: DataFrame) -> DataFrame:
    """Enhanced summary / facts when non-empty, else the base ones."""
    e = enhanced.select(
        "conv_id", F.col("enhanced_summary").alias("_es"), F.col("enhanced_key_facts").alias("_ef"),
        "message_summaries", "detailed_summaries", F.lit(True).alias("has_enhanced"))
    j = df.join(e, "conv_id", "left")
    return j.withColumn("digest_summary", F.coalesce(F.nullif(F.col("_es"), F.lit("")), F.col("summary"))) \
        .withColumn("digest_facts", F.when(F.size(F.coalesce("_ef", _empty())) > 0, F.col("_ef")).otherwise(F.col("key_facts"))) \
        .withColumn("has_enhanced", F.coalesce("has_enhanced", F.lit(False))) \
        .drop("_es", "_ef")


def stub_conversations(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headers and one synthetic assistant message per state row, made
    of summary, key facts and tags, or '(no summary available)'."""
    facts = F.when(F.size("key_facts") > 0, F.concat(
        F.lit(STUB_FACTS + "\n"),
        F.array_join(F.transform("key_facts", lambda f: F.concat(F.lit("- "), f, F.lit("\n"))), ""),
        F.lit("\n"))).otherwise(F.lit(""))
    summary = F.when(F.col("summary") != "", F.concat(F.lit(STUB_SUMMARY), F.col("summary"), F.lit("\n\n"))).otherwise(F.lit(""))
    tags = F.when(F.size("tags") > 0, F.concat(F.lit(STUB_TAGS), F.array_join("tags", ", "), F.lit("\n"))).otherwise(F.lit(""))
    text = F.concat(summary, facts, tags)
    to_epoch = lambda c: F.unix_timestamp(F.col(c), "yyyy-MM-dd HH:mm").cast("double")
    headers = state.select(
        "conv_id", F.coalesce("title", F.col("conv_id").cast("string")).alias("title"),
        to_epoch("created").alias("create_time"), to_epoch("updated").alias("update_time"),
        F.lit(1).cast("bigint").alias("message_count"), F.lit(0).cast("bigint").alias("user_messages"),
        "categories", "tags", "summary", "key_facts", F.coalesce(F.col("relevance_score").cast("double"), F.lit(0.5)).alias("relevance_score"))
    msgs = state.select(
        "conv_id", F.lit(0).cast("bigint").alias("pos"), F.lit("assistant").alias("role"),
        F.when(text != "", text).otherwise(F.lit(NO_SUMMARY_AVAILABLE)).alias("content"),
        F.lit(0.0).alias("ts"))
    return headers, msgs


def index_rows(headers: DataFrame) -> DataFrame:
    """Parsed-index projection."""
    return headers.select(
        F.col("conv_id").cast("string").alias("id"), "title",
        fmt_time("create_time").alias("created"), fmt_time("update_time").alias("updated"),
        F.col("message_count").alias("messages"), "user_messages")


def state_rows(df: DataFrame) -> DataFrame:
    """State-row projection (conversation header + labels)."""
    return df.select(
        "conv_id", "title", fmt_time("create_time").alias("created"), fmt_time("update_time").alias("updated"),
        "message_count", "user_messages", "categories", "tags", "summary", "key_facts", "relevance_score")

