"""Corrections re-aimed as tables: review queue (C1, W8) and review edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import clamp01
from parlance.operators import select as Sel
from parlance.operators.label import keep_valid
from parlance.plans.ranks import with_global_rank


def review_queue(labelled: DataFrame, slug: str | None = None, ids: DataFrame | None = None,
                 min_rel: float = 0.0) -> DataFrame:
    """C1 + W8: filter, relevance order, ``position`` of ``total``."""
    q = labelled
    if slug is not None:
        q = Sel.in_category(q, slug)
    if ids is not None:
        q = Sel.by_ids(q, ids)
    q = Sel.min_relevance(q, min_rel)
    ranked = with_global_rank(q, Sel.relevance_order(), "position")
    total = ranked.count()
    return ranked.withColumn("total", F.lit(total).cast("bigint"))


def apply_review_edits(state: DataFrame, edits: DataFrame, cats: DataFrame) -> DataFrame:
    """``edits(conv_id, seq, action, categories, relevance)``, one row per conversation and seq.

    recategorise: valid slugs (configured + 'other'), distinct, order kept;
    none valid -> edit ignored. relevance: clamped to [0, 1]. delete:
    relevance 0. Several edits per conversation: the last one per field
    wins; each touched conversation is written once (U1)."""
    from parlance.operators.setops import upsert
    checked = keep_valid(edits, cats, ["conv_id", "seq"], always=("other",))
    e = checked.select(
        "conv_id", "seq",
        F.when((F.col("action") == "recategorise") & (F.size("categories") > 0), F.col("categories")).alias("_cats"),
        F.when(F.col("action") == "relevance", clamp01("relevance", 0.0))
        .when(F.col("action") == "delete", F.lit(0.0)).alias("_rel"))
    per = e.groupBy("conv_id").agg(
        F.max_by("_cats", F.when(F.col("_cats").isNotNull(), F.col("seq"))).alias("_cats"),
        F.max_by("_rel", F.when(F.col("_rel").isNotNull(), F.col("seq"))).alias("_rel"))
    per = per.where(F.col("_cats").isNotNull() | F.col("_rel").isNotNull())
    changed = state.join(per, "conv_id").select(
        *[F.coalesce("_cats", "categories").alias("categories") if c == "categories"
          else F.coalesce("_rel", "relevance_score").alias("relevance_score") if c == "relevance_score"
          else F.col(c) for c in state.columns])
    return upsert(state, changed)
