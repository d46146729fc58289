"""Topic discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import fmt_time
from parlance.operators.generate import join_responses, parsed_json
from parlance.operators.sample import chunked, stratified_sample

from parlance.functions.formats import EXPLORE_BATCH, EXPLORE_CHARS, EXPLORE_SAMPLE, STOP_WORDS
from parlance.functions.prompts import EXPLORE_BODY, EXPLORE_DATE, EXPLORE_ITEM, EXPLORE_KNOWN, EXPLORE_SYSTEM, FREE_SYSTEM


def free_mode(cats: DataFrame, flag: bool = False) -> bool:
    """M5: free mode when asked for, or when no category exists (one
    bounded action on the configuration table)."""
    return flag or cats.limit(1).count() == 0


def explore_prompts(headers: DataFrame, msgs: DataFrame, cats: DataFrame, sample: int = EXPLORE_SAMPLE,
                    batch: int = EXPLORE_BATCH, max_chars: int = EXPLORE_CHARS, free: bool | None = None) -> DataFrame:
    """M3: W7 sample over newest-first order, W6 batches of ``batch`` in
    that order, each conversation condensed to ``max_chars``."""
    from parlance.operators.render import condensed_text
    sampled = stratified_sample(headers.select("conv_id", "title", "create_time"), sample)
    batches = chunked(sampled, batch, [F.col("sample_ord")], "batch")
    text = condensed_text(headers.join(sampled.select("conv_id"), "conv_id", "left_semi"),
                          msgs.join(sampled.select("conv_id"), "conv_id", "left_semi"), max_chars)
    j = batches.join(text, "conv_id")
    block = F.concat(F.lit(EXPLORE_ITEM), F.col("title"), F.lit(EXPLORE_DATE), fmt_time("create_time"), F.lit(EXPLORE_BODY), F.col("condensed"))
    g = j.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("sample_ord", block.alias("b")))).alias("_b"))
    is_free = free_mode(cats) if free is None else free
    # The prompt lists every category, so the table is as long as a prompt may be.
    known = "" if is_free else EXPLORE_KNOWN + "".join(f"{r['slug']} = {r['name']}\n" for r in cats.orderBy("cat_ord").select("slug", "name").collect()) + "\n"
    prompt = F.concat(F.lit(known),
                      F.array_join(F.transform("_b", lambda x: x["b"]), "\n\n"))
    return g.select(F.concat(F.lit("explore:"), F.col("batch").cast("string")).alias("prompt_id"), "batch",
                    F.lit(FREE_SYSTEM if is_free else EXPLORE_SYSTEM).alias("system"), prompt.alias("prompt"))


def apply_explore_responses(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """M4: suggestion rows (batch, item_pos, slug, name, description,
    sample_titles); a failed batch yields none."""
    j = join_responses(prompts.select("prompt_id", "batch"), responses)
    items = j.select(
        "batch", F.posexplode(F.coalesce(F.try_variant_get(parsed_json("response"), "$.suggestions", "array<variant>"), F.array())).alias("item_pos", "s"))
    return items.select(
        "batch", F.col("item_pos").cast("bigint").alias("item_pos"),
        F.coalesce(F.try_variant_get("s", "$.slug", "string"), F.lit("")).alias("slug"),
        F.try_variant_get("s", "$.name", "string").alias("name"),
        F.try_variant_get("s", "$.description", "string").alias("description"),
        F.coalesce(F.try_variant_get("s", "$.sample_titles", "array<string>"), F.array().cast("array<string>")).alias("sample_titles"))


def new_suggestions(sugg: DataFrame, cats: DataFrame, free: bool = False) -> DataFrame:
    """Non-empty slug, not already a category unless free mode."""
    s = sugg.where(F.col("slug") != "")
    return s if free else s.join(cats.select("slug"), "slug", "left_anti")


def merge_suggestions(seed: DataFrame, new: DataFrame) -> DataFrame:
    """Per slug: count (seed count + one per new suggestion), first name
    (default slug), longest description (earliest wins ties), titles as an
    ordered distinct union. Seed rows come first in the order."""
    s = seed.select("slug", "name", "description", "sample_titles", F.col("count").cast("bigint").alias("n"),
                    F.struct(F.lit(0).alias("src"), F.lit(0).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("p")).alias("ord"))
    n = new.select("slug", "name", "description", "sample_titles", F.lit(1).cast("bigint").alias("n"),
                   F.struct(F.lit(1).alias("src"), F.col("batch").cast("bigint").alias("b"), F.col("item_pos").cast("bigint").alias("p")).alias("ord"))
    u = s.unionByName(n).withColumn("_desc", F.coalesce("description", F.lit("")))
    g = u.groupBy("slug").agg(
        F.sum("n").alias("count"),
        F.min_by(F.coalesce("name", "slug"), "ord").alias("name"),
        F.max_by("_desc", F.struct(F.length("_desc").alias("l"), F.struct((-F.col("ord.src")).alias("s"), (-F.col("ord.b")).alias("b"), (-F.col("ord.p")).alias("p")).alias("o"))).alias("description"))
    # Titles: the first place of every (slug, title), pre-aggregated, so a
    # slug with most suggestions brings its distinct titles together alone.
    each = u.select("slug", "ord", F.posexplode("sample_titles").alias("at", "title"))
    firsts = each.groupBy("slug", "title").agg(F.min(F.struct("ord", "at")).alias("first"))
    titles = firsts.groupBy("slug").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "title"))), lambda x: x["title"]).alias("sample_titles"))
    return g.join(titles, "slug", "left").select(
        "slug", "name", "description", F.coalesce("sample_titles", F.array().cast("array<string>")).alias("sample_titles"), "count")


def keywords_for(name, slug) -> F.Column:
    """name words (split on whitespace, '-', '_'; stop words out;
    longer than 2) then slug words (split on '-', longer than 2), distinct."""
    words = F.split(F.lower(F.coalesce(name, F.lit(""))), r"[\s\-_]+")
    name_words = F.filter(words, lambda w: (~w.isin(STOP_WORDS)) & (F.length(w) > 2))
    slug_words = F.filter(F.split(F.coalesce(slug, F.lit("")), "-"), lambda w: F.length(w) > 2)
    return F.array_distinct(F.concat(name_words, slug_words))


def discovery_top(merged: DataFrame) -> DataFrame:
    """O4 + O6: count-desc with the first three sample titles."""
    return merged.select("slug", "name", "count", F.slice("sample_titles", 1, 3).alias("head_titles")) \
        .orderBy(F.col("count").desc(), "slug")


def apply_discovery(cats: DataFrame, merged: DataFrame, decisions: DataFrame) -> DataFrame:
    """``decisions(slug, seq, action, target, keywords)``. ``add`` makes
    a category (keywords default to F15); ``merge`` appends F15 keywords of
    the suggestion to the target, which must be an existing or added slug
    (else nothing); anything else is skipped."""
    from parlance.operators.setops import upsert, union_distinct
    d = decisions.join(merged, "slug")
    kw = keywords_for(F.col("name"), F.col("slug"))
    adds = d.where(F.col("action") == "add").select(
        "slug", "name", F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("keywords", kw).alias("keywords"), "seq")
    # The order is a struct (origin, position): existing rows first, then additions.
    base = cats.select("slug", "name", "description", "keywords", F.struct(F.lit(0).alias("origin"), F.col("cat_ord").cast("bigint").alias("at")).alias("seq"))
    with_adds = upsert(base, adds.withColumn("seq", F.struct(F.lit(1).alias("origin"), F.col("seq").cast("bigint").alias("at"))), "slug")
    merges = d.where(F.col("action") == "merge").select(F.col("target").alias("slug"), "seq", kw.alias("_kw"))
    extra = merges.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("seq", "_kw"))).alias("_k")) \
        .select("slug", F.flatten(F.transform("_k", lambda x: x["_kw"])).alias("_extra"))
    out = with_adds.join(extra, "slug", "left")
    return out.select("slug", "name", "description",
                      F.when(F.col("_extra").isNull(), F.col("keywords")).otherwise(union_distinct(F.col("keywords"), F.col("_extra"))).alias("keywords"),
                      "seq")
