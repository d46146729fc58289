"""Three-pass deep summarisation as table jobs.

Pass n's prompts are built from pass n-1's parsed responses for every
conversation at once; each pass is a join on ``conv_id``. Prompt texts are
assembled with ordered collects bounded by one conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.formats import EXCHANGES, EXPANSION_FAILED
from parlance.functions import prompts as W
from parlance.functions.text import php_trim, range_label
from parlance.operators.generate import cleaned_text, join_responses, parsed_json
from parlance.plans.materialize import materialize
from parlance.operators.pairs import PAIR_BATCH, attach_one_liners, pair_chunks, range_key, range_slices, valid_ranges

def _empty():
    return F.array().cast("array<string>")


def _ordered(arr_col, field: str, sep: str = ""):
    return F.array_join(F.transform(F.array_sort(arr_col), lambda x: x[field]), sep)


def pair_prompts(pairs: DataFrame, n: int = PAIR_BATCH) -> DataFrame:
    """M6: one prompt per (conversation, chunk of n pairs), full text."""
    block = F.concat(F.lit(W.PAIR_ITEM), F.col("pair_index").cast("string"), F.lit(W.PAIR_ASKED), F.col("user"),
                     F.lit(W.PAIR_ANSWERED), F.col("assistant"), F.lit(W.PAIR_END))
    g = pair_chunks(pairs, n).groupBy("conv_id", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("pair_index", block.alias("block")))).alias("_b"))
    indices = F.transform("_b", lambda x: x["pair_index"])
    prompt = F.concat(
        F.lit(W.PAIR_LIST), F.array_join(indices, ", "), F.lit(W.PAIR_LIST_END),
        F.array_join(F.transform("_b", lambda x: x["block"]), ""))
    return g.select(
        F.concat(F.lit("pairs:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("chunk").cast("string")).alias("prompt_id"),
        "conv_id", "chunk", indices.alias("pair_indices"), F.lit(W.PAIR_SYSTEM).alias("system"), prompt.alias("prompt"))


def apply_pair_responses(pairs: DataFrame, prompts: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M7: (message_summaries per conversation, failed conversations).

    Any chunk that fails to parse fails its whole conversation."""
    j = join_responses(prompts.select("prompt_id", "conv_id", "chunk"), responses)
    j = j.withColumn("_obj", parsed_json("response"))
    chunk_failed = F.col("_obj").isNull()
    failed = j.groupBy("conv_id").agg(F.bool_or(chunk_failed).alias("_f")).where("_f").select("conv_id")
    # a failed chunk has a NULL object, so its list is empty: no filter on
    # the parsed column (which Catalyst would push down and evaluate twice)
    items = j.select(
        "conv_id", "chunk",
        F.posexplode(F.coalesce(F.try_variant_get("_obj", "$.summaries", "array<variant>"), F.array())).alias("item_pos", "item"))
    summaries = items.select(
        "conv_id", "chunk",
        F.coalesce(F.try_variant_get("item", "$.pair_index", "bigint"), F.lit(-1)).alias("pair_index"),
        F.coalesce(F.try_variant_get("item", "$.one_liner", "string"), F.lit("")).alias("one_liner"),
        F.col("item_pos").alias("item_ord"))
    ok_pairs = pairs.join(failed, "conv_id", "left_anti")
    attached = attach_one_liners(ok_pairs, summaries)
    per_conv = attached.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("pair_index", "user_snippet", "assistant_snippet", "one_liner"))).alias("message_summaries"))
    return per_conv, failed


def flag_prompts(summaries: DataFrame, headers: DataFrame) -> DataFrame:
    """M8: indexed one-liner digest per conversation (none without pairs)."""
    digest = F.array_join(F.transform("message_summaries", lambda s: F.concat(
        s["pair_index"].cast("string"), F.lit(W.FLAG_SEP), s["one_liner"], F.lit("\n"))), "")
    j = summaries.where(F.size("message_summaries") > 0).join(headers.select("conv_id", "title"), "conv_id")
    prompt = F.concat(F.lit(W.FLAG_TITLE), F.col("title"), F.lit(W.FLAG_TITLE_END), digest)
    return j.select(F.concat(F.lit("flag:"), F.col("conv_id").cast("string")).alias("prompt_id"), "conv_id",
                    F.lit(W.FLAG_SYSTEM).alias("system"), prompt.alias("prompt"))


def apply_flag_responses(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """M9 + P16: ranges(conv_id, range_ord, start, end); a failed response
    gives no ranges; entries whose start/end are not integers are dropped."""
    j = join_responses(prompts.select("prompt_id", "conv_id"), responses)
    items = j.select(
        "conv_id", F.posexplode(F.coalesce(F.try_variant_get(parsed_json("response"), "$.flagged", "array<variant>"), F.array())).alias("range_ord", "flag"))
    return valid_ranges(items.withColumn("range_ord", F.col("range_ord").cast("bigint")))


def expand_prompts(ranges: DataFrame, pairs: DataFrame, headers: DataFrame) -> DataFrame:
    """One prompt per range with its exchanges (J4); a range that
    covers no pair gets none."""
    sl = range_slices(ranges, pairs)
    block = F.concat(F.lit(W.EXPAND_ASKED), F.col("user"), F.lit(W.EXPAND_ANSWERED), F.col("assistant"), F.lit(W.EXPAND_SEP))
    g = sl.groupBy("conv_id", "range_ord", "start", "end").agg(
        F.array_sort(F.collect_list(F.struct("pair_index", block.alias("block")))).alias("_b"))
    j = g.join(headers.select("conv_id", "title"), "conv_id")
    prompt = F.concat(F.lit(W.EXPAND_TITLE), F.col("title"), F.lit(W.EXPAND_FROM), range_key(), F.lit(W.EXPAND_END), _ordered("_b", "block"))
    return j.select(
        F.concat(F.lit("expand:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("range_ord").cast("string")).alias("prompt_id"),
        "conv_id", "range_ord", range_key().alias("range_key"), F.lit(W.EXPAND_SYSTEM).alias("system"), prompt.alias("prompt"))


def apply_expand_responses(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """detailed_summaries map "s-e" -> text per conversation; a failed
    response gets a fixed placeholder; a repeated key keeps its first
    position and takes the last text."""
    j = join_responses(prompts.select("prompt_id", "conv_id", "range_ord", "range_key"), responses)
    text = F.when(F.col("error").isNull() & F.col("response").isNotNull(), cleaned_text("response")).otherwise(F.lit(EXPANSION_FAILED))
    per_key = j.withColumn("_t", text).groupBy("conv_id", "range_key").agg(
        F.min("range_ord").alias("_first"), F.max_by("_t", "range_ord").alias("_text"))
    return per_key.groupBy("conv_id").agg(
        F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("_first", "range_key", "_text"))),
                                       lambda x: F.struct(x["range_key"], x["_text"]))).alias("detailed_summaries"))


def php_json_list(arr):
    """json_encode of a string list (slashes escaped, unicode kept)."""
    return F.regexp_replace(F.to_json(arr), "/", "\\\\/")


def proposal_prompts(labelled: DataFrame, detailed: DataFrame) -> DataFrame:
    """Current labels + expansions; none without expansions."""
    blocks = F.array_join(F.transform(F.map_entries("detailed_summaries"), lambda e: F.concat(
        e["key"], F.lit(W.NOTE_SEP), e["value"], F.lit(W.NOTE_END))), "")
    j = detailed.where(F.size("detailed_summaries") > 0).join(
        labelled.select("conv_id", "title", "summary", "key_facts", "tags"), "conv_id")
    prompt = F.concat(
        F.lit(W.ENTRY_TITLE), F.col("title"), F.lit(W.ENTRY_SUMMARY), F.col("summary"),
        F.lit(W.ENTRY_FACTS), php_json_list("key_facts"), F.lit(W.ENTRY_TAGS), php_json_list("tags"), F.lit(W.ENTRY_NOTES), blocks)
    return j.select(F.concat(F.lit("propose:"), F.col("conv_id").cast("string")).alias("prompt_id"), "conv_id",
                    F.lit(W.PROPOSAL_SYSTEM).alias("system"), prompt.alias("prompt"))


def proposal_diff(labelled: DataFrame, prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """Per field struct(old, new) when the proposal is non-empty and
    differs from the current value; NULL otherwise. A failed response, or
    a proposal with no change, gives no row."""
    # Bind the parsed object once (lambda) and read the three fields from it.
    j = join_responses(prompts.select("prompt_id", "conv_id"), responses)
    proposal = F.transform(F.array(parsed_json("response")), lambda o: F.struct(
        o.isNotNull().alias("ok"),
        php_trim(F.coalesce(F.try_variant_get(o, "$.summary", "string"), F.lit(""))).alias("summary"),
        F.coalesce(F.try_variant_get(o, "$.key_facts", "array<string>"), _empty()).alias("key_facts"),
        F.coalesce(F.try_variant_get(o, "$.tags", "array<string>"), _empty()).alias("tags")))[0]
    j = j.select("conv_id", proposal.alias("_p")).where("_p.ok") \
        .join(labelled.select("conv_id", "summary", "key_facts", "tags"), "conv_id")
    new_summary, new_facts, new_tags = F.col("_p.summary"), F.col("_p.key_facts"), F.col("_p.tags")
    d = j.select(
        "conv_id",
        F.when((new_summary != "") & (new_summary != F.col("summary")),
               F.struct(F.col("summary").alias("old"), new_summary.alias("new"))).alias("summary_diff"),
        F.when((F.size(new_facts) > 0) & (new_facts != F.col("key_facts")),
               F.struct(F.col("key_facts").alias("old"), new_facts.alias("new"))).alias("key_facts_diff"),
        F.when((F.size(new_tags) > 0) & (new_tags != F.col("tags")),
               F.struct(F.col("tags").alias("old"), new_tags.alias("new"))).alias("tags_diff"),
    )
    return d.where(F.col("summary_diff").isNotNull() | F.col("key_facts_diff").isNotNull() | F.col("tags_diff").isNotNull())


def apply_proposals(state: DataFrame, enhanced: DataFrame, diffs: DataFrame, acceptances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C4: accepted group A (summary + key facts) and group B (tags) update
    both the state and the enhanced rows; both upserts are kept (the
    reference's second store overwrote the first, see README)."""
    a = diffs.join(acceptances, "conv_id")
    take_a = F.coalesce(F.col("accept_a"), F.lit(False)) & (F.col("summary_diff").isNotNull() | F.col("key_facts_diff").isNotNull())
    take_b = F.coalesce(F.col("accept_b"), F.lit(False)) & F.col("tags_diff").isNotNull()
    upd = a.where(take_a | take_b).select(
        "conv_id",
        F.when(take_a & F.col("summary_diff").isNotNull(), F.col("summary_diff.new")).alias("_summary"),
        F.when(take_a & F.col("key_facts_diff").isNotNull(), F.col("key_facts_diff.new")).alias("_facts"),
        F.when(take_b, F.col("tags_diff.new")).alias("_tags"))
    # One keyed left join per table: rows without an accepted change stay as they are.
    upd = materialize(upd, "accepted-proposals")
    st = state.join(upd, "conv_id", "left").select(
        *[F.coalesce(F.col("_summary"), F.col("summary")).alias("summary") if c == "summary"
          else F.coalesce(F.col("_facts"), F.col("key_facts")).alias("key_facts") if c == "key_facts"
          else F.coalesce(F.col("_tags"), F.col("tags")).alias("tags") if c == "tags"
          else F.col(c) for c in state.columns])
    en = enhanced.join(upd, "conv_id", "left").select(
        *[F.coalesce(F.col("_summary"), F.col("enhanced_summary")).alias("enhanced_summary") if c == "enhanced_summary"
          else F.coalesce(F.col("_facts"), F.col("enhanced_key_facts")).alias("enhanced_key_facts") if c == "enhanced_key_facts"
          else F.coalesce(F.col("_tags"), F.col("proposed_tags")).alias("proposed_tags") if c == "proposed_tags"
          else F.col(c) for c in enhanced.columns])
    return st, en


def enhance_worklist(labelled: DataFrame, cats: DataFrame, enhanced: DataFrame, reset: bool = False) -> DataFrame:
    """Distinct conversations in any configured category, minus the
    already enhanced ones (unless reset): each is enhanced once and shared
    by all its categories."""
    from parlance.operators.select import by_category
    members = by_category(labelled, cats).select("conv_id").distinct()
    if reset:
        return members
    return members.join(enhanced.select("conv_id"), "conv_id", "left_anti")


def enhanced_records(labelled: DataFrame, summaries: DataFrame, ranges: DataFrame, detailed: DataFrame,
                     enhanced_at: str) -> DataFrame:
    """Assemble enhanced rows (state shape of FIXTURES 1.3) for conversations
    whose pass 1 succeeded."""
    rng = ranges.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("range_ord", "start", "end"))).alias("_r"))
    j = summaries.join(labelled.select("conv_id", "summary", "key_facts", "tags"), "conv_id") \
        .join(rng, "conv_id", "left").join(detailed, "conv_id", "left")
    return j.select(
        "conv_id", "message_summaries",
        F.coalesce(F.transform("_r", lambda r: F.array(r["start"], r["end"])), F.array().cast("array<array<bigint>>")).alias("flagged_ranges"),
        F.coalesce("detailed_summaries", F.create_map().cast("map<string,string>")).alias("detailed_summaries"),
        F.col("summary").alias("enhanced_summary"), F.col("key_facts").alias("enhanced_key_facts"),
        F.col("tags").alias("proposed_tags"), F.lit(enhanced_at).alias("enhanced_at"))


def range_heading(key):
    """display heading for a "s-e" key."""
    return F.concat(F.lit(EXCHANGES), range_label(key))
