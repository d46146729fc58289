"""Registered queries: one callable per operator group of the inventory.

Each takes ``(spark, sf_dir)`` and returns a DataFrame over the driver's
tables at ``sf_dir``. Arrays are rendered with ``array_join(..., '|')`` so
results compare as plain strings against the DuckDB oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators import label as L
from parlance.operators import stats as S
from parlance.sources import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def joined(c, sep: str = "|"):
    return F.array_join(F.col(c) if isinstance(c, str) else c, sep)


def _base(spark, sf_dir):
    p = X.prepared(spark, sf_dir)
    return p.messages, p.headers


_STAGES: dict = {}


def _stage(spark, sf_dir, name, build):
    """A pipeline stage's stored output: built (and written under the shared
    checkpoint folder) once per session, then read by every later query,
    as the next pass of a run reads the stored tables of the previous one."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    if key not in _STAGES:
        _STAGES[key] = build()
    return _STAGES[key]


@register
def keyword_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: P1/P2 -> A1 -> P4 -> W3 -> J7 -> A5."""
    msgs, hdrs = _base(spark, sf_dir)
    pool = S.min_messages(hdrs, 4)
    labels = L.keyword_label(pool, msgs, X.categories(spark))
    return S.category_breakdown(labels)


# ---------------------------------------------------------------- shared inputs
def _pool(spark, sf_dir):
    msgs, hdrs = _base(spark, sf_dir)
    return msgs, hdrs, S.min_messages(hdrs, 4)


def _state(spark, sf_dir, msgs=None, hdrs=None):
    return X.prepared(spark, sf_dir).state


def _labelled(spark, sf_dir):
    """Hydrated (label defaults) and labelled pool, min_messages = 4."""
    msgs, hdrs, pool = _pool(spark, sf_dir)
    st = _state(spark, sf_dir, msgs, hdrs)
    return msgs, hdrs, st, Sel.labelled(Sel.hydrate(pool, st, "label"))


from parlance.operators import select as Sel  # noqa: E402
from parlance.operators import setops as U  # noqa: E402
from parlance.plans.ranks import with_global_rank  # noqa: E402
from parlance.functions import text as Tx  # noqa: E402


def _arr_out(df, cols):
    return df.select(*[joined(c).alias(c) if c in cols else c for c in df.columns])


# ---------------------------------------------------------------- A1-A8, O, U, J
@register
def message_counts(spark, sf_dir):
    """P1, P2, A1, P3, P4."""
    return S.message_counts(_base(spark, sf_dir)[0].select("conv_id", "role"), min_messages=2) \
        .where("message_count >= 4")


@register
def parse_summary(spark, sf_dir):
    """A2, O7."""
    return S.parse_summary(_base(spark, sf_dir)[1], 4)


@register
def newest_n(spark, sf_dir):
    """--limit 10 in newest-first order."""
    _, _, pool = _pool(spark, sf_dir)
    return Sel.first_n(pool, 10).select("conv_id", "title", Tx.fmt_time("create_time").alias("created"))


@register
def first_user_messages(spark, sf_dir):
    """W3."""
    return L.first_user_messages(_base(spark, sf_dir)[0])


@register
def keyword_label(spark, sf_dir):
    """J7, F5, F6 over every conversation."""
    msgs, hdrs = _base(spark, sf_dir)
    return _arr_out(L.keyword_label(hdrs, msgs, X.categories(spark)), ["categories"])


@register
def label_counts(spark, sf_dir):
    """A8 over the hydrated, labelled pool."""
    return S.label_counts(_labelled(spark, sf_dir)[3])


@register
def state_hydrate(spark, sf_dir):
    """J1 with label defaults, every pool row (unlabelled keep empties)."""
    msgs, hdrs, pool = _pool(spark, sf_dir)
    h = Sel.hydrate(pool, _state(spark, sf_dir, msgs, hdrs), "label")
    return _arr_out(h.select("conv_id", "categories", "tags", "summary", "key_facts", "relevance_score"),
                    ["categories", "tags", "key_facts"])


@register
def resume_worklist(spark, sf_dir):
    """P13 + J2: pool rows still to label when a model is used."""
    msgs, hdrs, pool = _pool(spark, sf_dir)
    return L.worklist(pool, L.model_done(_state(spark, sf_dir, msgs, hdrs))).select("conv_id", "title")


@register
def cached_list(spark, sf_dir):
    """P13/P14 + J2: cached rows with model (done) and without (any state)."""
    msgs, hdrs, pool = _pool(spark, sf_dir)
    st = _state(spark, sf_dir, msgs, hdrs)
    with_model = L.cached(pool, L.model_done(st)).select("conv_id", F.lit("model").alias("mode"))
    keywords = L.cached(pool, st).select("conv_id", F.lit("keywords").alias("mode"))
    return with_model.unionByName(keywords)


@register
def filter_pool(spark, sf_dir):
    """One category, relevance >= 0.3, relevance order."""
    _, _, _, lab = _labelled(spark, sf_dir)
    pool = Sel.min_relevance(Sel.in_category(lab, "english"), 0.3)
    return with_global_rank(pool, Sel.relevance_order(), "position").select("conv_id", "relevance_score", "position")


ID_OPTIONS = ["5, 3", " 12 ", ",", "5", "99999999"]


@register
def by_ids(spark, sf_dir):
    """Repeatable comma-separated id option, semi-join."""
    _, _, _, lab = _labelled(spark, sf_dir)
    ids = Sel.id_frame(spark, ID_OPTIONS, "bigint")
    return Sel.by_ids(lab, ids).select("conv_id", "relevance_score")


@register
def ordered_lookup(spark, sf_dir):
    """Request order, repeats kept, missing reported."""
    _, hdrs = _base(spark, sf_dir)
    ids = Sel.id_frame(spark, ID_OPTIONS, "bigint")
    return Sel.lookup_ordered(hdrs.select("conv_id", "title"), ids).select("ord.opt_ord", "ord.part_ord", "conv_id", "title", "found")


@register
def missing_ids(spark, sf_dir):
    """Requested ids with no conversation."""
    return ordered_lookup(spark, sf_dir).where(~F.col("found")).select("opt_ord", "part_ord", "conv_id")


@register
def corpus_stats(spark, sf_dir):
    """A4."""
    msgs, hdrs = _base(spark, sf_dir)
    return S.corpus_stats(hdrs, _state(spark, sf_dir, msgs, hdrs), 4)


def _stats_pool(spark, sf_dir):
    msgs, hdrs, pool = _pool(spark, sf_dir)
    return Sel.hydrate(pool, _state(spark, sf_dir, msgs, hdrs), "stats")


@register
def category_breakdown(spark, sf_dir):
    """A5 with stats defaults."""
    return S.category_breakdown(_stats_pool(spark, sf_dir))


@register
def relevance_histogram(spark, sf_dir):
    """A6."""
    return S.relevance_histogram(_stats_pool(spark, sf_dir))


@register
def category_index(spark, sf_dir):
    """A7 per configured category."""
    return S.category_index(_labelled(spark, sf_dir)[3], X.categories(spark))


@register
def exported_total(spark, sf_dir):
    """A7 distinct total over exported slugs."""
    return S.exported_total(_labelled(spark, sf_dir)[3], X.categories(spark))


def _old_index(hdrs):
    """A previous index run: every conversation with 2-6 messages, older titles."""
    old = Sel.index_rows(hdrs.where("message_count <= 6"))
    return old.withColumn("title", F.concat(F.lit("Old "), F.col("title")))


@register
def index_upsert(spark, sf_dir):
    """U1 + O3 + K1: new index rows win per id, other rows kept."""
    _, hdrs, pool = _pool(spark, sf_dir)
    merged = U.upsert(_old_index(hdrs), Sel.index_rows(pool), "id")
    return merged


@register
def index_delta(spark, sf_dir):
    """J10 + A3: added / updated / total of a merge."""
    _, hdrs, pool = _pool(spark, sf_dir)
    return U.merge_counts(Sel.index_rows(pool), _old_index(hdrs), "id")


@register
def point_lookup(spark, sf_dir):
    """P9."""
    _, hdrs = _base(spark, sf_dir)
    return Sel.by_id(hdrs, 1).select("conv_id", "title", "message_count")


@register
def pick_category(spark, sf_dir):
    """P10 + J6: members of one picked category."""
    _, _, _, lab = _labelled(spark, sf_dir)
    picked = Sel.pick_category(X.categories(spark), "german")
    return Sel.by_category(lab, picked).select("conv_id", "slug", "category_name")


@register
def index_rows(spark, sf_dir):
    """P17, O3, F4."""
    _, _, pool = _pool(spark, sf_dir)
    return Sel.index_rows(pool).orderBy(F.col("created").desc(), "id")


@register
def membership_rows(spark, sf_dir):
    """J6."""
    _, _, _, lab = _labelled(spark, sf_dir)
    return Sel.by_category(lab, X.categories(spark)).select("conv_id", "slug", "category_name")


@register
def rounding_clamp(spark, sf_dir):
    """F9, F11 over per-conversation values."""
    _, hdrs = _base(spark, sf_dir)
    raw = (F.col("conv_id") % 13) / F.lit(8.0) - F.lit(0.5)
    return hdrs.select(
        "conv_id",
        Tx.clamp01(raw).alias("clamped"),
        Tx.clamp01(F.when(F.col("conv_id") % 3 == 0, F.lit(None)).otherwise(raw)).alias("clamped_default"),
        Tx.round_half_up(F.col("message_count") / F.lit(8.0), 0).alias("r0"),
        Tx.round_half_up(F.col("message_count") / F.lit(8.0), 2).alias("r2"),
        Tx.round_half_up(F.col("conv_id") / F.lit(16.0), 3).alias("r3"),
    )


@register
def array_merge_ops(spark, sf_dir):
    """U3, U4, U5, F16 over state arrays."""
    st = _state(spark, sf_dir)
    return st.select(
        "conv_id",
        joined(U.union_distinct(F.col("categories"), F.col("tags"))).alias("merged"),
        joined(U.distinct_values(F.concat("categories", "categories"))).alias("distinct_cats"),
        Tx.comma_list("tags").alias("tag_list"),
    )


@register
def stratified_sample(spark, sf_dir):
    """s = 10 evenly spaced conversations in newest-first order."""
    from parlance.operators.sample import stratified_sample as sample
    _, _, pool = _pool(spark, sf_dir)
    return sample(pool, 10).select("conv_id", "sample_ord")


@register
def review_queue(spark, sf_dir):
    """Labelled pool, relevance >= 0, numbered i/total."""
    from parlance.operators.review import review_queue as rq
    _, _, _, lab = _labelled(spark, sf_dir)
    return rq(lab, min_rel=0.0).select("conv_id", "position", "total", "relevance_score")


# ---------------------------------------------------------------- pairs and enhance
from parlance.operators import enhance as E  # noqa: E402
from parlance.operators import pairs as P  # noqa: E402
from parlance.plans.materialize import materialize  # noqa: E402


def _enhance_inputs(spark, sf_dir):
    msgs, hdrs, st, lab = _labelled(spark, sf_dir)
    pairs = _stage(spark, sf_dir, "pairs", lambda: materialize(
        P.message_pairs(msgs.join(lab.select("conv_id"), "conv_id", "left_semi")), "pairs"))
    return msgs, hdrs, st, lab, pairs


def _pass1(spark, sf_dir):
    msgs, hdrs, st, lab, pairs = _enhance_inputs(spark, sf_dir)
    def build():
        prompts = E.pair_prompts(pairs)
        summaries, _ = E.apply_pair_responses(pairs, prompts, X.pair_responses(prompts))
        return materialize(summaries, "pass1")
    summaries = _stage(spark, sf_dir, "pass1", build)
    return hdrs, st, lab, pairs, summaries, None


def _pass2(spark, sf_dir):
    hdrs, st, lab, pairs, summaries, failed = _pass1(spark, sf_dir)
    def build():
        fp = E.flag_prompts(summaries, hdrs)
        return materialize(E.apply_flag_responses(fp, X.flag_responses(fp, hdrs)), "pass2")
    ranges = _stage(spark, sf_dir, "pass2", build)
    return hdrs, st, lab, pairs, summaries, ranges


def _pass3(spark, sf_dir):
    hdrs, st, lab, pairs, summaries, ranges = _pass2(spark, sf_dir)
    def build():
        ep = E.expand_prompts(ranges, pairs, hdrs)
        return materialize(E.apply_expand_responses(ep, X.expand_responses(ep)), "pass3")
    detailed = _stage(spark, sf_dir, "pass3", build)
    return hdrs, st, lab, pairs, summaries, ranges, detailed


def _proposals(spark, sf_dir):
    hdrs, st, lab, pairs, summaries, ranges, detailed = _pass3(spark, sf_dir)
    pp = E.proposal_prompts(lab, detailed)
    diffs = E.proposal_diff(lab, pp, X.proposal_responses(pp))
    return hdrs, st, lab, summaries, ranges, detailed, pp, diffs


@register
def message_pairs(spark, sf_dir):
    """W4, W5 over every conversation."""
    return P.message_pairs(_base(spark, sf_dir)[0])


@register
def pair_chunks(spark, sf_dir):
    """W6 per conversation (3 pairs per chunk)."""
    return P.pair_chunks(P.message_pairs(_base(spark, sf_dir)[0]).select("conv_id", "pair_index"))


@register
def pair_prompts(spark, sf_dir):
    """M6."""
    pairs = _enhance_inputs(spark, sf_dir)[4]
    return E.pair_prompts(pairs).select("prompt_id", "conv_id", "chunk", "prompt")


@register
def one_liners(spark, sf_dir):
    """Parsed pass-1 responses attached to pairs."""
    summaries = _pass1(spark, sf_dir)[4]
    return summaries.select("conv_id", F.inline("message_summaries"))


@register
def flag_prompts(spark, sf_dir):
    """M8."""
    hdrs, _, _, _, summaries, _ = _pass1(spark, sf_dir)
    return E.flag_prompts(summaries, hdrs).select("prompt_id", "conv_id", "prompt")


@register
def flag_ranges(spark, sf_dir):
    """M9, P16."""
    return _pass2(spark, sf_dir)[5]


@register
def range_slices(spark, sf_dir):
    """Interval join as sequence-explode + equi-join."""
    _, _, _, pairs, _, ranges = _pass2(spark, sf_dir)
    return P.range_slices(ranges, pairs).select("conv_id", "range_ord", "start", "end", "pair_index")


@register
def expand_prompts(spark, sf_dir):
    """M10."""
    hdrs, _, _, pairs, _, ranges = _pass2(spark, sf_dir)
    return E.expand_prompts(ranges, pairs, hdrs).select("prompt_id", "conv_id", "range_ord", "range_key", "prompt")


@register
def expansions(spark, sf_dir):
    """Detailed summaries map, in key order of first appearance."""
    detailed = _pass3(spark, sf_dir)[6]
    return detailed.select("conv_id", F.posexplode("detailed_summaries").alias("entry_pos", "range_key", "text")) \
        .withColumn("entry_pos", F.col("entry_pos").cast("bigint"))


@register
def proposal_prompts(spark, sf_dir):
    """M12."""
    return _proposals(spark, sf_dir)[6].select("prompt_id", "conv_id", "prompt")


def _diff_out(d):
    return d.select(
        "conv_id",
        F.col("summary_diff.old").alias("summary_old"), F.col("summary_diff.new").alias("summary_new"),
        joined("key_facts_diff.old").alias("key_facts_old"), joined("key_facts_diff.new").alias("key_facts_new"),
        joined("tags_diff.old").alias("tags_old"), joined("tags_diff.new").alias("tags_new"))


@register
def proposal_diff(spark, sf_dir):
    """M13."""
    return _diff_out(_proposals(spark, sf_dir)[7])


@register
def apply_proposals(spark, sf_dir):
    """C4: group A accepted for even ids, group B for ids not divisible by 3;
    both the state and the enhanced table are updated."""
    hdrs, st, lab, summaries, ranges, detailed, pp, diffs = _proposals(spark, sf_dir)
    enhanced = E.enhanced_records(lab, summaries, ranges, detailed, "2024-06-01T00:00:00+00:00")
    acc = diffs.select("conv_id", (F.col("conv_id") % 2 == 0).alias("accept_a"), (F.col("conv_id") % 3 != 0).alias("accept_b"))
    new_state, new_enh = E.apply_proposals(st, enhanced, diffs, acc)
    a = new_state.select(F.lit("state").alias("table_name"), "conv_id", "summary", joined("key_facts").alias("key_facts"), joined("tags").alias("tags"))
    b = new_enh.select(F.lit("enhanced").alias("table_name"), "conv_id", F.col("enhanced_summary").alias("summary"),
                       joined("enhanced_key_facts").alias("key_facts"), joined("proposed_tags").alias("tags"))
    return a.unionByName(b)


@register
def enhance_worklist(spark, sf_dir):
    """Conversations in any configured category not yet enhanced; the
    previous run enhanced the conversations with at most 5 messages."""
    hdrs, st, lab, pairs, summaries, ranges, detailed = _pass3(spark, sf_dir)
    enhanced = E.enhanced_records(lab, summaries, ranges, detailed, "2024-06-01T00:00:00+00:00")
    previous = enhanced.join(hdrs.where("message_count <= 5").select("conv_id"), "conv_id", "left_semi")
    return E.enhance_worklist(lab, X.categories(spark), previous).select("conv_id")


# ---------------------------------------------------------------- rendering
from parlance.operators import render as R  # noqa: E402

GENERATED_AT = "2024-06-01 00:00:00"


@register
def category_markdown(spark, sf_dir):
    """K6 blocks per configured category."""
    _, _, _, lab = _labelled(spark, sf_dir)
    return R.category_markdown_blocks(lab, X.categories(spark), GENERATED_AT)


@register
def category_json(spark, sf_dir):
    """K5 conversation rows per category (JSON compared by fields)."""
    _, _, _, lab = _labelled(spark, sf_dir)
    rows = R.category_json_rows(lab, X.categories(spark))
    return rows.select("slug", "conv_id", "id", "title", "created", "updated", "message_count", "user_messages",
                       joined("categories").alias("categories"), joined("tags").alias("tags"), "summary",
                       joined("key_facts").alias("key_facts"), "relevance_score")


@register
def context_package(spark, sf_dir):
    """K7 blocks, minimum relevance 0.3."""
    _, _, _, lab = _labelled(spark, sf_dir)
    return R.context_package_blocks(lab, X.categories(spark), 0.3, GENERATED_AT)


@register
def enhanced_package(spark, sf_dir):
    """K9 blocks over the enhanced table of this run, minimum relevance 0.3."""
    hdrs, st, lab, pairs, summaries, ranges, detailed = _pass3(spark, sf_dir)
    enhanced = E.enhanced_records(lab, summaries, ranges, detailed, "2024-06-01T00:00:00+00:00")
    return R.enhanced_package_blocks(lab, enhanced, X.categories(spark), 0.3, GENERATED_AT)


@register
def transcripts(spark, sf_dir):
    """The block rows written as one
    Markdown document per conversation (header block, then one block per
    message in order)."""
    msgs, hdrs = _base(spark, sf_dir)
    return R.transcript_blocks(hdrs, msgs).join(R.transcript_file_names(hdrs), "conv_id")


@register
def condensed_text(spark, sf_dir):
    """F2 with an 8,000-character budget."""
    msgs, hdrs = _base(spark, sf_dir)
    return R.condensed_text(hdrs, msgs, 8000)


@register
def condensed_short(spark, sf_dir):
    """F2 with the explore budget of 600 characters (head/tail cut)."""
    msgs, hdrs = _base(spark, sf_dir)
    return R.condensed_text(hdrs, msgs, 600)


@register
def snippets(spark, sf_dir):
    """F7 over every message."""
    msgs, _ = _base(spark, sf_dir)
    return msgs.select("conv_id", "pos", Tx.snippet("content").alias("snippet"))


@register
def safe_filenames(spark, sf_dir):
    """F8 over every conversation title."""
    _, hdrs = _base(spark, sf_dir)
    return hdrs.select("conv_id", Tx.safe_name("title", "conv_id").alias("file_name"))


@register
def star_bar(spark, sf_dir):
    """F10 + float display over the labelled pool."""
    _, _, _, lab = _labelled(spark, sf_dir)
    return lab.select("conv_id", Tx.num_text("relevance_score").alias("relevance"), Tx.stars("relevance_score").alias("stars"))


# ---------------------------------------------------------------- responses, labels, discovery, ask, review
from parlance.functions.json import extract_json, response_text as _response_text  # noqa: E402
from parlance.operators import ask as A  # noqa: E402
from parlance.operators import discover as D  # noqa: E402
from parlance.operators import generate as G  # noqa: E402
from parlance.operators import review as Rv  # noqa: E402


def _label_io(spark, sf_dir):
    msgs, hdrs, pool = _pool(spark, sf_dir)
    st = _state(spark, sf_dir)
    work = pool.join(st.select("conv_id"), "conv_id", "left_semi")
    prompts = L.label_prompts(work, msgs, X.categories(spark))
    return msgs, hdrs, pool, st, prompts, X.label_responses(prompts, st)


@register
def label_prompts(spark, sf_dir):
    """M1 for the resume work list (P13 + J2)."""
    msgs, hdrs, pool = _pool(spark, sf_dir)
    work = L.worklist(pool, L.model_done(_state(spark, sf_dir)))
    return L.label_prompts(work, msgs, X.categories(spark)).select("prompt_id", "conv_id", "prompt")


@register
def parse_label_responses(spark, sf_dir):
    """M2, F12-F14, P11, P12, F9."""
    _, _, _, st, prompts, responses = _label_io(spark, sf_dir)
    out = L.apply_label_responses(prompts, responses, X.categories(spark))
    return _arr_out(out, ["categories", "tags", "key_facts"])


@register
def strip_and_extract_json(spark, sf_dir):
    """the first balanced JSON object after cleanup (NULL when
    there is none or it never closes)."""
    _, _, _, _, prompts, responses = _label_io(spark, sf_dir)
    j = responses.join(prompts.select("prompt_id", "conv_id"), "prompt_id")
    return j.select("conv_id", extract_json(Tx.strip_boilerplate("response")).alias("json_text"))


@register
def response_text(spark, sf_dir):
    """F18 over raw service bodies: even ids one JSON object, odd ids two
    NDJSON lines (the text split in half)."""
    _, _, _, _, prompts, responses = _label_io(spark, sf_dir)
    j = responses.join(prompts.select("prompt_id", "conv_id"), "prompt_id")
    half = F.floor(F.length("response") / 2).cast("int")
    one = F.to_json(F.struct(F.lit("m").alias("model"), F.col("response").alias("response"), F.lit(True).alias("done")))
    first = F.to_json(F.struct(F.substring("response", 1, half).alias("response"), F.lit(False).alias("done")))
    rest = F.to_json(F.struct(F.expr("substring(response, floor(length(response) / 2) + 1)").alias("response"), F.lit(True).alias("done")))
    raw = F.when(F.col("conv_id") % 2 == 0, one).otherwise(F.concat(first, F.lit("\n"), rest, F.lit("\n")))
    read = j.select("conv_id", "response", _response_text(raw).alias("text"))
    return read.select("conv_id", "text", (F.col("response") == F.col("text")).alias("same_as_trimmed"))


def _stub_model(pdf):
    """A deterministic stand-in model used by generate_stub."""
    import pandas as pd
    out = []
    for pid in pdf["prompt_id"]:
        if int(pid.split(":")[1]) % 10 == 7:
            raise ValueError(f"boom {pid}")
        out.append(f"ok:{pid}")
    return pd.Series(out)


@register
def generate_stub(spark, sf_dir):
    """The model step through mapInPandas with per-row error capture."""
    _, _, _, _, prompts, _ = _label_io(spark, sf_dir)
    return G.generate(prompts, _stub_model)


@register
def run_counts(spark, sf_dir):
    """A10: per-status counts of a model labelling run over the pool."""
    msgs, hdrs, pool = _pool(spark, sf_dir)
    st = _state(spark, sf_dir)
    work = L.worklist(pool, L.model_done(st))
    prompts = L.label_prompts(work, msgs, X.categories(spark))
    ok = L.apply_label_responses(prompts, X.label_responses(prompts, st), X.categories(spark)).where("status = 'ok'")
    return L.run_counts(L.run_status(pool, st, ok))


@register
def concat_ordered(spark, sf_dir):
    """Message texts of a conversation in order, newline-joined, in
    bounded chunks of consecutive messages."""
    msgs, _ = _base(spark, sf_dir)
    return S.concat_ordered(msgs, "conv_id", "pos", "content", "\n")


def _explore(spark, sf_dir):
    msgs, hdrs, pool = _pool(spark, sf_dir)
    cats = X.categories(spark)

    def build():
        prompts = materialize(D.explore_prompts(pool, msgs, cats), "explore-prompts")
        sampled = D.stratified_sample(pool.select("conv_id", "title", "create_time"), D.EXPLORE_SAMPLE)
        batches = D.chunked(sampled, D.EXPLORE_BATCH, [F.col("sample_ord")], "batch")
        sugg = materialize(D.apply_explore_responses(prompts, X.explore_responses(batches)), "suggestions")
        return prompts, sugg

    prompts, sugg = _stage(spark, sf_dir, "explore", build)
    seed = spark.createDataFrame([("topic-1", "Seeded topic one", "seed", ["Seed title"], 3)],
                                 "slug string, name string, description string, sample_titles array<string>, count bigint")
    merged = D.merge_suggestions(seed, D.new_suggestions(sugg, cats))
    return cats, prompts, sugg, merged


@register
def explore_prompts(spark, sf_dir):
    """M3 (W7 sample 50, W6 batches of 5, F2 at 600 characters)."""
    return _explore(spark, sf_dir)[1].select("prompt_id", "batch", "prompt")


@register
def new_suggestions(spark, sf_dir):
    """M4 + P15: parsed suggestions that are new."""
    cats, _, sugg, _ = _explore(spark, sf_dir)
    return D.new_suggestions(sugg, cats).select("batch", "item_pos", "slug", "name", "description", joined("sample_titles").alias("sample_titles"))


@register
def suggestion_merge(spark, sf_dir):
    """A9 seeded by an existing report."""
    merged = _explore(spark, sf_dir)[3]
    return merged.select("slug", "name", "description", joined("sample_titles").alias("sample_titles"), "count")


@register
def generate_keywords(spark, sf_dir):
    """F15 over merged suggestions."""
    merged = _explore(spark, sf_dir)[3]
    return merged.select("slug", joined(D.keywords_for(F.col("name"), F.col("slug"))).alias("keywords"))


@register
def discovery_top(spark, sf_dir):
    """O4, O6."""
    merged = _explore(spark, sf_dir)[3]
    return D.discovery_top(merged).select("slug", "name", "count", joined("head_titles").alias("head_titles"))


@register
def apply_discovery(spark, sf_dir):
    """Add topic-0/3/6, merge topic-1 into english, topic-2 into the
    added topic-0, topic-4 into a missing slug; skip the rest."""
    cats, _, _, merged = _explore(spark, sf_dir)
    n = F.regexp_extract("slug", r"(\d+)$", 1).try_cast("int")
    decisions = merged.select(
        "slug", F.coalesce(n, F.lit(99)).cast("bigint").alias("seq"),
        F.when(n.isin(0, 3, 6), "add").when(n.isin(1, 2, 4), "merge").otherwise("skip").alias("action"),
        F.when(n == 1, "english").when(n == 2, "topic-0").when(n == 4, "nowhere").alias("target"),
        F.lit(None).cast("array<string>").alias("keywords"))
    out = D.apply_discovery(cats, merged, decisions)
    return out.select("slug", "name", "description", joined("keywords").alias("keywords"))


def _ask(spark, sf_dir, question="What was decided?"):
    msgs, hdrs = _base(spark, sf_dir)
    pool = _stage(spark, sf_dir, "ask-pool", lambda: materialize(A.ask_pool_state(hdrs.where("message_count >= 4"), _state(spark, sf_dir)), "ask-pool"))
    prompts = A.ask_prompts(pool, msgs, question)
    return msgs, hdrs, pool, prompts


@register
def ask_pool_state(spark, sf_dir):
    """J12 state path: labelled, relevance >= 0.3, relevance order."""
    return _ask(spark, sf_dir)[2].select("conv_id", "relevance_score", "pool_rank")


@register
def ask_pool_raw(spark, sf_dir):
    """J12 raw path: min_messages 4, newest first."""
    _, hdrs = _base(spark, sf_dir)
    return A.ask_pool_raw(hdrs).select("conv_id", "pool_rank")


@register
def ask_prompts(spark, sf_dir):
    """Batches of 3 transcripts + question."""
    return _ask(spark, sf_dir)[3].select("prompt_id", "batch", "prompt")


@register
def synthesis_prompts(spark, sf_dir):
    """M15 over the partial answers."""
    _, _, _, prompts = _ask(spark, sf_dir)
    partials = A.partial_answers(prompts, X.ask_responses(prompts))
    return A.synthesis_prompts(partials, "What was decided?").select("prompt_id", "n_answers", "prompt")


@register
def answer_document(spark, sf_dir):
    """K11 + M16: answer (single batch or synthesis) and sources."""
    _, _, pool, prompts = _ask(spark, sf_dir)
    answer = A.reduce_answers(A.partial_answers(prompts, X.ask_responses(prompts)), "What was decided?", X.synthesis_responses)
    return A.answer_document_blocks("What was decided?", answer, A.ask_sources(pool), "01 Jun 2024 00:00")


@register
def ask_sources(spark, sf_dir):
    """M16 sources list."""
    return A.ask_sources(_ask(spark, sf_dir)[2])


@register
def stub_conversations(spark, sf_dir):
    """Synthetic one-message conversations from state only."""
    h, m = Sel.stub_conversations(_state(spark, sf_dir))
    return h.select("conv_id", "title", "create_time").join(m.select("conv_id", "content"), "conv_id")


@register
def enhanced_hydrate(spark, sf_dir):
    """J5 + F17: enhanced fields over base ones, 1-based range labels."""
    hdrs, st, lab, pairs, summaries, ranges, detailed = _pass3(spark, sf_dir)
    enhanced = E.enhanced_records(lab, summaries, ranges, detailed, "2024-06-01T00:00:00+00:00")
    j = Sel.with_enhanced(lab, enhanced)
    labels = F.transform(F.map_keys(F.coalesce("detailed_summaries", F.create_map().cast("map<string,string>"))), lambda k: Tx.range_label(k))
    return j.select("conv_id", "digest_summary", joined("digest_facts").alias("digest_facts"), "has_enhanced",
                    joined(labels).alias("range_labels"))


def _review_edits_raw(spark, sf_dir, raw=False):
    """Edits derived per conversation (id % 6): 1 recategorise with one
    unknown slug, 2 relevance 1.7 (clamped), 3 delete, 4 two recategorise
    edits (last wins) then a relevance edit, 5 only unknown slugs (ignored)."""
    st = _state(spark, sf_dir)
    m = F.col("conv_id") % 6
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs])
    e1 = st.where(m == 1).select("conv_id", F.lit(1).alias("seq"), F.lit("recategorise").alias("action"), arr("german", "bogus").alias("categories"), F.lit(None).cast("double").alias("relevance"))
    e2 = st.where(m == 2).select("conv_id", F.lit(1).alias("seq"), F.lit("relevance").alias("action"), F.lit(None).cast("array<string>").alias("categories"), F.lit(1.7).alias("relevance"))
    e3 = st.where(m == 3).select("conv_id", F.lit(1).alias("seq"), F.lit("delete").alias("action"), F.lit(None).cast("array<string>").alias("categories"), F.lit(None).cast("double").alias("relevance"))
    e4a = st.where(m == 4).select("conv_id", F.lit(1).alias("seq"), F.lit("recategorise").alias("action"), arr("french").alias("categories"), F.lit(None).cast("double").alias("relevance"))
    e4b = st.where(m == 4).select("conv_id", F.lit(2).alias("seq"), F.lit("recategorise").alias("action"), arr("spanish", "english", "spanish").alias("categories"), F.lit(None).cast("double").alias("relevance"))
    e4c = st.where(m == 4).select("conv_id", F.lit(3).alias("seq"), F.lit("relevance").alias("action"), F.lit(None).cast("array<string>").alias("categories"), F.lit(-0.2).alias("relevance"))
    e5 = st.where(m == 5).select("conv_id", F.lit(1).alias("seq"), F.lit("recategorise").alias("action"), arr("nope").alias("categories"), F.lit(None).cast("double").alias("relevance"))
    edits = e1.unionByName(e2).unionByName(e3).unionByName(e4a).unionByName(e4b).unionByName(e4c).unionByName(e5)
    out = Rv.apply_review_edits(st, edits, X.categories(spark))
    if raw:
        return out
    return out.select("conv_id", joined("categories").alias("categories"), "relevance_score")


@register
def apply_review_edits(spark, sf_dir):
    """Edits derived per conversation (id % 6): 1 recategorise with one
    unknown slug, 2 relevance 1.7 (clamped), 3 delete, 4 two recategorise
    edits (last wins) then a relevance edit, 5 only unknown slugs (ignored)."""
    return _review_edits_raw(spark, sf_dir)


# ---------------------------------------------------------------- ingest
from parlance.operators.tree import linearise_tree as _linearise  # noqa: E402
from parlance.plans.ingest import ingest as _ingest  # noqa: E402
from parlance.session import scratch_path  # noqa: E402
from parlance.sources import export as Ex  # noqa: E402

_EXPORTS: dict = {}


def _export_dir(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _EXPORTS:
        _EXPORTS[key] = X.write_export_fixture(spark, sf_dir, scratch_path(spark, "export"))
    return _EXPORTS[key]


def _ingested(spark, sf_dir):
    """The ingest stage's stored output (headers, messages)."""
    def build():
        hdrs, msgs = _ingest(spark, _export_dir(spark, sf_dir))
        return materialize(hdrs, "ingest-headers"), materialize(msgs, "ingest-messages")
    return _stage(spark, sf_dir, "ingest", build)


@register
def linearise_tree(spark, sf_dir):
    """W1, J9 over the fixture tree of every conversation."""
    nodes = X.tree_nodes_from_table(spark, sf_dir)
    return _linearise(nodes)


@register
def ingest_roundtrip(spark, sf_dir):
    """Raw export files written from the table
    and read back into messages."""
    hdrs, msgs = _ingested(spark, sf_dir)
    return msgs.join(hdrs.select("conv_id", "title"), "conv_id").select("conv_id", "pos", "role", "content", "ts", "title")


@register
def dedup_last_wins(spark, sf_dir):
    """The surviving record per id (file and title)."""
    hdrs, _ = _ingested(spark, sf_dir)
    return hdrs.select("conv_id", "title", "file", "create_time", "update_time", "message_count", "user_messages")


@register
def content_text(spark, sf_dir):
    """F1 over heterogeneous content variants built from every turn."""
    conv = X.table(spark, sf_dir, "conversations")
    qt = F.regexp_extract(F.to_json(F.array("text")), r"^\[(.*)\]$", 1)
    k = (F.col("conv_id") + F.col("turn")) % 5
    js = (F.when(k == 0, F.concat(F.lit('{"content_type": "text", "parts": ['), qt, F.lit("]}")))
          .when(k == 1, F.concat(F.lit('{"content_type": "text", "parts": ['), qt, F.lit(', 5, {"x": 1}, "  tail  "]}')))
          .when(k == 2, F.concat(F.lit('{"content_type": "multimodal_text", "parts": [{"content_type": "image_asset_pointer", "asset": "a"}, '),
                                 qt, F.lit(', {"content_type": "text", "text": "caption"}, {"content_type": "text"}]}')))
          .when(k == 3, F.concat(F.lit('{"content_type": "code", "text": '), qt, F.lit("}")))
          .otherwise(F.concat(F.lit('{"parts": ['), qt, F.lit("]}"))))
    return conv.select("conv_id", "turn", Ex.content_text(F.parse_json(js)).alias("text"))


# ---------------------------------------------------------------- stored tables (S6-S9, K1-K4, K8, K12) and streaming
from parlance.sources import tables as Tb  # noqa: E402
from parlance.streaming import incremental as Inc  # noqa: E402
from pyspark.sql import Window as _W  # noqa: E402


def _discovered_categories(spark, sf_dir):
    cats, _, _, merged = _explore(spark, sf_dir)
    n = F.regexp_extract("slug", r"(\d+)$", 1).try_cast("int")
    decisions = merged.select(
        "slug", F.coalesce(n, F.lit(99)).cast("bigint").alias("seq"),
        F.when(n.isin(0, 3, 6), "add").when(n.isin(1, 2, 4), "merge").otherwise("skip").alias("action"),
        F.when(n == 1, "english").when(n == 2, "topic-0").when(n == 4, "nowhere").alias("target"),
        F.lit(None).cast("array<string>").alias("keywords"))
    out = D.apply_discovery(cats, merged, decisions)
    # the category table is bounded (size-checked), so a global order is cheap
    return cats, merged, out.select((F.row_number().over(_W.orderBy("seq")) - 1).cast("int").alias("cat_ord"),
                                    "slug", "name", "description", "keywords")


@register
def category_table_load(spark, sf_dir):
    """K12 save + S6 load of the category table produced by discovery."""
    _, _, cats2 = _discovered_categories(spark, sf_dir)
    path = scratch_path(spark, "categories") + ".json"
    Tb.save_categories(spark, cats2, path)
    back = Tb.read_categories(spark, path)
    return back.select("slug", "name", "description", joined("keywords").alias("keywords"))


@register
def categories_upsert(spark, sf_dir):
    """K12 merge: added categories appended after the existing ones."""
    cats, merged, _ = _discovered_categories(spark, sf_dir)
    n = F.regexp_extract("slug", r"(\d+)$", 1).try_cast("int")
    adds = merged.where(n.isin(0, 3, 6)).select(n.alias("cat_ord"), "slug", "name", F.coalesce("description", F.lit("")).alias("description"),
                                                D.keywords_for(F.col("name"), F.col("slug")).alias("keywords"))
    out = Tb.upsert_categories(cats, adds)
    return out.select(F.col("cat_ord").cast("bigint").alias("cat_ord"), "slug", "name")


def _store(spark):
    return Tb.TableStore(spark, scratch_path(spark, "store"))


@register
def state_upsert(spark, sf_dir):
    """K2 + S7: state written, review-edit rows upserted, newest version read."""
    st = _state(spark, sf_dir)
    store = _store(spark)
    store.write("state", st)
    edited = _review_edits_raw(spark, sf_dir, raw=True)
    changed = edited.join(st.select("conv_id", F.col("categories").alias("_c"), F.col("relevance_score").alias("_r")), "conv_id") \
        .where((F.col("categories") != F.col("_c")) | (F.col("relevance_score") != F.col("_r"))).drop("_c", "_r")
    store.upsert("state", changed, "conv_id")
    out = store.read("state")
    return out.select("conv_id", joined("categories").alias("categories"), "relevance_score")


def _enhanced_now(spark, sf_dir):
    hdrs, st, lab, pairs, summaries, ranges, detailed = _pass3(spark, sf_dir)
    return hdrs, lab, E.enhanced_records(lab, summaries, ranges, detailed, "2024-06-01T00:00:00+00:00")


@register
def state_clear(spark, sf_dir):
    """K4: enhanced rows cleared for the members of one category."""
    hdrs, lab, enhanced = _enhanced_now(spark, sf_dir)
    store = _store(spark)
    store.write("enhanced", enhanced)
    store.delete_keys("enhanced", Sel.in_category(lab, "german").select("conv_id"))
    return store.read("enhanced").select("conv_id")


@register
def enhanced_upsert(spark, sf_dir):
    """K3: previous enhanced rows plus this run's work list."""
    hdrs, lab, enhanced = _enhanced_now(spark, sf_dir)
    store = _store(spark)
    previous = enhanced.join(hdrs.where("message_count <= 5").select("conv_id"), "conv_id", "left_semi")
    store.write("enhanced", previous)
    work = E.enhance_worklist(lab, X.categories(spark), store.read("enhanced"))
    store.upsert("enhanced", enhanced.join(work, "conv_id", "left_semi"), "conv_id")
    return store.read("enhanced").select("conv_id", F.size("message_summaries").cast("bigint").alias("n_summaries"))


@register
def index_roundtrip(spark, sf_dir):
    """K1 + S8: the merged parsed index written newest first and read back."""
    merged = index_upsert(spark, sf_dir)
    path = scratch_path(spark, "parsed-index")
    Tb.write_index(merged, 4, "2024-06-01T00:00:00+00:00", path)
    return Tb.read_index(spark, path)


@register
def discovery_roundtrip(spark, sf_dir):
    """K12 report write + S9 read of the merged suggestions."""
    cats, _, _, merged = _explore(spark, sf_dir)
    path = scratch_path(spark, "discovery") + ".json"
    Tb.save_json_document(spark, Tb.discovery_json(merged, "stub", False, 50, [r[0] for r in X.CATEGORY_ROWS], "2024-06-01T00:00:00+00:00"), path)
    back = Tb.read_discovery(spark, path)
    return back.select("slug", "name", "description", joined("sample_titles").alias("sample_titles"), "count")


@register
def category_index_merge(spark, sf_dir):
    """K8: this run's per-category stats win; a slug only in the previous
    index is kept."""
    _, _, _, lab = _labelled(spark, sf_dir)
    new = S.category_index(lab, X.categories(spark))
    legacy = spark.createDataFrame([("legacy", "Legacy", 3, 0.4), ("english", "English (old)", 1, 0.1)],
                                   "slug string, name string, count bigint, avg_relevance double")
    return Tb.merge_category_index(legacy, new)


def _land(spark, src_dir, prefix, dst_dir):
    """Copy the export files of one set into a landing folder."""
    jvm = spark._jvm
    Path = jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    fs = Path(src_dir).getFileSystem(conf)
    fs.mkdirs(Path(dst_dir))
    for st in fs.listStatus(Path(src_dir)):
        if st.getPath().getName().startswith(prefix):
            jvm.org.apache.hadoop.fs.FileUtil.copy(fs, st.getPath(), fs, Path(dst_dir), False, conf)


@register
def incremental_ingest(spark, sf_dir):
    """Two availableNow runs; the second sees only the new files, whose
    revised titles win."""
    export_dir = _export_dir(spark, sf_dir)
    source = scratch_path(spark, "landing")
    store = _store(spark)
    ckpt = scratch_path(spark, "stream-ckpt")
    for prefix in ("export-0-", "export-1-"):
        _land(spark, export_dir, prefix, source)
    Inc.ingest_stream(spark, source, store, ckpt)
    _land(spark, export_dir, "export-2-", source)
    Inc.ingest_stream(spark, source, store, ckpt)
    return store.read("parsed_index")


@register
def label_stream(spark, sf_dir):
    """Keyword labelling of new conversations, skipping stored ones."""
    msgs, hdrs, pool = _pool(spark, sf_dir)
    store = _store(spark)
    store.write("state", _state(spark, sf_dir))
    source = scratch_path(spark, "headers-landing")
    pool.write.parquet(source)
    Inc.label_stream(spark, source, pool.schema.simpleString()[7:-1].replace(":", " "), msgs, X.categories(spark), store,
                     scratch_path(spark, "label-ckpt"))
    out = store.read("state")
    return out.select("conv_id", joined("categories").alias("categories"), "summary", "relevance_score")



#: Stored stages by name, in the order of their inputs; each is built once per session.
STAGE_BUILDS: dict[str, Callable] = {
    "messages, headers, state": X.prepared,
    "export files (J9, W1 input)": _export_dir,
    "ingest (S1-S5, W1, W2, P1-P3)": _ingested,
    "pairs (W4)": _enhance_inputs,
    "pass 1 (M6, M7, J8)": _pass1,
    "pass 2 (M8, M9)": _pass2,
    "pass 3 (M10, M11)": _pass3,
    "explore (M3, M4)": _explore,
    "ask pool (J12)": lambda spark, sf_dir: _ask(spark, sf_dir),
}
#: Queries that only read a stored stage: their work is the stage's.
STORED_READS = ["ingest_roundtrip", "dedup_last_wins", "one_liners", "flag_ranges", "expansions", "explore_prompts", "ask_pool_state"]


def prepare(spark: SparkSession, sf_dir: str) -> None:
    """Build the stored stage tables once: ingest tables and state, the raw
    export files, the three enhance passes and the discovery suggestions."""
    for build in STAGE_BUILDS.values():
        build(spark, sf_dir)


@register
def index_by_created(spark, sf_dir):
    """O3 + K1: the merged parsed index newest-first by the ``created``
    text (ties by id), numbered with the offset-based global rank."""
    merged = index_upsert(spark, sf_dir)
    return with_global_rank(merged, [F.col("created").desc(), F.col("id")], "position").select("position", "id", "created", "title")


@register
def ask_pool_ids(spark, sf_dir):
    """J12 path A: requested ids in request order, repeats kept, missing
    dropped; no hydration or relevance filter (min_messages 4 applies)."""
    _, _, pool = _pool(spark, sf_dir)
    ids = Sel.id_frame(spark, ID_OPTIONS, "bigint")
    return A.ask_pool_ids(pool, ids).select("conv_id", "title", "pool_rank")


@register
def answer_levels(spark, sf_dir):
    """The reduce in levels of three answers until one is left."""
    prompts = _ask(spark, sf_dir)[3]
    return A.reduce_answers(A.partial_answers(prompts, X.ask_responses(prompts)), "What was decided?", X.synthesis_responses, fan_in=3)


@register
def ask_prompts_ids(spark, sf_dir):
    """M14 over requested ids: a repeated id repeats its transcript."""
    msgs, _, pool = _pool(spark, sf_dir)
    ids = Sel.id_frame(spark, ID_OPTIONS, "bigint")
    return A.ask_prompts(A.ask_pool_ids(pool, ids), msgs, "What was decided?").select("prompt_id", "batch", "prompt")


@register
def ask_pool_stub(spark, sf_dir):
    """J11 + J12 without an export: the pool from state rows alone."""
    return A.ask_pool_stub(_state(spark, sf_dir))[0].select("conv_id", "title", "relevance_score", "pool_rank")


@register
def ask_failed_batch(spark, sf_dir):
    """The batches whose prompt failed, with the error."""
    prompts = _ask(spark, sf_dir)[3]
    return A.failed_batches(A.partial_answers(prompts, X.ask_responses_failing(prompts)))


@register
def answer_file(spark, sf_dir):
    """The document written under its file name and read back, by line."""
    path = scratch_path(spark, "answers")
    name = A.answer_file_name("english", "20240601-000000")
    Tb.write_text_file(answer_document(spark, sf_dir), f"{path}/{name}", [F.col("part"), F.col("pool_rank")])
    return spark.read.text(f"{path}/{name}").select(F.col("value").alias("line"))


@register
def category_json_files(spark, sf_dir):
    """K5: the written files read back."""
    _, _, _, lab = _labelled(spark, sf_dir)
    path = scratch_path(spark, "category-json")
    R.write_category_json(lab, X.categories(spark), path)
    back = spark.read.schema("id string, title string, created string, updated string, message_count bigint, user_messages bigint, categories array<string>, "
                             "tags array<string>, summary string, key_facts array<string>, relevance_score double, slug string").json(path)
    return _arr_out(back, ["categories", "tags", "key_facts"])


@register
def concat_chunked(spark, sf_dir):
    """A11 with three messages a row."""
    return S.concat_ordered(_base(spark, sf_dir)[0], "conv_id", "pos", "content", "\n", chunk=3)


@register
def label_many_categories(spark, sf_dir):
    """P11 against one category per order that has line items."""
    cats = X.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("slug")).distinct()
    key = F.col("o_orderkey")
    named = F.array(*[F.concat(F.lit(p), (key + d).cast("string")) for p, d in (("order-", 1), ("nope-", 0), ("order-", 0), ("order-", 1), ("order-", 7))])
    rows = X.table(spark, sf_dir, "orders").select("o_orderkey", named.alias("categories"))
    return L.keep_valid(rows, cats, ["o_orderkey"]).select("o_orderkey", joined("categories").alias("categories"))


@register
def explore_free(spark, sf_dir):
    """M5: prompts of the free mode, chosen because no category exists."""
    msgs, _, pool = _pool(spark, sf_dir)
    return D.explore_prompts(pool, msgs, X.categories(spark).limit(0)).select("prompt_id", "batch", "prompt")


@register
def ingest_flat(spark, sf_dir):
    """Export files with flat records."""
    def build():
        return _ingest(spark, X.write_flat_export(spark, sf_dir, scratch_path(spark, "flat-export")))
    hdrs, msgs = _stage(spark, sf_dir, "ingest-flat", build)
    return msgs.join(hdrs.select("conv_id", "title", "message_count"), "conv_id")


@register
def stream_then_stats(spark, sf_dir):
    """T1 then A4: a batch run's statistics of what two streaming runs ingested."""
    from parlance.plans import commands as C
    ws = C.Workspace(spark, scratch_path(spark, "workspace"))
    source, ckpt = scratch_path(spark, "landing"), scratch_path(spark, "stream-ckpt")
    export_dir = _export_dir(spark, sf_dir)
    for prefixes in (("export-0-", "export-1-"), ("export-2-",)):
        for prefix in prefixes:
            _land(spark, export_dir, prefix, source)
        Inc.ingest_stream(spark, source, ws.store, ckpt)
    return C.stats(ws)["corpus"]


@register
def label_stream_model(spark, sf_dir):
    """T2 with the model step: rows that are not done are labelled again."""
    msgs, hdrs, pool = _pool(spark, sf_dir)
    st = _state(spark, sf_dir)
    store = _store(spark)
    store.write("state", st)
    source = scratch_path(spark, "headers-landing")
    pool.write.parquet(source)
    Inc.label_stream(spark, source, pool.schema.simpleString()[7:-1].replace(":", " "), msgs, X.categories(spark), store,
                     scratch_path(spark, "label-ckpt"), responses_for=lambda prompts: X.label_responses(prompts, st))
    return store.read("state").select("conv_id", joined("categories").alias("categories"), "summary", "relevance_score")


@register
def ingest_split(spark, sf_dir):
    """The raw export files split into records by many tasks, as files of any size can be."""
    from parlance.plans.ingest import ingest_raw
    hdrs, msgs = ingest_raw(Ex.read_export(spark, _export_dir(spark, sf_dir), split_bytes=0))
    return msgs.join(hdrs.select("conv_id", "title"), "conv_id").select("conv_id", "pos", "role", "content", "ts", "title")


@register
def linearise_dag(spark, sf_dir):
    """W1 where a node is listed by two parents: the root of every second
    conversation lists node 3 first, too, so it is visited from there."""
    nodes = X.tree_nodes_from_table(spark, sf_dir)
    twice = (F.col("node_id") == "0") & (F.col("conv_id") % 2 == 0)
    return _linearise(nodes.withColumn("children", F.when(twice, F.concat(F.array(F.lit("3")), F.coalesce("children", F.array()))).otherwise(F.col("children"))))


@register
def keyword_label_many(spark, sf_dir):
    """J7 with every word of the documents as a keyword, its first three letters as the category."""
    from parlance.plans.materialize import materialize
    msgs, hdrs = _base(spark, sf_dir)
    words = X.table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), " ")).alias("word")).where("word <> ''").distinct()
    cats = words.groupBy(F.substring("word", 1, 3).alias("slug")).agg(F.collect_list("word").alias("keywords")).withColumn("cat_ord", F.lit(0))
    cats = materialize(cats, "word-categories")
    return L.keyword_label(hdrs, msgs, cats).select("conv_id", joined("categories").alias("categories"), "relevance_score")
