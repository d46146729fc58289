"""End-to-end runs, one per command of the reference, composed from the
operators and a versioned table store (``Workspace``).

parse -> headers, messages, parsed index | categorise -> state |
stats | export -> category documents, context packages, category index |
enhance -> enhanced table, proposals, enhanced packages | ask -> answer +
sources | transcribe -> Markdown per conversation | explore -> discovery
report | review -> state edits.

The model is a user function over a pandas batch of prompts (see
``operators.generate``); nothing needs a server. Every step is a Spark job;
the only values brought to the driver are counts and the category table
(configuration whose whole list goes into prompts and side files).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators import ask as A
from parlance.operators import discover as D
from parlance.operators import enhance as E
from parlance.operators import label as L
from parlance.operators import render as R
from parlance.operators import review as Rv
from parlance.operators import select as Sel
from parlance.operators import stats as S
from parlance.operators.generate import generate, generate_logged
from parlance.operators.pairs import message_pairs
from parlance.operators.setops import merge_counts
from parlance.plans.ingest import ingest
from parlance.plans.materialize import materialize
from parlance.sources import tables as Tb

STATE_SCHEMA = ("conv_id string, title string, created string, updated string, message_count bigint, "
                "user_messages bigint, categories array<string>, tags array<string>, summary string, "
                "key_facts array<string>, relevance_score double")
INDEX_SCHEMA = "id string, title string, created string, updated string, messages bigint, user_messages bigint"

Model = Callable


class NothingParsed(RuntimeError):
    pass


class Workspace:
    """Stored tables of one corpus under ``root`` (shared storage). With
    ``resume``, model steps keep a response log there: a run that failed goes
    on where it stopped, and no finished prompt is asked twice."""

    def __init__(self, spark: SparkSession, root: str, resume: bool = False):
        self.spark, self.root, self.resume = spark, root.rstrip("/"), resume
        self.store = Tb.TableStore(spark, self.root + "/tables")

    def respond(self, prompts: DataFrame, model: Model, name: str) -> DataFrame:
        """The stored responses of a model step."""
        if self.resume:
            return materialize(generate_logged(prompts, model, self.root + "/responses"), name)
        return materialize(generate(prompts, model), name)

    def headers(self) -> DataFrame | None:
        """Headers of all conversations, from batch and streaming runs alike."""
        return self.store.keyed("headers").read()

    def parsed(self) -> DataFrame:
        """The headers; without a parsed export the run cannot go on."""
        headers = self.headers()
        if headers is None:
            raise NothingParsed(f"no conversations under {self.root}: parse an export into this workspace first")
        return headers

    def messages(self) -> DataFrame | None:
        return self.store.keyed("messages").read()

    def state(self) -> DataFrame:
        return self.store.read("state", STATE_SCHEMA)


# ---------------------------------------------------------------- parse
def parse(ws: Workspace, input_path: str, min_messages: int = 4, glob: str = "*.json") -> dict[str, DataFrame]:
    headers, msgs = ingest(ws.spark, input_path, glob)
    headers = headers.drop("file")
    new_index = Sel.index_rows(S.min_messages(headers, min_messages))
    old_index = ws.store.read("parsed_index", INDEX_SCHEMA)
    counts = materialize(merge_counts(new_index, old_index, "id"), "parse-counts")
    ws.store.keyed("messages").upsert(msgs)
    ws.store.keyed("headers").upsert(headers)
    ws.store.upsert("parsed_index", new_index, "id")
    return {"summary": S.parse_summary(headers, min_messages), "merge": counts}


# ---------------------------------------------------------------- categorise
def categorise(ws: Workspace, cats: DataFrame, model: Model | None = None, limit: int | None = None,
               min_messages: int = 4, max_chars: int = 8000) -> dict[str, DataFrame]:
    pool = S.min_messages(ws.parsed(), min_messages)
    if limit:
        pool = Sel.first_n(pool, limit)
    state = ws.state()
    msgs = ws.messages()
    if model is None:
        work = L.worklist(pool, state)                       # P14
        labels = L.keyword_label(work, msgs, cats)
        rows = Sel.state_rows(work.join(labels, "conv_id").select(
            *work.columns, "categories", F.array().cast("array<string>").alias("tags"), F.lit("").alias("summary"),
            F.array().cast("array<string>").alias("key_facts"), "relevance_score"))
        ok = rows
    else:
        work = L.worklist(pool, L.model_done(state))         # P13
        prompts = L.label_prompts(work, msgs, cats, max_chars)
        responses = ws.respond(prompts, model, "label-responses")
        parsed = L.apply_label_responses(prompts, responses, cats).where("status = 'ok'").drop("status")
        rows = Sel.state_rows(work.join(parsed, "conv_id"))
        ok = rows
    rows = materialize(rows, "label-rows")
    status = materialize(L.run_status(pool, state, ok, using_model=model is not None), "label-status")
    new_state = ws.store.upsert("state", rows, "conv_id")
    labelled = Sel.labelled(Sel.hydrate(pool, new_state, "label"))
    return {"counts": L.run_counts(status), "labels": S.label_counts(labelled)}


# ---------------------------------------------------------------- stats
def stats(ws: Workspace, min_messages: int = 4) -> dict[str, DataFrame]:
    headers, state = ws.parsed(), ws.state()
    pool = Sel.hydrate(S.min_messages(headers, min_messages), state, "stats")
    return {"corpus": S.corpus_stats(headers, state, min_messages),
            "categories": S.category_breakdown(pool),
            "relevance": S.relevance_histogram(pool)}


# ---------------------------------------------------------------- export
def export(ws: Workspace, cats: DataFrame, out_dir: str, generated_at: str, slug: str | None = None,
           context_package: bool = False, min_rel: float = 0.3, min_messages: int = 4) -> None:
    picked = Sel.pick_category(cats, slug) if slug else cats
    pool = Sel.labelled(Sel.hydrate(S.min_messages(ws.parsed(), min_messages), ws.state(), "label"))
    if context_package:
        R.write_documents(R.context_package_blocks(pool, picked, min_rel, generated_at), f"{out_dir}/context")
        return
    R.write_documents(R.category_markdown_blocks(pool, picked, generated_at), f"{out_dir}/markdown")
    R.write_category_json(pool, picked, f"{out_dir}/json")
    R.category_json_header(pool, picked, generated_at).write.mode("overwrite").json(f"{out_dir}/json_header")
    index = S.category_index(pool, picked)
    previous = ws.store.read("category_index", "slug string, name string, count bigint, avg_relevance double")
    ws.store.write("category_index", Tb.merge_category_index(previous, index))
    ws.store.write("category_index_total", S.exported_total(pool, picked))


# ---------------------------------------------------------------- enhance
def enhance(ws: Workspace, cats: DataFrame, model: Model, out_dir: str, generated_at: str, enhanced_at: str,
            slug: str | None = None, reset: bool = False, accept: Callable[[DataFrame], DataFrame] | None = None,
            min_rel: float = 0.3, min_messages: int = 4) -> dict[str, DataFrame]:
    """Three passes for the work list (C5), proposals and their acceptance
    (``accept(diffs) -> (conv_id, accept_a, accept_b)``; None accepts
    nothing), then the enhanced packages."""
    if slug is not None and Sel.pick_category(cats, slug).limit(1).count() == 0:
        raise ValueError(f"unknown category slug: {slug}")
    picked = Sel.pick_category(cats, slug) if slug else cats
    headers, msgs, state = ws.parsed(), ws.messages(), ws.state()
    lab = Sel.labelled(Sel.hydrate(S.min_messages(headers, min_messages), state, "label"))
    previous = ws.store.read("enhanced")
    if previous is not None and reset:
        # The rows of this run's conversations go first: a failed new run leaves none behind.
        previous = ws.store.delete_keys("enhanced", E.enhance_worklist(lab, picked, previous, reset=True))
    if previous is None:
        previous = lab.limit(0).select("conv_id")
    members = E.enhance_worklist(lab, picked, previous, reset=True)
    work = materialize(E.enhance_worklist(lab, picked, previous, reset=False), "enh-work")
    wlab = lab.join(work, "conv_id", "left_semi")

    pairs = materialize(message_pairs(msgs.join(work, "conv_id", "left_semi")), "enh-pairs")
    p1 = E.pair_prompts(pairs)
    r1 = ws.respond(p1, model, "enh-r1")
    summaries, _ = E.apply_pair_responses(pairs, p1, r1)
    summaries = materialize(summaries, "enh-pass1")
    p2 = E.flag_prompts(summaries, headers)
    ranges = materialize(E.apply_flag_responses(p2, ws.respond(p2, model, "enh-r2")), "enh-pass2")
    p3 = E.expand_prompts(ranges, pairs, headers)
    detailed = materialize(E.apply_expand_responses(p3, ws.respond(p3, model, "enh-r3")), "enh-pass3")
    records = E.enhanced_records(wlab, summaries, ranges, detailed, enhanced_at)
    p4 = E.proposal_prompts(wlab, detailed)
    diffs = materialize(E.proposal_diff(wlab, p4, ws.respond(p4, model, "enh-r4")), "enh-diffs")
    if accept is not None:
        new_state, new_enh = E.apply_proposals(state, records, diffs, accept(diffs))
        ws.store.write("state", new_state)
        records = new_enh
    enhanced = ws.store.upsert("enhanced", records, "conv_id")
    R.write_documents(R.enhanced_package_blocks(lab, enhanced, picked, min_rel, generated_at), f"{out_dir}/enhanced")
    # A10: conversations processed, failed and skipped, and packages written.
    done = records.select("conv_id")
    counts = members.agg(F.count(F.lit(1)).alias("members")).collect()[0]["members"]
    todo, ok = work.count(), done.count()
    packages = R.category_members(lab, picked).select("slug").distinct().count()
    status = ws.spark.createDataFrame([("processed", ok), ("error", todo - ok), ("skipped", counts - todo), ("files", packages)], "status string, conversations bigint")
    return {"diffs": diffs, "enhanced": enhanced, "counts": status}


# ---------------------------------------------------------------- ask
def ask(ws: Workspace, question: str, model: Model, slug: str | None = None, ids: DataFrame | None = None,
        min_rel: float = 0.3, batch: int = A.ASK_BATCH, fan_in: int = A.FAN_IN, min_messages: int = 4,
        generated_at_long: str = "", out_dir: str | None = None, file_stamp: str = "") -> dict[str, DataFrame]:
    """Map: one prompt per batch; reduce: synthesis in levels of at most
    ``fan_in`` answers until one answer is left (one level for up to
    ``fan_in`` batches, as the reference). Without a parsed export the pool
    comes from the state alone. A failed prompt fails the ask; an unknown or
    empty category is an error; requested ids without a conversation are
    returned as ``missing``. With ``out_dir`` the document is written to a
    named file there."""
    headers, msgs, state = ws.headers(), ws.messages(), ws.state()
    missing = None
    if headers is None:
        if state.limit(1).count() == 0:
            raise ValueError("nothing to ask: no parsed export and no state")
        if ids is not None:
            state = Sel.by_ids(state, ids)
        pool, msgs = A.ask_pool_stub(state, slug, min_rel if ids is None else 0.0)
    elif ids is not None:
        listed = S.min_messages(headers, min_messages)
        missing = Sel.lookup_ordered(listed.select("conv_id"), ids).where(~F.col("found")).select("ord", "conv_id")
        pool = A.ask_pool_ids(listed, ids)
    elif state.limit(1).count() > 0:
        pool = A.ask_pool_state(S.min_messages(headers, min_messages), state, slug, min_rel)
    else:
        pool = A.ask_pool_raw(headers, min_messages)
    pool = materialize(pool, "ask-pool")
    if pool.limit(1).count() == 0:
        raise ValueError(f"no conversation to ask{f' in category {slug}' if slug else ''}")
    prompts = A.ask_prompts(pool, msgs, question, batch)
    partials = A.partial_answers(prompts, ws.respond(prompts, model, "ask-r0"))
    answer = A.reduce_answers(partials, question, lambda p: ws.respond(p, model, "ask-synth"), fan_in)
    sources = A.ask_sources(pool)
    doc = A.answer_document_blocks(question, answer, sources, generated_at_long)
    out = {"answer": answer, "sources": sources, "document": doc}
    if missing is not None:
        out["missing"] = missing
    if out_dir is not None:
        name = A.answer_file_name(slug, file_stamp)
        Tb.write_text_file(doc, f"{out_dir.rstrip('/')}/{name}", [F.col("part"), F.col("pool_rank")])
    return out


# ---------------------------------------------------------------- transcribe
def transcribe(ws: Workspace, out_dir: str, conv_id=None) -> DataFrame:
    """K10 for one conversation (an empty result means not found): its
    Markdown file; or for all: block rows with their ``file_name``."""
    headers, msgs = ws.parsed(), ws.messages()
    if conv_id is not None:
        headers, msgs = Sel.by_id(headers, conv_id), Sel.by_id(msgs, conv_id)
    names = R.transcript_file_names(headers)
    blocks = R.transcript_blocks(headers, msgs).join(names, "conv_id")
    if conv_id is None:
        R.write_transcripts(blocks, out_dir)
        return names
    found = names.first()
    if found is not None:
        Tb.write_text_file(blocks, f"{out_dir.rstrip('/')}/{found['file_name']}", [F.col("part"), F.col("pos")])
    return names


# ---------------------------------------------------------------- explore
def explore(ws: Workspace, cats: DataFrame, model: Model, report_path: str, discovered_at: str,
            sample: int = D.EXPLORE_SAMPLE, batch: int = D.EXPLORE_BATCH, max_chars: int = D.EXPLORE_CHARS,
            free: bool = False, min_messages: int = 4) -> DataFrame:
    spark = ws.spark
    is_free = D.free_mode(cats, free)
    pool = S.min_messages(ws.parsed(), min_messages)
    prompts = D.explore_prompts(pool, ws.messages(), cats, sample, batch, max_chars, is_free)
    sugg = D.apply_explore_responses(prompts, ws.respond(prompts, model, "explore-r"))
    seed = Tb.read_discovery(spark, report_path)
    merged = materialize(D.merge_suggestions(seed, D.new_suggestions(sugg, cats, is_free)), "explore-merged")
    existing = [r["slug"] for r in cats.select("slug").collect()]
    sampled = min(sample, pool.count()) if sample > 0 else pool.count()
    Tb.save_json_document(spark, Tb.discovery_json(merged, "user-model", is_free, sampled, existing, discovered_at), report_path)
    return D.discovery_top(merged)


# ---------------------------------------------------------------- review
def review(ws: Workspace, cats: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply an edits table (conv_id, seq, action, categories, relevance)."""
    new_state = Rv.apply_review_edits(ws.state(), edits, cats)
    return ws.store.write("state", new_state)
