"""Question answering over the corpus, map-reduce style.

Map: the pool is ranked (offset-based global rank, no single-task window),
cut into batches of ``batch`` conversations, and one prompt per batch holds
their full transcripts. Reduce: partial answers are combined into one
synthesis prompt. A synthesis prompt holds at most ``fan_in`` answers; when
there are more batches than that, the reduce runs in levels (answers of
level k are grouped ``fan_in`` at a time), so no step ever gathers an
unbounded number of answers into one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.formats import ASK_BATCH, ASK_TITLE, GENERATED_LINE, RULE, SOURCE_MID, SOURCE_OPEN, SOURCES
from parlance.functions.prompts import ASK_REQUEST, ASK_SYSTEM, DRAFT, DRAFT_END, SYNTHESIS_SYSTEM
from parlance.functions.text import DATE_FMT, fmt_time
from parlance.operators import select as Sel
from parlance.operators.generate import join_responses
from parlance.operators.render import transcripts
from parlance.plans.materialize import materialize
from parlance.plans.ranks import chunk_index, with_global_rank

# Answers per synthesis prompt; a parameter of the reduce, not a bound on the batches.
FAN_IN = 1000


def ask_pool_state(headers: DataFrame, state: DataFrame, slug: str | None = None, min_rel: float = 0.3) -> DataFrame:
    """J12 paths B/C: hydrate, labelled, optional category, min relevance;
    ordered by relevance (the ``pool_rank`` column)."""
    pool = Sel.labelled(Sel.hydrate(headers, state, "label"))
    if slug is not None:
        pool = Sel.in_category(pool, slug)
    pool = Sel.min_relevance(pool, min_rel)
    return with_global_rank(pool, Sel.relevance_order(), "pool_rank")


def ask_pool_raw(headers: DataFrame, min_messages: int = 4) -> DataFrame:
    """J12 path D: no state; export order (newest first) after min_messages."""
    pool = headers.where(F.col("message_count") >= min_messages)
    return with_global_rank(pool, Sel.newest_order(), "pool_rank")


def ask_pool_ids(headers: DataFrame, ids: DataFrame) -> DataFrame:
    """J12 path A (J3): requested order, repeats kept, missing dropped; no
    hydration, relevance filter or sort (quirk 13)."""
    j = ids.join(headers, "conv_id")
    return with_global_rank(j, [F.col("ord")], "pool_rank").drop("ord")


def ask_pool_stub(state: DataFrame, slug: str | None = None, min_rel: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """J12 without an export: (pool, messages) of the stub conversations made
    from state rows (J11), filtered and ordered like the state path."""
    headers, msgs = Sel.stub_conversations(state)
    return ask_pool_state(headers.select("conv_id", "title", "create_time"), state, slug, min_rel), msgs


def ask_prompts(pool: DataFrame, msgs: DataFrame, question: str, batch: int = ASK_BATCH) -> DataFrame:
    """One prompt per batch of ``batch`` conversations in pool order; a
    repeated id repeats its transcript in the prompts, which is built once."""
    once = pool.select("conv_id", "title", "create_time").dropDuplicates(["conv_id"])
    t = transcripts(once, msgs.join(once.select("conv_id"), "conv_id", "left_semi"))
    j = pool.select("conv_id", "pool_rank").join(t.select("conv_id", "markdown"), "conv_id") \
        .withColumn("batch", chunk_index(F.col("pool_rank"), batch))
    g = j.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("pool_rank", "markdown"))).alias("_b"))
    prompt = F.concat(F.array_join(F.transform("_b", lambda x: x["markdown"]), "\n"), F.lit(ASK_REQUEST + question))
    return g.select(F.concat(F.lit("ask:"), F.col("batch").cast("string")).alias("prompt_id"), "batch",
                    F.lit(ASK_SYSTEM).alias("system"), prompt.alias("prompt"))


def partial_answers(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """(batch, answer, error) per prompt; a failed batch has no answer."""
    return join_responses(prompts.select("prompt_id", "batch"), responses).select(
        "batch", F.when(F.col("error").isNull(), F.col("response")).alias("answer"), "error")


def failed_batches(partials: DataFrame) -> DataFrame:
    """Batches without an answer and why; an ask with any fails as a whole."""
    return partials.where(F.col("answer").isNull()).select("batch", "error")


def synthesis_prompts(partials: DataFrame, question: str, fan_in: int = FAN_IN, level: int = 1) -> DataFrame:
    """partials(batch, answer) -> synthesis prompts for groups of at
    most ``fan_in`` answers (one group unless there are more batches)."""
    g = partials.withColumn("group", F.floor(F.col("batch") / fan_in).cast("bigint")) \
        .groupBy("group").agg(F.array_sort(F.collect_list(F.struct("batch", "answer"))).alias("_a"))
    drafts = F.transform("_a", lambda x, i: F.concat(F.lit(DRAFT), (i + 1).cast("string"), F.lit(">\n"), x["answer"], F.lit("\n" + DRAFT_END)))
    prompt = F.concat(F.array_join(drafts, ""), F.lit(ASK_REQUEST + question))
    return g.select(F.concat(F.lit(f"synth{level}:"), F.col("group").cast("string")).alias("prompt_id"),
                    F.col("group").alias("batch"), F.size("_a").cast("bigint").alias("n_answers"),
                    F.lit(SYNTHESIS_SYSTEM).alias("system"), prompt.alias("prompt"))


def reduce_answers(partials: DataFrame, question: str, respond: Callable[[DataFrame], DataFrame], fan_in: int = FAN_IN) -> DataFrame:
    """(answer, batch_count) of all partial answers. One answer is
    the result; more are combined level by level, ``fan_in`` at a time, until
    one is left. ``respond`` turns prompts into responses (the model step).
    Each level is stored before the next; a failed prompt raises."""
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    current = materialize(partials.select("batch", "answer", "error"), "ask-partials")
    batches = current.count()
    left, level = batches, 1
    while True:
        failed = failed_batches(current).count()
        if failed:
            raise RuntimeError(f"{failed} of {left} prompts of level {level - 1} failed")
        if left <= 1:
            return current.select("answer", F.lit(batches).cast("bigint").alias("batch_count"))
        prompts = synthesis_prompts(current, question, fan_in, level)
        current = materialize(partial_answers(prompts, respond(prompts)), f"ask-level{level}")
        left, level = current.count(), level + 1


def ask_sources(pool: DataFrame) -> DataFrame:
    """The sources list: title and created date in pool order."""
    return pool.select("pool_rank", "conv_id", "title", fmt_time("create_time", DATE_FMT).alias("created"))


def answer_document_blocks(question: str, answer: DataFrame, sources: DataFrame, generated_at_long: str) -> DataFrame:
    """K11 as block rows: the header with the answer (part 0) and one line
    per source (part 1, in pool order); joined by newlines plus a final
    newline they form the document."""
    head = answer.select(
        F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("pool_rank"),
        F.concat(F.lit(ASK_TITLE + question + "\n\n" + GENERATED_LINE + generated_at_long + "_\n\n" + RULE + "\n\n"), F.col("answer"),
                 F.lit("\n\n" + RULE + "\n\n" + SOURCES + "\n")).alias("block"))
    src = sources.select(F.lit(1).alias("part"), "pool_rank",
                         F.concat(F.lit(SOURCE_OPEN), F.col("title"), F.lit(SOURCE_MID), F.col("created"), F.lit(")")).alias("block"))
    return head.unionByName(src)


def answer_file_name(category: str | None, ts_compact: str) -> str:
    """K11 name: ``<category or ask>-answer-<timestamp>.md``."""
    return f"{category or 'ask'}-answer-{ts_compact}.md"

