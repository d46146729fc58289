"""Rendered documents.

A category document can be as large as its category, and one category may
hold a large share of the corpus, so category documents are never
assembled in one task. They are produced as rows of blocks
``(doc, sort keys..., block)``: one header block plus one block per
conversation. ``write_documents`` range-partitions by (doc, sort keys) and
writes text parts whose concatenation in name order is the document, so a
hot category is spread over many tasks. Transcripts are written the same
way (``transcript_blocks``); the assembled form (``transcripts``) is only
used where a consumer needs the text as one value (ask prompts of three
conversations). Condensed text collects only the head and tail parts that
can reach its bounded output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import (LONG_DATE_FMT, MIDDLE_MARKER, cap_text, comma_list, fmt_time,
                                     num_text, range_label, safe_name, stars)

from parlance.functions.formats import (
    ASSISTANT_HEADING, CELL_END, CONTEXT_TITLE, CONVERSATIONS, CREATED_LINE, DATE, DEEP_DIVE, DIGEST, ENHANCED_TITLE,
    EXCHANGES, EXPORTED, FROM_USER, GENERATED, H1, H2, KEY_FACTS, KEY_FACTS_DECISIONS, KEY_FACTS_ENHANCED, MESSAGES,
    MIN_RELEVANCE, RELEVANCE, ROW_CATEGORIES, ROW_CREATED, ROW_MESSAGES, ROW_RELEVANCE, ROW_TAGS, ROW_UPDATED, RULE,
    SUMMARY, TABLE_HEAD, TABLE_RULE, TAGS, UPDATED, USER_HEADING)


HEADER_ORDER = 0
BODY_ORDER = 1


def lines(*parts) -> Column:
    """Join line columns with newlines; a part may be an array of lines."""
    cols = [F.array(F.lit(p)) if isinstance(p, str) else p for p in parts]
    return F.array_join(F.concat(*cols), "\n")


def L(*items) -> Column:
    return F.array(*[F.lit(i) if isinstance(i, str) else i for i in items])


def when_lines(cond: Column, arr: Column) -> Column:
    return F.when(cond, arr).otherwise(F.array().cast("array<string>"))


def fact_lines(facts) -> Column:
    return F.transform(facts, lambda f: F.concat(F.lit("- "), f))


# ---------------------------------------------------------------- K6 category Markdown
def category_markdown_blocks(labelled: DataFrame, cats: DataFrame, generated_at: str) -> DataFrame:
    """K6 blocks: (slug, part, relevance_score, create_time, conv_id, block)."""
    members = category_members(labelled, cats)
    body = members.select(
        "slug", F.lit(BODY_ORDER).alias("part"), "relevance_score", "create_time", "conv_id",
        lines(
            L(F.concat(F.lit(H2), F.col("title")), "", TABLE_HEAD, TABLE_RULE,
              F.concat(F.lit(ROW_CREATED), fmt_time("create_time"), F.lit(CELL_END)),
              F.concat(F.lit(ROW_UPDATED), fmt_time("update_time"), F.lit(CELL_END)),
              F.concat(F.lit(ROW_MESSAGES), F.col("message_count").cast("string"), F.lit(" ("),
                       F.col("user_messages").cast("string"), F.lit(FROM_USER)),
              F.concat(F.lit(ROW_RELEVANCE), num_text("relevance_score"), F.lit(" "), stars("relevance_score"), F.lit(CELL_END)),
              F.concat(F.lit(ROW_CATEGORIES), comma_list("categories"), F.lit(CELL_END))),
            when_lines(F.size("tags") > 0, L(F.concat(F.lit(ROW_TAGS), comma_list("tags"), F.lit(CELL_END)))),
            L(""),
            when_lines(F.col("summary") != "", L(F.concat(F.lit(SUMMARY), F.col("summary")), "")),
            when_lines(F.size("key_facts") > 0, F.concat(L(KEY_FACTS), fact_lines("key_facts"), L(""))),
            L(RULE, ""),
        ).alias("block"))
    counts = members.groupBy("slug").agg(F.count(F.lit(1)).alias("n"))
    header = counts.join(cats.select("slug", "name"), "slug").select(
        "slug", F.lit(HEADER_ORDER).alias("part"), F.lit(None).cast("double").alias("relevance_score"),
        F.lit(None).cast("double").alias("create_time"), F.lit(None).cast(members.schema["conv_id"].dataType).alias("conv_id"),
        lines(L(F.concat(F.lit(H1), F.col("name")), "", EXPORTED + generated_at,
                F.concat(F.lit(CONVERSATIONS), F.col("n").cast("string")), "", RULE, "")).alias("block"))
    return header.unionByName(body)


def category_members(labelled: DataFrame, cats: DataFrame) -> DataFrame:
    """J6 restricted to configured categories (a repeated slug repeats)."""
    ex = labelled.select("*", F.explode("categories").alias("slug"))
    return ex.join(cats.select("slug"), "slug", "left_semi")


# ---------------------------------------------------------------- K5 category JSON
def category_json_rows(labelled: DataFrame, cats: DataFrame) -> DataFrame:
    """K5: per category, the conversations array rows (state-row shape) with
    their sort keys; ``category_json_header`` gives the envelope."""
    members = category_members(labelled, cats)
    return members.select(
        "slug", "relevance_score", "create_time", "conv_id",
        F.col("conv_id").cast("string").alias("id"), "title",
        fmt_time("create_time").alias("created"), fmt_time("update_time").alias("updated"),
        "message_count", "user_messages", "categories", "tags", "summary", "key_facts")


def write_category_json(labelled: DataFrame, cats: DataFrame, path: str) -> None:
    """K5 rows under ``path/slug=<s>/``: the lines of the part files in name
    order are the conversations array, best relevance first."""
    order = [F.col("slug"), F.col("relevance_score").desc(), F.col("_time").desc(), F.col("id")]
    rows = category_json_rows(labelled, cats).withColumnRenamed("create_time", "_time").drop("conv_id")
    (rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_time").write.mode("overwrite").partitionBy("slug").json(path))


def category_json_header(labelled: DataFrame, cats: DataFrame, exported_at: str) -> DataFrame:
    members = category_members(labelled, cats)
    counts = members.groupBy("slug").agg(F.count(F.lit(1)).alias("conversation_count"))
    return counts.join(cats, "slug").select(
        F.struct("slug", "name", "description", "keywords").alias("category"),
        F.lit(exported_at).alias("exported_at"), "conversation_count")


# ---------------------------------------------------------------- K7 context package
def context_package_blocks(labelled: DataFrame, cats: DataFrame, min_rel: float, generated_at: str) -> DataFrame:
    """K7 blocks: relevance >= min_rel; a category with members but none
    over the threshold still gets a package (header with 0)."""
    members = category_members(labelled, cats)
    kept = members.where(F.col("relevance_score") >= min_rel)
    body = kept.select(
        "slug", F.lit(BODY_ORDER).alias("part"), "relevance_score", "create_time", "conv_id",
        lines(
            L(F.concat(F.lit(H2), F.col("title")), "",
              F.concat(F.lit(DATE), fmt_time("create_time"), F.lit(RELEVANCE), num_text("relevance_score"),
                       F.lit(MESSAGES), F.col("message_count").cast("string")), ""),
            when_lines(F.col("summary") != "", L(F.concat(F.lit(SUMMARY), F.col("summary")), "")),
            when_lines(F.size("key_facts") > 0, F.concat(L(KEY_FACTS_DECISIONS), fact_lines("key_facts"), L(""))),
            when_lines(F.size("tags") > 0, L(F.concat(F.lit(TAGS), comma_list("tags")), "")),
            L(RULE, ""),
        ).alias("block"))
    counts = members.groupBy("slug").agg(F.count_if(F.col("relevance_score") >= min_rel).alias("n"))
    header = counts.join(cats.select("slug", "name"), "slug").select(
        "slug", F.lit(HEADER_ORDER).alias("part"), F.lit(None).cast("double").alias("relevance_score"),
        F.lit(None).cast("double").alias("create_time"), F.lit(None).cast(members.schema["conv_id"].dataType).alias("conv_id"),
        lines(L(F.concat(F.lit(CONTEXT_TITLE), F.col("name")), "", GENERATED + generated_at,
                F.concat(F.lit(CONVERSATIONS), F.col("n").cast("string")),
                MIN_RELEVANCE + _php_float(min_rel), "", RULE, "")).alias("block"))
    return header.unionByName(body)


def _php_float(x: float) -> str:
    s = repr(float(x))
    return s[:-2] if s.endswith(".0") else s


# ---------------------------------------------------------------- K9 enhanced package
def enhanced_package_blocks(labelled: DataFrame, enhanced: DataFrame, cats: DataFrame, min_rel: float,
                            generated_at: str) -> DataFrame:
    """K9 blocks: enhanced summary / facts when non-empty, digest numbered
    from 1, deep-dive ranges shown 1-based."""
    from parlance.operators.select import with_enhanced
    members = category_members(with_enhanced(labelled, enhanced), cats)
    kept = members.where(F.col("relevance_score") >= min_rel)
    digest = F.transform(F.coalesce("message_summaries", F.array()), lambda s: F.concat(
        (s["pair_index"] + 1).cast("string"), F.lit(". "), s["one_liner"]))
    deep = F.flatten(F.transform(F.map_entries(F.coalesce("detailed_summaries", F.create_map().cast("map<string,string>"))),
                                 lambda e: F.array(F.concat(F.lit(EXCHANGES), range_label(e["key"])), F.lit(""), e["value"], F.lit(""))))
    body = kept.select(
        "slug", F.lit(BODY_ORDER).alias("part"), "relevance_score", "create_time", "conv_id",
        lines(
            L(F.concat(F.lit(H2), F.col("title")), "",
              F.concat(F.lit(DATE), fmt_time("create_time"), F.lit(UPDATED), fmt_time("update_time"),
                       F.lit(RELEVANCE), num_text("relevance_score"), F.lit(MESSAGES),
                       F.col("message_count").cast("string")), ""),
            when_lines(F.col("digest_summary") != "", L(F.concat(F.lit(SUMMARY), F.col("digest_summary")), "")),
            when_lines(F.size("digest_facts") > 0, F.concat(L(KEY_FACTS_ENHANCED), fact_lines("digest_facts"), L(""))),
            when_lines(F.size("tags") > 0, L(F.concat(F.lit(TAGS), comma_list("tags")), "")),
            when_lines(F.size(digest) > 0, F.concat(L(DIGEST, ""), digest, L(""))),
            when_lines(F.size(deep) > 0, F.concat(L(DEEP_DIVE, ""), deep)),
            L(RULE, ""),
        ).alias("block"))
    counts = members.groupBy("slug").agg(F.count_if(F.col("relevance_score") >= min_rel).alias("n"))
    header = counts.join(cats.select("slug", "name"), "slug").select(
        "slug", F.lit(HEADER_ORDER).alias("part"), F.lit(None).cast("double").alias("relevance_score"),
        F.lit(None).cast("double").alias("create_time"), F.lit(None).cast(members.schema["conv_id"].dataType).alias("conv_id"),
        lines(L(F.concat(F.lit(ENHANCED_TITLE), F.col("name")), "", GENERATED + generated_at,
                F.concat(F.lit(CONVERSATIONS), F.col("n").cast("string")),
                MIN_RELEVANCE + _php_float(min_rel), "", RULE, "")).alias("block"))
    return header.unionByName(body)


# ---------------------------------------------------------------- K10 / F3 transcripts
def message_blocks(msgs: DataFrame) -> DataFrame:
    """Per-message transcript block (role heading, time when ts > 0)."""
    heading = F.when(F.col("role") == "user", F.lit(USER_HEADING)).otherwise(F.lit(ASSISTANT_HEADING))
    return msgs.where(F.col("content") != "").select(
        "conv_id", "pos",
        lines(L(heading),
              when_lines(F.col("ts") > 0, L(F.concat(F.lit("_"), fmt_time("ts", LONG_DATE_FMT), F.lit("_")))),
              L("", F.col("content"), "", RULE, "")).alias("block"))


def transcripts(headers: DataFrame, msgs: DataFrame) -> DataFrame:
    """(conv_id, markdown) per conversation: one prompt-sized document."""
    blocks = message_blocks(msgs).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "block"))).alias("_b"))
    h = headers.select("conv_id", "title", "create_time").join(blocks, "conv_id", "left")
    head = lines(L(F.concat(F.lit(H1), F.col("title")), "",
                   F.concat(F.lit(CREATED_LINE), fmt_time("create_time", LONG_DATE_FMT), F.lit("_")), "", RULE, ""))
    body = F.transform(F.coalesce("_b", F.array()), lambda x: x["block"])
    doc = F.array_join(F.concat(F.array(head), body), "\n")
    return h.select("conv_id", doc.alias("markdown"))


def transcript_blocks(headers: DataFrame, msgs: DataFrame) -> DataFrame:
    """K10 as block rows (conv_id, part, pos, block): the heading block and
    one block per message; ``write_documents(..., doc_col="conv_id",
    order=[part, pos])`` writes one document per conversation without ever
    gathering a conversation in one task."""
    head = headers.select(
        "conv_id", F.lit(HEADER_ORDER).alias("part"), F.lit(-1).cast("bigint").alias("pos"),
        lines(L(F.concat(F.lit(H1), F.col("title")), "",
                F.concat(F.lit(CREATED_LINE), fmt_time("create_time", LONG_DATE_FMT), F.lit("_")), "", RULE, "")).alias("block"))
    body = message_blocks(msgs).select("conv_id", F.lit(BODY_ORDER).alias("part"), F.col("pos").cast("bigint").alias("pos"), "block")
    return head.unionByName(body.join(headers.select("conv_id"), "conv_id", "left_semi"))


def transcript_file_names(headers: DataFrame) -> DataFrame:
    """(conv_id, file_name): the safe title and always the id, so that no two
    conversations share a name and no join on titles is needed."""
    return headers.select("conv_id", F.concat(safe_name("title", "conv_id"), F.lit("_"), F.col("conv_id").cast("string"), F.lit(".md")).alias("file_name"))


# ---------------------------------------------------------------- F2 condensed text
def condensed_text(headers: DataFrame, msgs: DataFrame, max_chars: int = 8000) -> DataFrame:
    """'# title\\n' then '[ROLE]: text\\n' per message (each cut at 1,500
    chars + marker), joined by newlines; longer than max_chars -> 60 % head +
    marker + 35 % tail.

    Only the parts that can reach the output are collected: every part has
    at least 6 characters, so the head lies in the first ``max_chars``
    parts and the tail in the last ``max_chars``; the total length comes
    from an algebraic sum. A very long conversation therefore never has to
    be gathered whole."""
    parts = msgs.where(F.col("content") != "").select(
        "conv_id", "pos", F.concat(F.lit("["), F.upper("role"), F.lit("]: "), cap_text("content"), F.lit("\n")).alias("part"))
    k = max_chars
    # Ranks from both ends and the grouping share one shuffle by conversation.
    one = Window.partitionBy("conv_id")
    ranked = parts.withColumn("_r", F.row_number().over(one.orderBy("pos"))).withColumn("_back", F.row_number().over(one.orderBy(F.col("pos").desc())))
    g = ranked.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when((F.col("_r") <= k) | (F.col("_back") <= k), F.struct("_r", "part")))).alias("_p"),
        F.count(F.lit(1)).alias("_n"), F.sum(F.length("part")).alias("_len"))
    h = headers.select("conv_id", "title").join(g, "conv_id", "left")
    head_line = F.concat(F.lit(H1), F.col("title"), F.lit("\n"))
    p = F.coalesce("_p", F.array())
    n = F.coalesce("_n", F.lit(0))
    first_k = F.transform(F.filter(p, lambda x: x["_r"] <= k), lambda x: x["part"])
    last_k = F.transform(F.filter(p, lambda x: x["_r"] > n - k), lambda x: x["part"])
    every = F.transform(p, lambda x: x["part"])
    full_len = F.length(head_line) + n + F.coalesce("_len", F.lit(0))
    head_n, tail_n = int(max_chars * 0.6), int(max_chars * 0.35)
    head_src = F.array_join(F.concat(F.array(head_line), first_k), "\n")
    tail_src = F.when(n <= 2 * k, F.array_join(F.concat(F.array(head_line), every), "\n")).otherwise(F.array_join(last_k, "\n"))
    text = F.when(full_len <= max_chars, F.array_join(F.concat(F.array(head_line), every), "\n")).otherwise(
        F.concat(F.substring(head_src, 1, head_n), F.lit(MIDDLE_MARKER), F.substring(tail_src, -tail_n, tail_n)))
    return h.select("conv_id", text.alias("condensed"))


# ---------------------------------------------------------------- document writer
def write_documents(blocks: DataFrame, path: str, doc_col: str = "slug",
                    order: list[Column] | None = None, partitions: int | None = None) -> None:
    """Write block rows as text under ``path/<doc_col>=<value>/``; reading
    the part files in name order yields the document. Range partitioning on
    (doc, order keys) splits a large document over many tasks."""
    order = order or [F.col("part"), F.col("relevance_score").desc(), F.col("create_time").desc(), F.col("conv_id")]
    keyed = [F.col(doc_col)] + order
    df = blocks.repartitionByRange(partitions, *keyed) if partitions else blocks.repartitionByRange(*keyed)
    (df.sortWithinPartitions(*keyed).select(doc_col, "block")
     .write.mode("overwrite").partitionBy(doc_col).text(path))


def write_transcripts(blocks: DataFrame, path: str) -> None:
    """All transcripts as Parquet rows (file_name, part, pos, block), sorted;
    billions of conversations make as many rows, not as many folders."""
    order = ["file_name", "part", "pos"]
    blocks.select(*order, "block").repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def assemble(blocks: DataFrame, doc_col: str = "slug") -> DataFrame:
    """Whole documents from blocks: only for small outputs (tests, single
    documents); the ordered collect puts a document in one task."""
    g = blocks.groupBy(doc_col).agg(F.array_sort(F.collect_list(F.struct(
        "part", (-F.coalesce("relevance_score", F.lit(0.0))).alias("r"), (-F.coalesce("create_time", F.lit(0.0))).alias("t"),
        "conv_id", "block"))).alias("_b"))
    return g.select(doc_col, F.array_join(F.transform("_b", lambda x: x["block"]), "\n").alias("content"))

