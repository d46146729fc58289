"""Inputs derived from the driver's tables (see FIXTURES.md section 3).

The driver's ``conversations`` table (conv_id, turn, role, text) stands in
for an already-ingested export. Everything here is a lazy DataFrame whose
size grows with that table; the DuckDB oracle repeats the same derivation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions.text import php_trim, fmt_time

# Fixed values of the fixture derivation.
BASE_EPOCH = 1704067200  # 2024-01-01 00:00:00 UTC
CONV_STEP = 3600         # seconds between conversation starts
TURN_STEP = 60           # seconds between turns
FILE_CONVERSATIONS = 100  # conversations of one export file, at most

# Inline category table used by the labelling queries:
# (slug, name, description, keywords)
CATEGORY_ROWS = [
    ("english", "English", "Conversations held in English", [" the ", " and "]),
    ("german", "German", "Conversations held in German", [" und ", " der ", "ß"]),
    ("french", "French", "Conversations held in French", [" les ", " la "]),
    ("spanish", "Spanish", "Conversations held in Spanish", [" los ", " que ", "ñ", "ción"]),
    ("licensing", "Licensing", "Software licence questions", ["license"]),
    ("other", "Other", "Anything that fits nowhere else", []),
]

CATEGORY_SCHEMA = T.StructType([
    T.StructField("slug", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("keywords", T.ArrayType(T.StringType(), False), False),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def categories(spark: SparkSession) -> DataFrame:
    """The category dimension with its order column ``cat_ord``."""
    rows = [(i, s, n, d, k) for i, (s, n, d, k) in enumerate(CATEGORY_ROWS)]
    schema = T.StructType([T.StructField("cat_ord", T.IntegerType(), False)] + CATEGORY_SCHEMA.fields)
    return spark.createDataFrame(rows, schema)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """messages(conv_id, pos, role, content, ts): chat roles, non-empty text."""
    conv = table(spark, sf_dir, "conversations")
    content = php_trim("text")
    return (
        conv.where(F.col("role").isin("user", "assistant") & (content != ""))
        .select(
            "conv_id",
            F.col("turn").alias("pos"),
            "role",
            content.alias("content"),
            (F.lit(BASE_EPOCH) + F.col("conv_id") * CONV_STEP + F.col("turn") * TURN_STEP).cast("double").alias("ts"),
        )
    )


def headers(spark: SparkSession, sf_dir: str, msgs: DataFrame | None = None) -> DataFrame:
    """headers(conv_id, title, create_time, update_time, message_count,
    user_messages) for conversations with at least two kept messages (P3)."""
    from parlance.operators.stats import message_counts

    msgs = msgs if msgs is not None else messages(spark, sf_dir)
    counts = message_counts(msgs, min_messages=2, with_update_time=True)
    return counts.select(
        "conv_id",
        F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("title"),
        (F.lit(BASE_EPOCH) + F.col("conv_id") * CONV_STEP).cast("double").alias("create_time"),
        "update_time",
        "message_count",
        "user_messages",
    )


def state(spark: SparkSession, sf_dir: str, hdrs: DataFrame | None = None,
          msgs: DataFrame | None = None) -> DataFrame:
    """Categorisation state rows for ``conv_id % 4 <> 0``.

    Categories come from keyword labelling; relevance is
    ((conv_id * 37) % 101) / 100; summary, tags and key facts are empty when
    ``conv_id % 5 = 0`` (the retry case of the resume rule).
    """
    from parlance.operators.label import keyword_label

    msgs = msgs if msgs is not None else messages(spark, sf_dir)
    hdrs = hdrs if hdrs is not None else headers(spark, sf_dir, msgs)
    hdrs = hdrs.where(F.col("conv_id") % 4 != 0)
    labels = keyword_label(hdrs, msgs, categories(spark)).select("conv_id", "categories")
    empty = F.col("conv_id") % 5 == 0
    cid = F.col("conv_id").cast("string")
    no_strings = F.array().cast("array<string>")
    return hdrs.join(labels, "conv_id").select(
        "conv_id",
        "title",
        fmt_time("create_time").alias("created"),
        fmt_time("update_time").alias("updated"),
        "message_count",
        "user_messages",
        "categories",
        F.when(empty, no_strings).otherwise(
            F.array(F.concat(F.lit("topic-"), (F.col("conv_id") % 7).cast("string")),
                    F.concat(F.lit("size-"), F.col("message_count").cast("string")))).alias("tags"),
        F.when(empty, F.lit("")).otherwise(F.concat(F.lit("Summary of conversation "), cid)).alias("summary"),
        F.when(empty, no_strings)
        .when(F.col("conv_id") % 2 == 0, F.array(F.concat(F.lit("First fact of "), cid), F.concat(F.lit("Second fact of "), cid)))
        .otherwise(F.array(F.concat(F.lit("First fact of "), cid))).alias("key_facts"),
        ((F.col("conv_id") * 37) % 101 / F.lit(100.0)).alias("relevance_score"),
    )


# ------------------------------------------------------------------ responders
# Deterministic stand-ins for the model, built from prompt keys only, so the
# response tables are derived from the data (FIXTURES.md section 3) and the
# DuckDB oracle can state the expected parse result independently.

def _fence(body, cond):
    return F.when(cond, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)


def label_responses(prompts: DataFrame, st: DataFrame) -> DataFrame:
    """Categorise responses built from state rows: fenced when conv_id % 3
    = 0, with a reasoning block when % 7 = 0, truncated when % 11 = 0, an
    unknown slug added when % 13 = 0, a score in words when % 19 = 0."""
    j = prompts.select("prompt_id", "conv_id").join(st, "conv_id")
    cats = F.when(F.col("conv_id") % 13 == 0, F.concat("categories", F.array(F.lit("made-up-slug")))).otherwise(F.col("categories"))
    body = F.to_json(F.struct(cats.alias("categories"), F.col("tags"), F.col("summary"),
                              F.col("key_facts"), F.col("relevance_score")))
    body = F.when(F.col("conv_id") % 19 == 0, F.regexp_replace(body, r'"relevance_score":[^}]*', '"relevance_score":"high"')).otherwise(body)
    body = F.when(F.col("conv_id") % 11 == 0, F.substring(body, 1, 25)).otherwise(body)
    body = _fence(body, F.col("conv_id") % 3 == 0)
    body = F.when(F.col("conv_id") % 7 == 0, F.concat(F.lit("<think>\nweighing {the} options\n</think>\n"), body)).otherwise(body)
    return j.select("prompt_id", body.alias("response"), F.lit(None).cast("string").alias("error"))


def pair_responses(prompts: DataFrame) -> DataFrame:
    """Pass-1 responses per (conversation, chunk): one-liners for pairs with
    (conv_id + i) % 4 <> 0; a revised repeat of the chunk's first pair when
    conv_id % 6 = 0; a negative index when % 7 = 0; fenced when % 3 = 0;
    chunk 0 truncated (a failed conversation) when % 9 = 0; later chunks
    numbered from 0 again when % 10 = 3, as models do."""
    cid = F.col("conv_id")
    shift = F.when(cid % 10 == 3, F.col("chunk") * 3).otherwise(0)
    item = lambda i, text: F.concat(F.lit('{"pair_index": '), F.when(i < 0, i).otherwise(i - shift).cast("string"), F.lit(', "one_liner": "'), text, F.lit('"}'))
    kept = F.filter("pair_indices", lambda i: (cid + i) % 4 != 0)
    items = F.transform(kept, lambda i: item(i, F.concat(F.lit("Exchange "), i.cast("string"), F.lit(" of conversation "), cid.cast("string"))))
    first = F.col("pair_indices")[0]
    items = F.when(cid % 6 == 0, F.concat(items, F.array(item(first, F.concat(F.lit("Revised exchange "), first.cast("string"), F.lit(" of conversation "), cid.cast("string")))))).otherwise(items)
    items = F.when(cid % 7 == 0, F.concat(items, F.array(item(F.lit(-1), F.lit("stray"))))).otherwise(items)
    body = F.concat(F.lit('{"summaries": ['), F.array_join(items, ", "), F.lit("]}"))
    body = F.when((cid % 9 == 0) & (F.col("chunk") == 0), F.lit('{"summaries": [{"pair_index": 0, "one_li')).otherwise(body)
    return prompts.select("prompt_id", _fence(body, cid % 3 == 0).alias("response"), F.lit(None).cast("string").alias("error"))


def flag_responses(prompts: DataFrame, hdrs: DataFrame) -> DataFrame:
    """Pass-2 responses: [0,1]; from 1 to the number of messages, past the
    last exchange, when conv_id is even;
    [2,0] (reversed) when % 5 = 0; a string start (invalid) when % 7 = 0;
    a repeated [0,1] when % 10 = 0; a reasoning block when % 4 = 1;
    unparseable when % 17 = 0."""
    cid = F.col("conv_id")
    rng = lambda s, e: F.concat(F.lit('{"start": ' + s + ', "end": '), F.lit(e) if isinstance(e, str) else e.cast("string"), F.lit("}"))
    prompts = prompts.select("prompt_id", "conv_id").join(hdrs.select("conv_id", "message_count"), "conv_id")
    parts = F.array(rng("0", "1"))
    parts = F.when(cid % 2 == 0, F.concat(parts, F.array(rng("1", F.col("message_count"))))).otherwise(parts)
    parts = F.when(cid % 5 == 0, F.concat(parts, F.array(rng("2", "0")))).otherwise(parts)
    parts = F.when(cid % 7 == 0, F.concat(parts, F.array(rng('"2"', "3")))).otherwise(parts)
    parts = F.when(cid % 10 == 0, F.concat(parts, F.array(rng("0", "1")))).otherwise(parts)
    body = F.concat(F.lit('{"flagged": ['), F.array_join(parts, ", "), F.lit('], "reasoning": "dense {parts}"}'))
    body = F.when(cid % 4 == 1, F.concat(F.lit("<think>pick ranges</think>\n"), body)).otherwise(body)
    body = F.when(cid % 17 == 0, F.lit("no ranges today")).otherwise(body)
    return prompts.select("prompt_id", body.alias("response"), F.lit(None).cast("string").alias("error"))


def expand_responses(prompts: DataFrame) -> DataFrame:
    """Pass-3 responses: a plain paragraph naming the range and its order;
    an error row when conv_id % 8 = 3 and it is the first range."""
    cid = F.col("conv_id")
    text = F.concat(F.lit("  Notes on exchanges "), F.col("range_key"), F.lit(" (range "), F.col("range_ord").cast("string"),
                    F.lit(") of conversation "), cid.cast("string"), F.lit(".\n"))
    failed = (cid % 8 == 3) & (F.col("range_ord") == 0)
    return prompts.select("prompt_id", F.when(failed, F.lit(None)).otherwise(text).alias("response"),
                          F.when(failed, F.lit("RuntimeError: timeout")).alias("error"))


def proposal_responses(prompts: DataFrame) -> DataFrame:
    """Proposal responses: summary unchanged when conv_id % 3 = 0, else a
    padded new one; key facts unchanged when even, else a new list; empty
    tags when % 5 = 1, else a new list."""
    cid = F.col("conv_id")
    c = cid.cast("string")
    summary = F.when(cid % 3 == 0, F.concat(F.lit("Summary of conversation "), c)).otherwise(F.concat(F.lit("  Improved summary of "), c, F.lit(" ")))
    facts = F.when(cid % 2 == 0, F.array(F.concat(F.lit("First fact of "), c), F.concat(F.lit("Second fact of "), c))) \
        .otherwise(F.array(F.concat(F.lit("New fact of "), c)))
    tags = F.when(cid % 5 == 1, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("tag-"), c)))
    body = F.to_json(F.struct(summary.alias("summary"), facts.alias("key_facts"), tags.alias("tags")))
    return prompts.select("prompt_id", body.alias("response"), F.lit(None).cast("string").alias("error"))


# ------------------------------------------------------------------ prepared tables
class Prepared:
    """The stored tables a real run would already hold: messages and headers
    from ingest, state from labelling."""

    def __init__(self, msgs: DataFrame, hdrs: DataFrame, st: DataFrame):
        self.messages, self.headers, self.state = msgs, hdrs, st


_PREPARED: dict[tuple[str, str], Prepared] = {}


def prepared(spark: SparkSession, sf_dir: str) -> Prepared:
    """Derive and store messages, headers and state once per session."""
    from parlance.plans.materialize import materialize

    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _PREPARED:
        msgs = materialize(messages(spark, sf_dir), "messages")
        hdrs = materialize(headers(spark, sf_dir, msgs), "headers")
        st = materialize(state(spark, sf_dir, hdrs, msgs), "state")
        _PREPARED[key] = Prepared(msgs, hdrs, st)
    return _PREPARED[key]


def reset_prepared() -> None:
    _PREPARED.clear()


def explore_responses(batches: DataFrame) -> DataFrame:
    """Explore responses per batch from its sampled conversations
    (batch, sample_ord, conv_id, title): one suggestion per conversation,
    slug topic-<conv_id % 9>, a name except when conv_id % 9 = 4, a
    description of conv_id % 17 letters, its title as sample; even batches
    also suggest an existing slug and an empty slug; batch 3 is unusable."""
    cid = F.col("conv_id")
    topic = (cid % 9).cast("string")
    sugg = F.to_json(F.struct(
        F.concat(F.lit("topic-"), topic).alias("slug"),
        F.when(cid % 9 != 4, F.concat(F.lit("Topic "), topic)).alias("name"),
        F.repeat(F.lit("d"), (cid % 17).cast("int")).alias("description"),
        F.array(F.col("title")).alias("sample_titles")))
    g = batches.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("sample_ord", sugg.alias("s")))).alias("_s"))
    items = F.transform("_s", lambda x: x["s"])
    extra = F.array(F.lit('{"slug": "english", "name": "English again", "description": "dup", "sample_titles": []}'),
                    F.lit('{"slug": "", "name": "Nameless"}'))
    items = F.when(F.col("batch") % 2 == 0, F.concat(items, extra)).otherwise(items)
    body = F.concat(F.lit('{"suggestions": ['), F.array_join(items, ", "), F.lit("]}"))
    body = F.when(F.col("batch") == 3, F.lit("I could not decide.")).otherwise(body)
    return g.select(F.concat(F.lit("explore:"), F.col("batch").cast("string")).alias("prompt_id"), body.alias("response"),
                    F.lit(None).cast("string").alias("error"))


def ask_responses(prompts: DataFrame) -> DataFrame:
    """Partial answers: a sentence naming the batch."""
    return prompts.select("prompt_id", F.concat(F.lit("Partial answer from batch "), F.col("batch").cast("string"), F.lit(".")).alias("response"),
                          F.lit(None).cast("string").alias("error"))


def ask_responses_failing(prompts: DataFrame) -> DataFrame:
    """Partial answers of which every fifth batch fails."""
    failed = F.col("batch") % 5 == 2
    return prompts.select("prompt_id", F.when(~failed, F.lit("fine")).alias("response"), F.when(failed, F.lit("RuntimeError: timeout")).alias("error"))


def synthesis_responses(prompts: DataFrame) -> DataFrame:
    return prompts.select("prompt_id", F.concat(F.lit("Combined answer over "), F.col("n_answers").cast("string"), F.lit(" partial answers.")).alias("response"),
                          F.lit(None).cast("string").alias("error"))


# ------------------------------------------------------------------ raw export fixture
def tree_parent(turn):
    """Fixture tree edges: parent = turn - 1, except turns with turn % 3 = 2
    whose parent is turn - 2 (a sibling branch); turn 0 is the root."""
    return (F.when(turn == 0, F.lit(None))
            .when(turn % 3 == 2, turn - 2)
            .otherwise(turn - 1)).cast("string")


def tree_nodes_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree-form nodes (conv_id, node_id, map_pos, parent, children, role,
    create_time, text) for every turn of the conversations table."""
    conv = table(spark, sf_dir, "conversations")
    base = conv.select("conv_id", "turn", "role", "text", tree_parent(F.col("turn")).alias("parent"))
    kids = base.where(F.col("parent").isNotNull()).groupBy(F.col("conv_id").alias("k_conv"), F.col("parent").alias("k_node")).agg(
        F.transform(F.array_sort(F.collect_list("turn")), lambda t: t.cast("string")).alias("children"))
    j = base.join(kids, (F.col("conv_id") == F.col("k_conv")) & (F.col("turn").cast("string") == F.col("k_node")), "left")
    return j.select(
        "conv_id", F.col("turn").cast("string").alias("node_id"), F.col("turn").cast("bigint").alias("map_pos"),
        "parent", F.coalesce("children", F.array().cast("array<string>")).alias("children"),
        "role", (F.lit(BASE_EPOCH) + F.col("conv_id") * CONV_STEP + F.col("turn") * TURN_STEP).cast("double").alias("create_time"),
        "text")


def export_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_name, file_ord, json) per conversation record of the raw export
    fixture: three sets of files by conv_id % 3, each file of at most
    FILE_CONVERSATIONS, and every 10th conversation repeated at the end of a
    file of the last set with a new title."""
    nodes = tree_nodes_from_table(spark, sf_dir)
    node = F.struct(
        F.col("parent"), F.col("children"),
        F.struct(F.struct(F.col("role")).alias("author"), F.col("create_time"),
                 F.struct(F.lit("text").alias("content_type"), F.array(F.col("text")).alias("parts")).alias("content")).alias("message"))
    msgs_ok = F.col("role").isin("user", "assistant") & (php_trim("text") != "")
    per = nodes.groupBy("conv_id").agg(
        F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("map_pos", "node_id", node.alias("node")))),
                                       lambda x: F.struct(x["node_id"], x["node"]))).alias("mapping"),
        F.max(F.when(msgs_ok, F.col("create_time"))).alias("update_time"))
    rec = per.select(
        "conv_id", F.col("conv_id").cast("string").alias("id"),
        F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("title"),
        (F.lit(BASE_EPOCH) + F.col("conv_id") * CONV_STEP).cast("double").alias("create_time"),
        F.coalesce("update_time", F.lit(0.0)).alias("update_time"), "mapping")
    body = lambda title: F.to_json(F.struct("id", title.alias("title"), "create_time", "update_time", "mapping"))
    block = F.lpad(F.floor(F.col("conv_id") / (3 * FILE_CONVERSATIONS)).cast("string"), 8, "0")
    first = rec.select(F.concat(F.lit("export-"), (F.col("conv_id") % 3).cast("string"), F.lit("-"), block, F.lit(".json")).alias("file_name"),
                       F.struct(F.lit(0).alias("dup"), "conv_id").alias("file_ord"), body(F.col("title")).alias("json"))
    again = rec.where(F.col("conv_id") % 10 == 0).select(
        F.concat(F.lit("export-2-"), block, F.lit(".json")).alias("file_name"), F.struct(F.lit(1).alias("dup"), "conv_id").alias("file_ord"),
        body(F.concat(F.col("title"), F.lit(" (revised)"))).alias("json"))
    return first.unionByName(again)


def flat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, json) of the flat form: a ``messages`` array,
    string contents and ``role`` when conv_id is even, parts and
    ``author.role`` when odd; ids under ``conversation_id``."""
    conv = table(spark, sf_dir, "conversations").withColumn("ts", (F.lit(BASE_EPOCH) + F.col("conv_id") * CONV_STEP + F.col("turn") * TURN_STEP).cast("double"))
    plain = F.to_json(F.struct("role", F.col("text").alias("content"), F.col("ts").alias("timestamp")))
    parts = F.to_json(F.struct(F.struct("role").alias("author"), F.struct(F.lit("text").alias("content_type"), F.array("text").alias("parts")).alias("content"), F.col("ts").alias("create_time")))
    one = F.when(F.col("conv_id") % 2 == 0, plain).otherwise(parts)
    per = conv.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", one.alias("m")))).alias("ms"), F.max("ts").alias("update_time"))
    start = (F.lit(BASE_EPOCH) + F.col("conv_id") * CONV_STEP).cast("double")
    head = F.to_json(F.struct(F.col("conv_id").cast("string").alias("conversation_id"), F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("title"),
                              start.alias("create_time"), "update_time"))
    body = F.concat(F.expr("substring(h, 1, length(h) - 1)"), F.lit(', "messages": ['), F.array_join(F.transform("ms", lambda x: x["m"]), ", "), F.lit("]}"))
    return per.withColumn("h", head).select("conv_id", body.alias("json"))


def write_flat_export(spark: SparkSession, sf_dir: str, out_dir: str) -> str:
    """All flat records as array files flat-n.json directly under
    ``out_dir``, each of at most FILE_CONVERSATIONS records after an empty
    one."""
    recs = flat_records(spark, sf_dir).withColumn("file_name", F.concat(F.lit("flat-"), F.lpad(F.floor(F.col("conv_id") / FILE_CONVERSATIONS).cast("string"), 8, "0"), F.lit(".json")))
    files = recs.groupBy("file_name").agg(F.concat(
        F.lit("[{},\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "json"))), lambda x: x["json"]), ",\n"), F.lit("]")).alias("value"))
    return _write_named(spark, files, out_dir)


def write_export_fixture(spark: SparkSession, sf_dir: str, out_dir: str) -> str:
    """Write the raw export fixture as JSON-array files named export-k-n.json
    directly under ``out_dir`` (an export file is one unit by format)."""
    recs = export_records(spark, sf_dir)
    files = recs.groupBy("file_name").agg(
        F.concat(F.lit("[\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_ord", "json"))), lambda x: x["json"]), ",\n"),
                 F.lit("\n]")).alias("value"))
    return _write_named(spark, files, out_dir)


def _write_named(spark: SparkSession, files: DataFrame, out_dir: str) -> str:
    """Write every (file_name, value) row as the file ``out_dir/file_name``."""
    staging = out_dir.rstrip("/") + "_staging"
    files.write.mode("overwrite").partitionBy("file_name").text(staging)
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    Path = jvm.org.apache.hadoop.fs.Path
    fs = Path(staging).getFileSystem(conf)
    fs.mkdirs(Path(out_dir))
    for st in fs.listStatus(Path(staging)):
        name = st.getPath().getName()
        if not name.startswith("file_name="):
            continue
        target = name.split("=", 1)[1]
        parts = [p for p in fs.listStatus(st.getPath()) if p.getPath().getName().startswith("part-")]
        fs.rename(parts[0].getPath(), Path(out_dir.rstrip("/") + "/" + target))
    return out_dir
