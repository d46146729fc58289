"""Labelling: first user messages (W3), keyword labels (J7), label
validation (P11, P12, F9), resume rules (P13, P14) and run counters (A10)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.formats import FIRST_USER_MESSAGES, KEYWORD_SCORE, MAX_TAGS
from parlance.functions.prompts import LABEL_CATEGORY, LABEL_CLOSE, LABEL_OPEN, LABEL_SYSTEM
from parlance.functions.text import clamp01
from parlance.plans.materialize import materialize

#: Keywords up to which the taxonomy is a constant of the plan.
LITERAL_KEYWORDS = 1000
#: Letters up to which a keyword of a larger one is looked up as a whole.
GRAM = 16


def first_user_messages(msgs: DataFrame, n: int = FIRST_USER_MESSAGES) -> DataFrame:
    """The first ``n`` user messages of each conversation.

    ``row_number() <= n`` lets Spark insert a partial window-group limit
    before the shuffle, so at most ``n`` rows per conversation and input
    partition cross the network."""
    w = Window.partitionBy("conv_id").orderBy("pos")
    return (
        msgs.where(F.col("role") == "user")
        .select("conv_id", "pos", "content", F.row_number().over(w).cast("bigint").alias("user_rank"))
        .where(F.col("user_rank") <= n)
    )


def haystacks(headers: DataFrame, msgs: DataFrame, n: int = FIRST_USER_MESSAGES) -> DataFrame:
    """lower(title + ' ' + first n user texts joined by ' ') per conversation."""
    firsts = first_user_messages(msgs, n).groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), " ").alias("_texts"))
    return headers.select("conv_id", "title").join(firsts, "conv_id", "left").select(
        "conv_id", F.lower(F.concat_ws(" ", "title", F.coalesce("_texts", F.lit("")))).alias("haystack"))


def _keywords(cats: DataFrame) -> DataFrame:
    """(slug, cat_ord, keyword) rows of the taxonomy, lower-cased, ``other`` left out."""
    return cats.where("slug <> 'other'").select("slug", "cat_ord", F.explode("keywords").alias("_k")).where("_k IS NOT NULL") \
        .select("slug", "cat_ord", F.lower("_k").alias("keyword"))


def _literal_matches(hay: DataFrame, rows: list) -> Column:
    """The matched slugs of a small taxonomy, given as rows: a constant that
    Spark folds into an array, tested with early exit per category."""
    per: dict[tuple, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["cat_ord"], r["slug"], r["keyword"])):
        per.setdefault((r["cat_ord"], r["slug"]), []).append(r["keyword"])
    text = json.dumps([{"slug": slug, "keywords": keywords} for (_, slug), keywords in per.items()])
    taxonomy = F.from_json(F.lit(text), "array<struct<slug: string, keywords: array<string>>>")
    return F.transform(F.filter(taxonomy, lambda c: F.exists(c["keywords"], lambda k: F.contains(F.col("haystack"), k))), lambda c: c["slug"])


def _words(text: str, q: int) -> Column:
    """The distinct words (runs without spaces) of a text. One of more than 2q
    letters is cut into overlapping parts that hold all its grams of q letters."""
    parts = lambda w: F.transform(F.sequence(F.lit(0), F.length(w) - 1, F.lit(q)), lambda i: F.substring(w, i + 1, F.lit(2 * q - 1)))
    return F.array_distinct(F.flatten(F.transform(F.split(text, " "), lambda w: F.when(F.length(w) > 2 * q, parts(w)).otherwise(F.array(w)))))


def gram_matches(hay: DataFrame, keywords: DataFrame, q: int = GRAM) -> DataFrame:
    """(conv_id, slug, cat_ord) of every category with a keyword in the
    haystack, for a taxonomy of any size.

    A keyword is looked up by its gram: the first ``q`` letters of its longest
    run without spaces, which lies within one word of a haystack. The grams of
    every distinct word meet those of the keywords in an equi-join. A keyword
    that is its own gram is found by that, with nothing to verify, and its
    category goes from the words to the conversations; a longer one is
    verified in the texts of the conversations that have its gram."""
    runs = F.split("keyword", " ")
    longest = F.aggregate(runs, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    looked_up = keywords.select("slug", "cat_ord", "keyword", F.substring(longest, 1, q).alias("gram"))
    # How long the grams are: at most q + 1 lengths.
    lengths = sorted(r["n"] for r in looked_up.select(F.length("gram").alias("n")).distinct().collect())

    def grams(n: int) -> Column:
        if n == 0:
            return F.array(F.lit(""))
        places = F.when(F.length("word") >= n, F.sequence(F.lit(1), F.length("word") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.substring(F.col("word"), i, F.lit(n)))

    if not lengths:
        return hay.sparkSession.createDataFrame([], "conv_id string, slug string, cat_ord int").withColumn("conv_id", F.col("conv_id").cast(hay.schema["conv_id"].dataType))
    held = hay.where("conv_id IS NOT NULL").select("conv_id", F.explode(_words("haystack", q)).alias("word"))
    of_words = held.select("word").distinct().select("word", F.explode(F.array_distinct(F.flatten(F.array(*[grams(n) for n in lengths])))).alias("gram"))
    whole = looked_up.where("keyword = gram").select("gram", "slug", "cat_ord").distinct()
    found = of_words.join(whole, "gram").select("word", "slug", "cat_ord").distinct().join(held, "word").select("conv_id", "slug", "cat_ord").distinct()
    part = looked_up.where("keyword <> gram")
    candidates = of_words.join(part.select("gram").distinct(), "gram").join(held, "word").select("conv_id", "gram").distinct().join(part, "gram")
    verified = candidates.join(hay, "conv_id").where(F.contains(F.col("haystack"), F.col("keyword"))).select("conv_id", "slug", "cat_ord")
    return found.unionByName(verified).distinct()


def keyword_label(headers: DataFrame, msgs: DataFrame, cats: DataFrame, literal_keywords: int = LITERAL_KEYWORDS) -> DataFrame:
    """Categories whose keyword occurs in the lower-cased haystack, in
    category order, ``other`` excluded; none -> ['other']; score 0.5.

    A taxonomy of at most ``literal_keywords`` keywords is a constant of the
    plan, matched by a JVM-side lambda without any join; a larger one never
    reaches the driver and is matched by ``gram_matches``. Both give the same
    rows."""
    hay = haystacks(headers, msgs)
    keywords = _keywords(cats)
    few = keywords.limit(literal_keywords + 1).collect()
    if len(few) <= literal_keywords:
        labelled = hay.withColumn("_matched", _literal_matches(hay, few))
    else:
        hay = materialize(hay, "haystacks")
        matched = gram_matches(hay, materialize(keywords, "keywords")).groupBy("conv_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("cat_ord", "slug"))), lambda x: x["slug"]).alias("_matched"))
        labelled = hay.select("conv_id").join(matched, "conv_id", "left")
    return labelled.select(
        "conv_id",
        F.when(F.size("_matched") > 0, F.col("_matched")).otherwise(F.array(F.lit("other"))).alias("categories"),
        F.lit(KEYWORD_SCORE).alias("relevance_score"),
    )


def keep_valid(df: DataFrame, cats: DataFrame, key: list[str], column: str = "categories", always: tuple[str, ...] = ()) -> DataFrame:
    """P11 as a join with the category table (no bound on its rows): per
    ``key``, the slugs of the array ``column`` that are configured or in
    ``always``, order kept, repeats removed; possibly empty. ``key`` must be
    unique in ``df``."""
    slugs = cats.select(F.col("slug").alias("_slug"))
    for s in always:
        slugs = slugs.unionByName(df.sparkSession.range(1).select(F.lit(s).alias("_slug")))
    others = [c for c in df.columns if c not in (*key, column)]
    each = df.select(*key, F.struct(*others).alias("_row"), F.posexplode_outer(column).alias("_pos", "_slug"))
    marked = each.join(slugs.distinct().withColumn("_known", F.lit(True)), "_slug", "left")
    g = marked.groupBy(*key).agg(F.first("_row").alias("_row"), F.array_sort(F.collect_list(F.when(F.col("_known"), F.struct("_pos", "_slug")))).alias("_kept"))
    return g.select(*key, "_row.*", F.array_distinct(F.transform("_kept", lambda x: x["_slug"])).alias(column))


def cap_tags(tags: Column, n: int = MAX_TAGS) -> Column:
    """P12."""
    return F.slice(tags, 1, n)


def model_done(state: DataFrame) -> DataFrame:
    """Rows labelled by the model: summary or tags non-empty."""
    return state.where((F.coalesce(F.col("summary"), F.lit("")) != "") | (F.size(F.coalesce("tags", F.array())) > 0))


def worklist(candidates: DataFrame, done: DataFrame, key: str = "conv_id") -> DataFrame:
    """Candidates not yet done (anti-join, placed before text is read)."""
    return candidates.join(done.select(key), key, "left_anti")


def cached(candidates: DataFrame, done: DataFrame, key: str = "conv_id") -> DataFrame:
    """Candidates already done (semi-join)."""
    return candidates.join(done.select(key), key, "left_semi")


def run_status(candidates: DataFrame, state: DataFrame, ok: DataFrame, using_model: bool = True) -> DataFrame:
    """A10: status per candidate: skipped (cached), retried (stored but not
    done, now succeeded), processed (new, succeeded) or error.

    The three tables meet in one union of flagged keys, grouped once."""
    is_done = ((F.coalesce(F.col("summary"), F.lit("")) != "") | (F.size(F.coalesce("tags", F.array())) > 0)) if using_model else F.lit(True)
    flags = lambda df, **have: df.select("conv_id", *[F.coalesce(have.get(k, F.lit(False)), F.lit(False)).alias(k) for k in ("asked", "done", "stored", "ok")])
    s = flags(candidates, asked=F.lit(True)).unionByName(flags(state, stored=F.lit(True), done=is_done)).unionByName(flags(ok, ok=F.lit(True)))
    s = s.where("conv_id IS NOT NULL").groupBy("conv_id").agg(
        F.count_if("asked").alias("_n"), *[F.max(k).alias(k) for k in ("done", "stored", "ok")])
    status = F.when(F.col("done"), "skipped").when(~F.col("ok"), "error").when(F.col("stored"), "retried").otherwise("processed")
    return s.where("_n > 0").select("conv_id", status.alias("status"))


def run_counts(status: DataFrame) -> DataFrame:
    """A10: counters per status."""
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("conversations"))


def _kind(obj: Column, path: str) -> Column:
    """JSON kind of a field: NULL when missing or JSON null."""
    k = F.schema_of_variant(F.variant_get(obj, path, "variant"))
    return F.when(k.isNull() | (k == "VOID"), F.lit(None)).otherwise(k)


def contract_types_ok(obj: Column) -> Column:
    """The label contract's list fields must be lists and the summary a
    string when present (the reference fails such a row with a type
    error, so it is retried rather than stored)."""
    lists_ok = [F.coalesce(_kind(obj, f"$.{f}").startswith("ARRAY"), F.lit(True)) for f in ("categories", "tags", "key_facts")]
    summary_ok = F.coalesce(_kind(obj, "$.summary") == "STRING", F.lit(True))
    out = summary_ok
    for c in lists_ok:
        out = out & c
    return out


def float_value(obj: Column, path: str) -> Column:
    """the field as the reference's float cast gives it: a number as it
    is, a text by its leading number (0 without one), true 1, a non-empty
    list or object 1; null when missing."""
    kind = _kind(obj, path)
    text = F.try_variant_get(obj, path, "string")
    leading = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return (F.when(kind == "STRING", F.coalesce(F.nullif(leading, F.lit("")).try_cast("double"), F.lit(0.0)))
            .when(kind == "BOOLEAN", F.try_variant_get(obj, path, "boolean").cast("int").cast("double"))
            .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.when(kind.isin("ARRAY<VOID>", "OBJECT<>"), 0.0).otherwise(1.0))
            .otherwise(F.try_variant_get(obj, path, "double")))


def apply_label_fields(obj: Column) -> dict[str, Column]:
    """M2 field contract over a parsed response variant (slugs not yet checked)."""
    from parlance.functions.json import vget
    return {
        "categories": F.coalesce(vget(obj, "$.categories", "array<string>"), F.array().cast("array<string>")),
        "tags": cap_tags(F.coalesce(vget(obj, "$.tags", "array<string>"), F.array().cast("array<string>"))),
        "summary": F.coalesce(vget(obj, "$.summary", "string"), F.lit("")),
        "key_facts": F.coalesce(vget(obj, "$.key_facts", "array<string>"), F.array().cast("array<string>")),
        "relevance_score": clamp01(float_value(obj, "$.relevance_score")),
    }


# ---------------------------------------------------------------- M1, M2
def label_system(cats: DataFrame) -> str:
    """The system prompt lists every category, so the table is as long as a prompt may be."""
    rows = cats.orderBy("cat_ord").select("slug", "description").collect()
    return LABEL_SYSTEM + "".join(LABEL_CATEGORY.format(slug=r["slug"], description=r["description"]) for r in rows)


def label_prompts(headers: DataFrame, msgs: DataFrame, cats: DataFrame, max_chars: int = 8000) -> DataFrame:
    """M1: one prompt per conversation: condensed text (F2) within a
    ``max_chars`` budget, the category list in the system prompt."""
    from parlance.operators.render import condensed_text
    text = condensed_text(headers, msgs, max_chars)
    prompt = F.concat(F.lit(LABEL_OPEN), F.col("condensed"), F.lit(LABEL_CLOSE))
    return text.select(F.concat(F.lit("label:"), F.col("conv_id").cast("string")).alias("prompt_id"), "conv_id",
                       F.lit(label_system(cats)).alias("system"), prompt.alias("prompt"))


def apply_label_responses(prompts: DataFrame, responses: DataFrame, cats: DataFrame) -> DataFrame:
    """M2: (conv_id, status, labels...). Failed rows (no JSON object, bad
    JSON, service error) get status 'error' and no labels, so they stay out
    of the state table and are retried next run."""
    from parlance.operators.generate import join_responses, parsed_json
    j = join_responses(prompts.select("prompt_id", "conv_id"), responses)

    # Bind the parsed object once with a lambda: every check and field then
    # reads the bound value, so a filter on ``status`` that Catalyst pushes
    # below this projection does not repeat the extraction per reference.
    def pack(o):
        fields = apply_label_fields(o)
        return F.struct((o.isNotNull() & contract_types_ok(o)).alias("ok"), *[c.alias(k) for k, c in fields.items()])

    j = j.withColumn("_p", F.transform(F.array(parsed_json("response")), pack)[0])
    ok = F.col("_p.ok") & F.col("error").isNull()
    names = ["categories", "tags", "summary", "key_facts", "relevance_score"]
    rows = j.select("conv_id", F.when(ok, "ok").otherwise("error").alias("status"), *[F.when(ok, F.col(f"_p.{k}")).alias(k) for k in names])
    checked = keep_valid(rows, cats, ["conv_id"])
    slugs = F.when(F.size("categories") > 0, F.col("categories")).otherwise(F.array(F.lit("other")))
    return checked.select("conv_id", "status", F.when(F.col("status") == "ok", slugs).alias("categories"), *names[1:])
