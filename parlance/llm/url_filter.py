"""URL filter: explicit rules, then a character language-model ratio.

Rules name a host and a path prefix. A rule fits its host and all
subdomains, if the url's path starts with its path; the longest rule wins.

Urls without a rule are judged by two smoothed variable-order Markov models
over the characters of host and path, one learned from the accepted and one
from the rejected urls (those that a rule allows or blocks). A model
interpolates the orders 0 to ``order`` by Witten-Bell weights: a context seen
often with few successors trusts its own counts, an unseen one falls back to
the next shorter. The score is the difference of the two log likelihoods per
character; it is cut at the value that best separates a held-out fifth of
the ruled urls.

All of it is DataFrame code: every url position becomes one row holding its
longest gram; grams are counted per class, scored once per distinct gram and
joined back. Counts cover all ruled urls and grow with them. A hot host only
adds to counts that are summed before the shuffle.

Nulls and urls without ``://`` have an empty host and path; they are scored
by the end mark alone. Without ruled urls of either class the models say
nothing: the score is 0 and the verdict allow. Repeated rows count as often
as they occur. Equal scores get equal verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.tables import written

#: Marks before the first and after the last character; not valid in urls.
BEGIN, END = "\u0002", "\u0003"
ORDER = 4
#: Scores are compared in steps of 1 / STEPS for the calibration.
STEPS = 200
LIMIT = 5
#: Grams of one and two characters up to which their counts are broadcast (some 10 MB).
BROADCAST_GRAMS = 200_000
#: Size of the alphabet of the order below 0, where all characters are alike.
ALPHABET = 256


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Add ``rule`` and ``decision`` of the longest fitting (host, path,
    decision) rule to rows with ``host`` and ``path``; null where none fits."""
    rule = decision = F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule = F.when(fits, host + path).otherwise(rule)
        decision = F.when(fits, what).otherwise(decision)
    return df.withColumns({"rule": rule, "decision": decision})


def grams_of(text: Column, order: int) -> Column:
    """Of every character and the end mark: it and the ``order`` characters before it."""
    padded = F.concat(F.lit(BEGIN * order), text, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(order + 1)))


def gram_scores(training: DataFrame, grams: DataFrame, order: int = ORDER) -> DataFrame:
    """``training``: gram, good (bool), n. ``grams``: gram, distinct. Returns
    gram and ``ratio``: log P(last character | rest), accepted minus rejected."""
    def per_class(n):
        return (F.sum(F.when(F.col("good"), n).otherwise(0)).cast("double"), F.sum(F.when(F.col("good"), 0).otherwise(n)).cast("double"))

    # Every suffix of a gram is one observation of a lower order.
    suffixes = F.transform(F.sequence(F.lit(0), F.lit(order)), lambda k: F.struct(k.alias("k"), F.substring("gram", order - k + 1, k + 1).alias("hc")))
    seen = training.select("good", "n", F.inline(suffixes)).groupBy("k", "hc").agg(*(c.alias(a) for c, a in zip(per_class(F.col("n")), ("g", "b"), strict=True)))
    contexts = seen.groupBy("k", F.expr("substring(hc, 1, k)").alias("h")).agg(
        F.sum("g").alias("hg"), F.sum("b").alias("hb"),
        F.sum((F.col("g") > 0).cast("double")).alias("tg"), F.sum((F.col("b") > 0).cast("double")).alias("tb"))
    seen, contexts = written(seen, "url-seen"), written(contexts, "url-contexts")
    asked = grams.select("gram", F.inline(suffixes)).withColumn("h", F.expr("substring(hc, 1, k)"))
    # All grams share the empty context and most share one of a few characters: the lowest orders
    # are broadcast, where no key can be hot, if the characters of the urls are few enough.
    short = F.col("k") <= 1
    small = seen.where(short).limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS

    def joined(asked: DataFrame, mark) -> DataFrame:
        return asked.join(mark(seen), ["k", "hc"], "left").join(mark(contexts), ["k", "h"], "left")

    looked_up = joined(asked.where(~short), lambda t: t.where(~short)).unionByName(
        joined(asked.where(short), lambda t: F.broadcast(t.where(short)) if small else t.where(short)))
    levels = (
        looked_up.groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("k", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("g", "b", "hg", "hb", "tg", "tb"))))).alias("levels"))
    )

    def probability(n, total, kinds):
        return F.aggregate(
            "levels", F.lit(1.0 / ALPHABET),
            lambda p, x: F.when(x[total] > 0, (x[n] + x[kinds] * p) / (x[total] + x[kinds])).otherwise(p))

    return levels.select("gram", (F.log(probability("g", "hg", "tg")) - F.log(probability("b", "hb", "tb"))).alias("ratio"))


def judge_urls(pages: DataFrame, id_col: str, url_col: str, rules: list[tuple[str, str, str]], order: int = ORDER) -> DataFrame:
    """Per row: ``id_col``, ``host``, ``path``, ``rule``, ``verdict``, ``score`` and ``threshold``."""
    urls = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"))
    urls = urls.select("_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    urls = with_rule(urls, rules).withColumn("text", F.concat("host", "path"))
    # Equal texts have equal scores: they are counted, scored and joined once.
    texts = urls.groupBy("text").agg(F.max("decision").alias("decision"), F.count(F.lit(1)).alias("n"))
    texts = texts.withColumn("held_out", F.crc32(F.col("text").cast("binary")) % 5 == 0)
    rows = written(texts.select("text", "decision", "n", "held_out", F.explode(grams_of(F.col("text"), order)).alias("gram")), "url-grams")
    training = rows.where(F.col("decision").isNotNull() & ~F.col("held_out")).groupBy("gram", (F.col("decision") == "allow").alias("good")).agg(F.sum("n").alias("n"))
    ratios = gram_scores(training, rows.select("gram").distinct(), order)
    scored = written(
        rows.join(ratios, "gram").groupBy("text", "decision", "n", "held_out").agg(F.round(F.avg("ratio"), 9).alias("score")), "url-scores")

    threshold = calibrate(scored)
    verdict = F.coalesce("decision", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return (
        urls.join(scored.select("text", "score"), "text", "left")
        .select(F.col("_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score", F.lit(threshold).alias("threshold"))
    )


def calibrate(scored: DataFrame) -> float:
    """The step value with the highest mean of the rates of held-out allowed
    urls at or above it and blocked ones below it; the smallest among equals, and 0 if a
    class is missing. At most 2 * LIMIT * STEPS + 1 bins come to the driver."""
    step = F.greatest(F.lit(-LIMIT * STEPS), F.least(F.lit(LIMIT * STEPS), F.floor(F.col("score") * STEPS)))
    bins = scored.where("held_out AND decision IS NOT NULL").groupBy(step.alias("step")).agg(
        F.sum(F.when(F.col("decision") == "allow", F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("decision") == "allow", 0).otherwise(F.col("n"))).alias("bad"))
    rows = sorted((int(r["step"]), r["good"], r["bad"]) for r in bins.collect())
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not bad:
        return 0.0
    best, at, below_good, below_bad = -1.0, 0, 0, 0
    for step_, g, b in rows:
        rate = (good - below_good) / good + below_bad / bad
        if rate > best + 1e-12:
            best, at = rate, step_
        below_good, below_bad = below_good + g, below_bad + b
    return at / STEPS
