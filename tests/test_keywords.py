"""The join of a large taxonomy against the constant of a small one."""

import random

from pyspark.sql import functions as F

from parlance.operators import label as L


def corpus(spark, rng, n=60):
    alphabet = ["a", "b", "c", " ", "\u00e9", "\u6f22", "%", "_", "\\"]
    text = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    headers = spark.createDataFrame([(i, text(rng.randrange(6)).upper()) for i in range(n)], "conv_id long, title string")
    msgs = spark.createDataFrame([(i, p, "user", text(rng.randrange(30))) for i in range(n) for p in range(rng.randrange(7))], "conv_id long, pos long, role string, content string")
    return headers, msgs, text


def test_gram_join_matches_the_literal(spark):
    for seed in range(3):
        rng = random.Random(seed)
        headers, msgs, text = corpus(spark, rng)
        cats = [(i, f"s{i}", [text(rng.randrange(seed, 9)).upper() for _ in range(rng.randrange(5))] + ([None] if i == 3 else [])) for i in range(25)]
        cats += [(25, "other", ["a"]), (26, "none", None), (27, "empty", [])]
        df = spark.createDataFrame(cats, "cat_ord int, slug string, keywords array<string>")
        rows = [sorted(map(str, L.keyword_label(headers, msgs, df, literal_keywords=k).collect())) for k in (1000, 0)]
        assert rows[0] == rows[1] and len(rows[0]) == 60
    none = df.limit(0)
    assert {tuple(r.categories) for r in L.keyword_label(headers, msgs, none, 0).collect()} == {("other",)}
    hay = L.haystacks(headers, msgs)
    assert L.gram_matches(hay, L._keywords(none)).count() == 0


def test_large_taxonomy_stays_out_of_the_plan(spark):
    headers, msgs, _ = corpus(spark, random.Random(5), 10)
    cats = spark.range(4000).select(F.col("id").cast("int").alias("cat_ord"), F.concat(F.lit("s"), "id").alias("slug"), F.array(F.concat(F.lit("needle"), "id")).alias("keywords"))
    plan = L.keyword_label(headers, msgs, cats)._jdf.queryExecution().toString()
    assert "needle123" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_only_long_keywords_are_verified(spark, monkeypatch):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    texts = [" ".join(word(9) for _ in range(60)) for _ in range(80)]
    long = "ab" * 10
    texts[3] += f" x{long * 3}y"
    texts[5] += f" {long} {long}"
    headers = spark.createDataFrame(enumerate(texts), "conv_id long, title string")
    msgs = spark.createDataFrame([], "conv_id long, pos long, role string, content string")
    keywords = {word(rng.randrange(6, 12)) for _ in range(600)} | {long, f"{long} {long}", long * 3 + "y", "  "}
    cats = spark.createDataFrame([(i, f"s{i}", [k]) for i, k in enumerate(sorted(keywords))], "cat_ord int, slug string, keywords array<string>")
    want = sorted(map(str, L.keyword_label(headers, msgs, cats, literal_keywords=1000).collect()))
    tested = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def contains(text, keyword):
        tested.add(1)
        return keyword in text

    monkeypatch.setattr(L.F, "contains", contains)
    assert sorted(map(str, L.keyword_label(headers, msgs, cats, literal_keywords=0).collect())) == want
    assert tested.value <= 400
