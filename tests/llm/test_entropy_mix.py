import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from parlance.llm import entropy_mix
from parlance.llm.entropy_mix import balance, n_words
from parlance.llm.queries import QUERIES

from .rows import TEXTS, documents


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while total:
        left = total - sum(cap * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[o] for o in names if o not in full) for s in names if s not in full}
        above = {s for s, t in share.items() if t > cap * sizes[s]}
        if not above:
            return {s: share.get(s, cap * sizes[s]) for s in names}
        full |= above
    return dict.fromkeys(names, 0.0)


def brute_rate(sizes, target, cap=3):
    """Rate by size: bisection on the multiplier."""
    if target >= cap * sum(sizes):
        return lambda s: cap
    lo, hi = -50.0, 50.0
    for _ in range(200):
        lam = (lo + hi) / 2
        if sum(s * min(cap, math.exp(min(lam * s, 50))) for s in sizes) < target:
            lo = lam
        else:
            hi = lam
    return lambda s: min(cap, math.exp(min(lo * s, 50)))


def check(got, docs):
    """Everything but which documents the hash picks."""
    sizes = defaultdict(int)
    for _, s, n in docs:
        sizes[s] += n
    targets = brute_targets(sizes)
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter(docs)
    taken = Counter()
    rates = {s: brute_rate([n for _, o, n in docs if o == s and n], targets[s]) for s in sizes if sizes[s]}
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], targets[r["source"]], rel_tol=1e-9)
        assert r["taken"] == r["copies"] * r["size"] + r["part"] and 0 <= r["taken"] <= 3 * r["size"]
        if r["size"]:
            rate = rates[r["source"]](r["size"])
            assert abs(r["rate"] - rate) < 1e-5 * max(1, rate)
            assert math.floor(rate - 1e-6) * r["size"] <= r["taken"] <= math.ceil(rate + 1e-6) * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 1.5 + 1e-8 * t
    # In part: one document of a source at most.
    assert max(Counter(r["source"] for r in got if r["part"]).values(), default=0) <= 1


def random_docs(seed, n, sources):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet(np.full(len(sources), 0.4))
    return [(i, sources[rng.choice(len(sources), p=p)], int(rng.lognormal(4, 1.5)) if rng.random() > 0.05 else 0) for i in range(n)]


def test_random_sources_match_brute_force(spark):
    for seed, sources in enumerate([["a"], ["b", "a", None, "é", "Z"], list("abcdefghijkl")]):
        docs = random_docs(seed, 600, sources)
        df = spark.createDataFrame(docs, "doc_id bigint, source string, size bigint").withColumn("target", F.lit(1)).repartition(4)
        check(balance(df, "doc_id", "source", F.col("size")).collect(), docs)


def test_reruns_agree_whatever_the_partitions(spark):
    docs = random_docs(9, 400, ["x", "y", None]) + [(7, "x", 50)] * 30
    df = spark.createDataFrame(docs, "doc_id bigint, source string, size bigint")
    runs = [sorted(map(str, balance(d, "doc_id", "source", F.col("size")).collect())) for d in (df.repartition(1), df.orderBy(F.rand(3)).repartition(7))]
    assert runs[0] == runs[1]
    other = sorted(map(str, balance(df, "doc_id", "source", F.col("size"), seed=1).collect()))
    assert runs[0] != other


def test_repeated_rows_and_hot_units(spark, monkeypatch):
    monkeypatch.setattr(entropy_mix, "UNIT_ROWS", 7)
    docs = [(1, "a", 10)] * 100 + [(i, "a", 3) for i in range(50)] + [(None, "b", 40)] * 33 + [(5, None, 1)] * 20
    df = spark.createDataFrame(docs, "doc_id bigint, source string, size bigint")
    check(balance(df, "doc_id", "source", F.col("size")).collect(), docs)


def test_extremes(spark):
    # One source far under its share (at its cap), one giant document, one source of one word.
    for docs in ([(1, "a", 1)] + [(i, "b", 100) for i in range(2, 60)], [(1, "a", 1000000), (2, "b", 1), (3, "c", 5)] + [(i, "a", 2) for i in range(4, 30)],
                 [(1, "a", 7)], [(1, "a", 0), (2, None, 0)], [(1, "a", 0), (2, "b", 9)]):
        df = spark.createDataFrame(docs, "doc_id bigint, source string, size bigint")
        check(balance(df, "doc_id", "source", F.col("size")).collect(), docs)


def test_words_and_awkward_rows(spark):
    words = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in TEXTS]
    got = balance(documents(spark), "doc_id", "source", n_words("text")).collect()
    check(got, [(i, "s", n) for i, n in words])
    assert balance(documents(spark, []), "doc_id", "source", n_words("text")).count() == 0


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(QUERIES["op11_entropy_mix"](spark, sf).collect(), docs)
