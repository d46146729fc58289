import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parlance.llm.queries import QUERIES
from parlance.llm.spelling import group_variants, part_hashes, word_counts

from .rows import TEXTS, documents


def brute_counts(texts, damage):
    n = Counter()
    for i, t in texts:
        for run in regex.findall("[a-zÀ-ÿ]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if damage and h % damage == 0 else run] += 1
    return n


def edits(w, letters):
    out = {w[:i] + w[i + 1:] for i in range(len(w))}
    out |= {w[:i] + c + w[j:] for i in range(len(w) + 1) for c in letters for j in (i, i + 1)}
    return out - {w}


def brute_groups(n):
    letters = set("".join(n))
    near = {w: sorted(edits(w, letters) & n.keys(), key=lambda o: (-n[o], o)) for w in n}
    form = {w: o[0] if o and n[o[0]] >= 2 * n[w] else None for w, o in near.items()}
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root)
    return out


def found(df):
    rows = df.select("word", "n", "n_near", "form", "form_n", "root").collect()
    out = {r[0]: tuple(r[1:]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_counts_with_and_without_damage(spark):
    for damage in (None, 2, 97):
        got = {r["word"]: r["n"] for r in word_counts(documents(spark), "doc_id", "text", 1, 1, damage).where("word <> ''").collect()}
        want = brute_counts(TEXTS, damage)
        assert got == {w: n for w, n in want.items() if w}
    assert word_counts(documents(spark, []), "doc_id", "text", 5, 3, 97).count() == 0


def test_random_words_match_brute_force(spark):
    rng = np.random.default_rng(5)
    words = Counter()
    for _ in range(900):
        w = "".join(rng.choice(list("abcé"), rng.integers(1, 8)))
        words[w] = int(rng.integers(3, 60)) ** 2
    words["a" * 5000] = 8
    words["a" * 5001] = 4
    words["a" * 2500 + "b" + "a" * 2500] = 2
    df = spark.createDataFrame(list(words.items()), "word string, n bigint").withColumn("key", F.lit(1))
    got = found(group_variants(df))
    small = Counter({w: n for w, n in words.items() if len(w) < 100})
    assert {w: v for w, v in got.items() if len(w) < 100} == brute_groups(small)
    assert got["a" * 5001] == (4, 2, "a" * 5000, 8, "a" * 5000)
    assert got["a" * 2500 + "b" + "a" * 2500] == (2, 2, "a" * 5000, 8, "a" * 5000)
    assert found(group_variants(df.where("n < 0"))) == {}


def test_chain_and_ties(spark):
    rows = [("aaaaa", 100), ("aaaab", 50), ("aaabb", 25), ("aabbb", 12), ("zzzzb", 9), ("zzzza", 9), ("zzzzz", 4), ("other", 3)]
    got = found(group_variants(spark.createDataFrame(rows, "word string, n bigint")))
    assert got == brute_groups(Counter(dict(rows)))
    assert got["aabbb"][2:] == ("aaabb", 25, "aaaaa") and got["zzzzz"][2] == "zzzza" and got["other"] == (3, 0, None, None, "other")


@settings(max_examples=60, deadline=None)
@given(st.text("abcß", min_size=1, max_size=9), st.data())
def test_one_edit_keeps_a_signature(word, data):
    other = data.draw(st.sampled_from(sorted(edits(word, "abcß") - {""})))
    a, b = part_hashes([word, other])
    assert (a != b).sum() <= 2
    assert any((np.delete(a, out) == np.delete(b, out)).all() for out in combinations(range(4), 2))


@pytest.mark.parametrize("sf", ["0.001"])
def test_query_matches_brute_force(spark, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    n = brute_counts([(r["doc_id"], r["text"]) for r in docs], 97)
    kept = Counter({w: k for w, k in n.items() if len(w) >= 5 and k >= 3})
    assert found(QUERIES["op12_spelling"](spark, sf_dir)) == brute_groups(kept)
    by_root = defaultdict(set)
    for w, v in brute_groups(kept).items():
        by_root[v[-1]].add(w)
    assert max(map(len, by_root.values())) > 1
