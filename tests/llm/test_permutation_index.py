import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parlance.llm import permutation_index
from parlance.llm.permutation_index import InvertedFiles, leading, nearest, pivot_orders, search_block


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 0.5, 2) for i, v in rows], "vec_id bigint, embedding array<float>, rank int, score double, id int")


def brute(rows, k, every):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for q in sorted({i for i, _ in ok if i % every == 0}):
        best = {}
        for i, v in ok:
            for j, w in ok:
                if i == q and j != q and len(v) == len(w):
                    best[j] = max(best.get(j, -np.inf), float(np.cumsum(v * w)[-1]))
        out += [(q, r + 1, j, s) for r, (j, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return out


def test_footrule_from_inverted_files():
    rng = np.random.default_rng(1)
    v, pivots, prefix = rng.normal(size=(40, 8)), rng.normal(size=(12, 8)), 5
    orders = pivot_orders(v, pivots, prefix)
    files = InvertedFiles(orders, 12)

    def footrule(a, b):
        ranks = [{int(p): r for r, p in enumerate(o)} for o in (a, b)]
        return sum(abs(ranks[0].get(p, prefix) - ranks[1].get(p, prefix)) for p in range(12))

    for q in range(5):
        near = files.nearness(orders[q])
        assert [prefix * (prefix + 1) - 2 * int(x) for x in near] == [footrule(orders[q], o) for o in orders]


def test_awkward_rows_like_brute_force(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2, 3]), (1, [1.0, 2, 3]), (2, [1.0, 2, 3]), (3, None), (4, [0.0, 0, 0]), (5, [nan, 1, 1]), (6, [inf, 1, 1]), (7, [None, 1.0, 1.0]),
            (8, [1.0, 1]), (15, [2.0, 1]), (20, [0.5, 1]), (25, [7.0]), (None, [1.0, 1, 1]), (9, [-1.0, 0.5, 0.25]), (10, [0.1, 0.2, 0.3]), (10, [0.3, 0.2, 0.1]), (11, []), (12, [3.0, -1, 2]), (10, [0.1, 0.2, 0.3])]
    for options in ({"rerank": 1}, {"block_rows": 3, "query_rows": 2, "rerank": 1}):
        got = nearest(frame(spark, rows), "vec_id", "embedding", F.col("vec_id") % 5 == 0, k=4, **options)
        assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 4, 5))
    assert nearest(frame(spark, []), "vec_id", "embedding", F.col("vec_id") % 5 == 0).count() == 0
    assert nearest(frame(spark, rows[:1]), "vec_id", "embedding", F.col("vec_id") % 5 == 0).count() == 0
    assert nearest(frame(spark, rows[1:3]), "vec_id", "embedding", F.col("vec_id") % 5 == 0).count() == 0


def recall(df, **options):
    found = nearest(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, **options).collect()
    rows = sorted((r["vec_id"], r["embedding"]) for r in df.collect())
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    mine = {}
    for r in found:
        mine.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = v @ v[q]
        score[q] = -np.inf
        truth = set(ids[np.argsort(-score)[:20]].tolist())
        assert len(mine[ids[q]]) == 20
        hits, total = hits + len(truth & mine[ids[q]]), total + 20
    return hits / total


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    assert recall(df) >= 0.93
    # Small blocks rerank the same share.
    assert recall(df, block_rows=500, query_rows=50) >= 0.93


@pytest.mark.parametrize("sigma", [0.0, 0.5, 1.0])
def test_recall_over_full_blocks_with_uneven_lengths(spark, sigma):
    rng = np.random.default_rng(4)
    n = 18_000 if sigma else 9000
    v = rng.standard_normal((n, 64))
    v *= (np.exp(sigma * rng.standard_normal(n)) / np.sqrt((v ** 2).sum(axis=1)))[:, None]
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n) * 4, "embedding": list(v)}))
    assert recall(df) >= 0.9


def test_only_leading_rows_are_added_up_and_ordered(monkeypatch):
    rng = np.random.default_rng(5)
    n, k = 3000, 20
    # In whole numbers, with many ties and repeated ids.
    ids, v = rng.integers(0, 2000, n), rng.integers(-3, 4, (n, 16)).astype(float)
    v[:, 0] = 1
    pivots = v[:64] / np.sqrt((v[:64] ** 2).sum(axis=1, keepdims=True))
    orders = pivot_orders(v, pivots, 16)
    ordered, lexsort = [], np.lexsort
    monkeypatch.setattr(permutation_index.np, "lexsort", lambda keys: ordered.append(len(keys[0])) or lexsort(keys))
    found = search_block(ids, v, orders, ids[:30], v[:30], orders[:30], 64, k, 1.0)
    assert len(ordered) == 30 and max(ordered) <= 20 * k
    for i in range(30):
        best = {}
        for j, x in zip(ids, v @ v[i], strict=True):
            if j != ids[i]:
                best[j] = max(best.get(j, -np.inf), x)
        want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        assert [(j, x) for q, j, x in zip(*(f[k * i:k * (i + 1)] for f in found), strict=True)] == want
    # A score that cannot be bounded, and fewer ids than asked for, leave every row.
    assert len(leading(np.array([1.0] * 99 + [np.inf]), np.arange(100), k, 0.0)) == len(leading(rng.normal(size=100), np.arange(100) % 19, k, 0.0)) == 100
