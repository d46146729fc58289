import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm.queries import QUERIES
from parlance.llm.whitening import whiten

NAN, INF = float("nan"), float("inf")


def brute(vectors, k=16):
    """Per vector: deviation and whitened rows (up to sign); n, shares."""
    x = np.array([[int(np.floor(np.float64(c) * 64)) + 1000000 for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    centred = ((n * fit - s) / n).astype(float)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    keep = e > 1e-12 * max(e[0], 1e-300)
    e, u = e[keep], u[:, keep]
    every = n * x - s
    return n, (every ** 2).sum(axis=1), (every / n).astype(float) @ u / np.sqrt(e), e, e / (centred ** 2).sum() * n


def check(df, ids, vectors, k=16, distinct_values=True):
    got = sorted((tuple(r) for r in df.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()), key=lambda r: (r[0], r[1], r[4]))
    n, deviation, whitened, e, explained = brute(vectors, k)
    at = {i: j for j, i in enumerate(ids)}
    m = len(e)
    assert len(got) == len(ids) * m
    assert {r[2] for r in got} == {n} and len({r[6] for r in got}) == 1 and got[0][6] < 1e-9
    z = np.zeros((len(vectors), m))
    for i, c, _, d, value, share, _ in got:
        assert d == deviation[at[i]]
        assert abs(share / explained[c - 1] - 1) < 1e-9
        z[at[i], c - 1] = value
    if distinct_values:
        sign = np.sign((z * whitened).sum(axis=0))
        assert np.abs(z * sign - whitened).max() < 1e-8
    return z


@pytest.mark.parametrize(("d", "block"), [(1, 8), (5, 1), (20, 8), (40, 8), (40, 3)])
def test_random_vectors_of_uneven_deviation(spark, d, block):
    rng = np.random.default_rng(d)
    v = (rng.standard_normal((300, d)) * np.exp(rng.standard_normal(d)) + 100 * rng.standard_normal(d)).astype(np.float32)
    v = np.vstack([v, v[:50]])
    df = spark.createDataFrame([(i, [float(c) for c in r], 7) for i, r in enumerate(v)], "vec_id bigint, embedding array<float>, n int").repartition(5)
    check(whiten(df, "vec_id", "embedding", 16, block), range(len(v)), v)


def test_equal_deviations_and_low_rank(spark):
    # Six equal deviations, two of the dimensions twice, one constant.
    corners = np.array([[(i >> j & 1) * 2.0 for j in range(6)] for i in range(64)])
    v = np.hstack([corners, corners[:, :2], np.full((64, 1), 3.0)])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id bigint, embedding array<double>")
    for block in (1, 4):
        z = check(whiten(df, "vec_id", "embedding", 16, block), range(64), v, distinct_values=False)
        assert z.shape[1] == 6
        # The whitened lengths do not depend on the choice among equal deviations.
        assert np.allclose((z ** 2).sum(axis=1), (brute(v)[2] ** 2).sum(axis=1))


def test_many_dimensions_stop_early(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((400, 300)) * 1.1 ** -np.arange(300) * 50
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id bigint, embedding array<double>").repartition(3)
    check(whiten(df, "vec_id", "embedding", 4), range(400), v, k=4)


def test_awkward_rows(spark):
    good = [[0.5, 1.0], [2.0, -1.0], [0.25, 3.0]]
    rows = [(1, good[0]), (2, good[1]), (3, good[2]), (3, good[2]), (None, good[0]), (4, None), (5, []), (6, [1.0, None]), (7, [NAN, 1.0]), (8, [INF, 1.0]), (9, [1e300, 1.0]),
            (10, [1.0, 2.0, 3.0]), (11, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 5) for i, v in rows], "vec_id bigint, embedding array<double>, x string, component int")
    got = whiten(df, "vec_id", "embedding").collect()
    assert {r["vec_id"] for r in got} == {1, 2, 3, None, 11} and len(got) == 2 * 6
    assert {r["n"] for r in got} == {4}
    assert len({(r["component"], round(r["whitened"], 12)) for r in got if r["vec_id"] in (1, None)}) == 2
    for none in (df.where("vec_id = 1"), df.where("vec_id = 4"), df.where("false")):
        assert whiten(none, "vec_id", "embedding").count() == 0


def test_large_offsets_are_exact(spark):
    v = [[float(2 ** 40 + 3 * i * i), float(i % 5)] for i in range(200)]
    df = spark.createDataFrame(list(enumerate(v)), "vec_id bigint, embedding array<double>")
    check(whiten(df, "vec_id", "embedding"), range(200), v)
    wide = spark.createDataFrame([(i, [float(i) * 2.0 ** 45]) for i in range(9)], "vec_id bigint, embedding array<double>")
    assert {r["deviation"] for r in whiten(wide, "vec_id", "embedding").collect() if r["vec_id"] != 4} == {None}


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).collect()
    check(QUERIES["op13_whitening"](spark, sf), [r["vec_id"] for r in rows], [r["v"] for r in rows])
