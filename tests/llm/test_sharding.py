import math

import numpy as np
from pyspark.sql import functions as F

from parlance.llm.sharding import communication_matrix, hypergeometric, shard_sizes, shuffle_into_shards, write_shards

from .rows import TEXTS, documents


def test_matrix_has_exact_margins():
    parts = [5, 0, 100, 1, 33]
    sizes = shard_sizes(sum(parts), 4)
    assert sizes == [35, 35, 35, 34]
    for seed in range(20):
        m = np.array(communication_matrix(parts, sizes, seed))
        assert m.sum(axis=1).tolist() == parts and m.sum(axis=0).tolist() == sizes


def test_matrix_follows_the_hypergeometric_law():
    draws = np.array([communication_matrix([10, 30], [20, 20], s)[0][0] for s in range(3000)])
    assert abs(draws.mean() - 5) < 0.1 and abs(draws.var() - 10 * 0.5 * 0.5 * 30 / 39) < 0.15


def test_hypergeometric_law():
    # Against the exact law, for every branch: few and many drawn, either side the smaller one.
    rng = np.random.default_rng(1)
    for good, bad, n in [(30, 50, 8), (40, 60, 45), (60, 40, 45), (60, 40, 80), (500, 9500, 3000), (13, 5000, 4000), (0, 9, 4), (9, 0, 4), (5, 5, 10), (7, 3, 0)]:
        draws = np.array([hypergeometric(rng, good, bad, n) for _ in range(4000)])
        law = np.array([math.comb(good, k) * math.comb(bad, n - k) for k in range(min(good, n) + 1)], dtype=object)
        law = (law / math.comb(good + bad, n)).astype(float)
        seen = np.bincount(draws, minlength=len(law)) / 4000
        assert len(seen) == len(law) and abs(seen - law).sum() < 0.16, (good, bad, n)


def test_more_than_a_billion_rows():
    parts = [1000, 1_600_000_000, 0, 7_000_000_000, 10 ** 15]
    sizes = shard_sizes(sum(parts), 16)
    m = np.array(communication_matrix(parts, sizes, 3), dtype=object)
    assert m.sum(axis=1).tolist() == parts and m.sum(axis=0).tolist() == sizes
    rng = np.random.default_rng(2)
    good, bad, n = 3 * 10 ** 9, 5 * 10 ** 9, 2 * 10 ** 9
    draws = np.array([hypergeometric(rng, good, bad, n) for _ in range(4000)], dtype=float)
    total, share = good + bad, good / (good + bad)
    deviation = math.sqrt(n * share * (1 - share) * (total - n) / (total - 1))
    z = (draws - n * share) / deviation
    assert abs(z.mean()) < 0.08 and abs(z.std() - 1) < 0.06 and abs((z ** 3).mean()) < 0.25 and abs((z ** 4).mean() - 3) < 0.6


def test_every_row_once_in_exact_shards(spark):
    df = spark.range(1003).select((F.col("id") % 7).alias("shard"), F.col("id").alias("slot"), F.lit("t").alias("_row")).repartition(5)
    out = shuffle_into_shards(df, 8, seed=3, bucket_rows=20)
    rows = out.select("shard", "slot", F.col("row.slot").alias("id")).collect()
    assert sorted(r["id"] for r in rows) == list(range(1003))
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(126 if s < 3 else 125))
    # Positions are uniform: no correlation of ids with shards or slots.
    place = np.array([[r["id"], r["shard"], r["slot"]] for r in rows], float)
    assert abs(np.corrcoef(place.T)[0, 1]) < 0.1 and abs(np.corrcoef(place.T)[0, 2]) < 0.1


def test_awkward_rows_and_files(spark, tmp_path):
    out = shuffle_into_shards(documents(spark), 4)
    assert sorted(r["n"] for r in out.groupBy("shard").agg(F.count("*").alias("n")).collect()) == [3, 4, 4, 4]
    assert sorted(str(r["row"]["doc_id"]) for r in out.collect()) == sorted(str(i) for i, _ in TEXTS)
    write_shards(out, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(TEXTS)
    assert shuffle_into_shards(documents(spark, []), 4).count() == 0
    assert shuffle_into_shards(documents(spark, TEXTS[:2]), 16).count() == 2
