import zlib

import numpy as np
from pyspark.sql import functions as F

from parlance.llm.quality import STATISTICS, Trees, fit_quality, fit_trees, keep_good, score_quality, statistics
from parlance.llm.queries import op2_quality

from .rows import documents

SF = "/root/testdata/sf0.01"


def test_statistics_do_not_depend_on_the_block():
    texts = [b"", b"One two two.\nOne two two.\nthree|", b"  ", "été ÉTÉ 12!!".encode(), b"a " * 500, b"\n\n"]
    together = statistics(texts)
    assert together.shape == (6, len(STATISTICS)) and np.isfinite(together).all()
    for i, t in enumerate(texts):
        assert np.allclose(statistics([t])[0], together[i])
    row = dict(zip(STATISTICS, together[1], strict=True))
    assert np.isclose(row["log_words"], np.log(8)) and np.isclose(row["distinct_words"], 4 / 7) and np.isclose(row["repeated_lines"], 1 / 3) and row["repeats"] == 0
    assert statistics([]).shape == (0, len(STATISTICS))


def test_trees_fit_and_traverse():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    trees = fit_trees(x, y, trees=40, depth=3)
    got = trees.score(x)
    assert ((got > 0.5) == y).mean() > 0.98

    def one(row):
        total = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > t[node])
            total += leaf[node - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([one(r) for r in x[:50]], got[:50])


def test_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in op2_quality(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in rows.items())
    held = [(rows[x["doc_id"]]["predicted"], x["quality"]) for x in labels if rows[x["doc_id"]]["held_out"]]
    assert np.mean([p == q for p, q in held]) > 0.95 and np.mean([p == 0 for p, q in held if q == 0]) > 0.8


def test_awkward_rows_and_missing_labels(spark):
    docs = documents(spark)
    labels = docs.select("doc_id", F.lit(None).cast("int").alias("quality"), F.lit("x").alias("text"))
    trees = fit_quality(docs, labels, "doc_id", "text", "quality")
    assert {r["score"] for r in score_quality(docs, "doc_id", "text", trees).collect()} == {1 / (1 + np.exp(-trees.base))}
    assert keep_good(docs, "text", trees, 0.3).exceptAll(docs).count() == 0
    stump = Trees(np.array([[0]]), np.array([[1.5]]), np.array([[-5.0, 5.0]]), 0.0)
    kept = keep_good(docs, "text", stump, 0.5)
    assert kept.schema == docs.schema and kept.count() == score_quality(docs, "doc_id", "text", stump).where("score >= 0.5").count() > 0
    assert score_quality(documents(spark, []), "doc_id", "text", stump).count() == 0
