import corpus_pipeline
from parlance.llm.queries import QUERIES, TOXIC_FROM, QUALITY_FROM
from parlance.llm.quality import fit_quality, score_quality
from parlance.llm.tables import table, written
from parlance.llm.toxicity import fit_toxicity, score_toxicity

from .rows import documents
from .test_decontaminate import brute as hits
from .test_near_dup import shingles

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_stages_like_brute_force(spark):
    labels, bench = table(spark, SF, "labels"), [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    docs = table(spark, SF, "documents")
    step = dict(corpus_pipeline.STAGES)

    clean = written(step["toxicity"](spark, docs, SF), "t1")
    scores = score_toxicity(docs, "doc_id", "text", fit_toxicity(docs, labels, "doc_id", "text", "toxic")).where(f"score < {TOXIC_FROM}")
    assert rows(clean) == rows(docs.join(scores.select("doc_id"), "doc_id").select(docs.columns)) and clean.count() < docs.count()

    good = written(step["quality classifier"](spark, clean, SF), "t2")
    scores = score_quality(clean, "doc_id", "text", fit_quality(clean, labels, "doc_id", "text", "quality")).where(f"score >= {QUALITY_FROM}")
    assert rows(good) == rows(clean.join(scores.select("doc_id"), "doc_id").select(docs.columns)) and good.count() < clean.count()

    single = written(step["MinHash near-dedup"](spark, good, SF), "t3")
    before = {r["doc_id"]: r for r in good.collect()}
    sets = {i: shingles(r["text"]) for i, r in before.items()}
    root = {i: i for i in sets}
    for _ in range(3):
        for i in sets:
            for j in sets:
                if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    assert rows(single) == sorted(tuple(before[i]) for i in sets if root[i] == i) and single.count() < good.count()

    cut = written(step["benchmark decontamination"](spark, single, SF), "t4")
    assert cut.columns == docs.columns
    old = {r["doc_id"]: r["text"] for r in single.collect()}
    new = {r["doc_id"]: r["text"] for r in cut.collect()}
    for i, text in old.items():
        hit = hits(text, bench, 10)[1]
        assert (new.get(i) == text) == (not hit)
        assert not hit or i not in new or not hits(new[i], bench, 10)[1]
    assert any(new.get(i) != t for i, t in old.items())

    tokens = written(step["byte-level BPE encoding and decoding"](spark, cut, SF), "t5")
    assert sorted(r["doc_id"] for r in tokens.collect()) == sorted(new) and all(len(r["ids"]) == r["n_tokens"] for r in tokens.collect())


def test_run_and_awkward_rows(spark, tmp_path):
    for name in ("labels", "benchmark"):
        table(spark, SF, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    empty = tmp_path / "empty"
    for name in ("labels", "benchmark"):
        table(spark, SF, name).limit(0).write.parquet(str(empty / f"{name}.parquet"))
    documents(spark, []).write.parquet(str(empty / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries().keys()
    assert "pipeline" in names and set(QUERIES) <= set(names) and len({n.split("_")[0] for n in QUERIES}) == 13
