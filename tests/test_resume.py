"""Resume: failed model rows stay out of state and only they are redone."""

import os
import tempfile

import pytest

from checks.stub_model import flaky_label_model, good_label_model

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
def test_rerun_redoes_only_failures(spark):
    from parlance.operators import label as L
    from parlance.plans import commands as C
    from parlance.session import scratch_path
    from parlance.sources import fixtures as X

    cats = X.categories(spark)
    export_dir = X.write_export_fixture(spark, SF, scratch_path(spark, "resume-export"))

    def run(models):
        ws = C.Workspace(spark, tempfile.mkdtemp(prefix="ws-"))
        C.parse(ws, export_dir)
        counts = []
        for m in models:
            counts.append({r["status"]: r["conversations"] for r in C.categorise(ws, cats, model=m)["counts"].collect()})
        return ws, counts

    ws_a, counts = run([flaky_label_model, good_label_model])
    first, second = counts
    failed = first.get("error", 0)
    assert failed > 0
    # second run: everything done in the first run is skipped, only failures are processed
    assert second.get("skipped", 0) == first.get("processed", 0) and second.get("processed", 0) == failed
    ws_b, _ = run([good_label_model])
    key = lambda r: (r["conv_id"], tuple(r["categories"]), tuple(r["tags"]), r["summary"], r["relevance_score"])
    assert sorted(map(key, ws_a.state().collect())) == sorted(map(key, ws_b.state().collect()))
    assert L.model_done(ws_a.state()).count() == ws_a.state().count()


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
def test_label_stream_with_model(spark):
    """T2 model branch: failed rows are not stored; a later run retries them."""
    from checks.stub_model import flaky_label_model
    from parlance.catalog import _base
    from parlance.session import scratch_path
    from parlance.sources import fixtures as X
    from parlance.sources.tables import TableStore
    from parlance.streaming import incremental as Inc

    msgs, hdrs = _base(spark, SF)
    pool = hdrs.where("message_count >= 4")
    store = TableStore(spark, scratch_path(spark, "t2-store"))
    source = scratch_path(spark, "t2-source")
    pool.write.parquet(source)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pool.schema.fields)
    Inc.label_stream(spark, source, schema, msgs, X.categories(spark), store, scratch_path(spark, "t2-ckpt"),
                     model=flaky_label_model)
    stored = {r.conv_id for r in store.read("state").collect()}
    expected = {r.conv_id for r in pool.collect() if r.conv_id % 10 != 3}
    assert stored == expected and len(stored) > 0


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
def test_model_is_asked_once_per_prompt(spark):
    from parlance.catalog import _base
    from parlance.session import scratch_path
    from parlance.sources import fixtures as X
    from parlance.sources.tables import TableStore
    from parlance.streaming import incremental as Inc

    msgs, hdrs = _base(spark, SF)
    asked = spark.sparkContext.accumulator(0)

    def model(pdf):
        asked.add(len(pdf))
        return good_label_model(pdf)

    store = TableStore(spark, scratch_path(spark, "once-store"))
    pool = hdrs.where("message_count >= 4")
    store.write("state", X.prepared(spark, SF).state.limit(0))
    source = scratch_path(spark, "once-source")
    pool.write.parquet(source)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pool.schema.fields)
    Inc.label_stream(spark, source, schema, msgs, X.categories(spark), store, scratch_path(spark, "once-ckpt"), model=model)
    assert asked.value == pool.count() == store.read("state").count()


def test_upsert_evaluates_new_rows_once(spark):
    from pyspark.sql import functions as F

    from parlance.operators.setops import upsert

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def value(k):
        seen.add(1)
        return f"new{k}"

    base = spark.createDataFrame([(1, "old1"), (2, "old2"), (None, "kept")], "conv_id long, v string")
    new = spark.range(2, 5).select(F.col("id").alias("conv_id"), value("id").alias("v"))
    assert sorted((str(r.conv_id), r.v) for r in upsert(base, new).collect()) == [("1", "old1"), ("2", "new2"), ("3", "new3"), ("4", "new4"), ("None", "kept")]
    assert seen.value == 3


def test_corrupt_export_fails_the_stream(spark):
    from parlance.session import scratch_path
    from parlance.sources.tables import TableStore
    from parlance.streaming import incremental as Inc

    source = tempfile.mkdtemp()
    with open(os.path.join(source, "a.json"), "w") as f:
        f.write('[{"id": "1", "title"')
    with pytest.raises(Exception):
        Inc.ingest_stream(spark, source, TableStore(spark, scratch_path(spark, "bad-store")), scratch_path(spark, "bad-ckpt"))


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
def test_label_stream_writes_its_own_size_and_survives_a_crash(spark):
    """A micro-batch adds its own rows to the state; one that dies is done again by the next run."""
    from parlance.catalog import _base
    from parlance.session import scratch_path
    from parlance.sources import fixtures as X
    from parlance.sources.tables import TableStore
    from parlance.streaming import incremental as Inc

    class Store(TableStore):
        dies = False

        def upsert(self, name, new, key="conv_id"):
            if self.dies:  # half a write
                os.makedirs(os.path.join(self.root, name, "delta=2"))
                raise RuntimeError("executor lost")
            return super().upsert(name, new, key)

    msgs, hdrs = _base(spark, SF)
    pool = hdrs.where("message_count >= 4")
    even, odd = pool.where("conv_id % 2 = 0"), pool.where("conv_id % 2 = 1")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pool.schema.fields)
    store, source, ckpt = Store(spark, tempfile.mkdtemp()), scratch_path(spark, "t2-own-source"), scratch_path(spark, "t2-own-ckpt")

    def run():
        Inc.label_stream(spark, source, schema, msgs, X.categories(spark), store, ckpt)

    even.coalesce(1).write.parquet(source)
    run()
    assert store.read("state").count() == even.count()
    odd.unionByName(even).coalesce(1).write.mode("append").parquet(source)
    store.dies = True
    with pytest.raises(Exception):
        run()
    assert store.read("state").count() == even.count()
    store.dies = False
    run()
    run()
    rows = store.read("state").collect()
    assert sorted(r["conv_id"] for r in rows) == sorted(r["conv_id"] for r in pool.collect())
    # Rows already labelled were not written again.
    sizes = {f: spark.read.parquet(os.path.join(store.root, "state", f)).count() for f in os.listdir(os.path.join(store.root, "state")) if f != "delta=2"}
    assert sizes == {"delta=1": even.count(), "delta=3": odd.count()}
