"""U1 upserts, the versioned store and the category file reader."""

import os
import tempfile

import pytest

from parlance.operators.setops import upsert
from parlance.sources.tables import CategoryFileError, TableStore, read_categories


def test_upsert_idempotent(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "conv_id long, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "conv_id long, v string")
    once = sorted(upsert(base, new).collect())
    twice = sorted(upsert(upsert(base, new), new).collect())
    assert once == twice == [(1, "a"), (2, "B"), (3, "C")]


def test_store_versions(spark):
    store = TableStore(spark, tempfile.mkdtemp())
    assert store.read("t") is None
    store.write("t", spark.createDataFrame([(1, "a")], "conv_id long, v string"))
    store.upsert("t", spark.createDataFrame([(1, "z"), (2, "y")], "conv_id long, v string"))
    assert sorted(store.read("t").collect()) == [(1, "z"), (2, "y")]
    store.delete_keys("t", spark.createDataFrame([(2,)], "conv_id long"))
    assert sorted(store.read("t").collect()) == [(1, "z")]


def test_category_file(spark):
    d = tempfile.mkdtemp()
    good = os.path.join(d, "c.json")
    with open(good, "w") as f:
        f.write('[{"slug": "a", "name": "A", "keywords": ["x"]}, {"slug": "b", "name": "B"}]')
    rows = read_categories(spark, good).orderBy("cat_ord").collect()
    assert [(r.slug, r.description, list(r.keywords)) for r in rows] == [("a", "", ["x"]), ("b", "", [])]
    assert read_categories(spark, os.path.join(d, "missing.json")).count() == 0
    bad = os.path.join(d, "bad.json")
    with open(bad, "w") as f:
        f.write('[{"slug": "a", "name": "A"}, {"slug": "b"}]')
    with pytest.raises(CategoryFileError, match="#1"):
        read_categories(spark, bad)


def test_keyed_table(spark):
    """Upserts append one batch; the newest batch wins per key, compacted or not."""
    import random
    from parlance.sources.tables import KeyedTable
    rng = random.Random(11)
    root = tempfile.mkdtemp()
    t = KeyedTable(spark, os.path.join(root, "t"))
    assert t.read() is None
    expected = {}
    for rnd in range(4):
        keys = rng.sample(range(200), 40 if rnd else 120)
        expected |= {k: sorted([f"v{rnd}-{k}", f"w{rnd}-{k}"][:1 + k % 2]) for k in keys}
        t.upsert(spark.createDataFrame([(k, v) for k in keys for v in expected[k]], "conv_id long, v string"))

    def rows():
        got = {}
        for r in t.read().collect():
            got.setdefault(r.conv_id, []).append(r.v)
        return {k: sorted(v) for k, v in got.items()}

    assert rows() == expected
    assert sorted(d for d in os.listdir(os.path.join(root, "t"))) == [f"batch={i}" for i in range(1, 5)]
    # A batch without _SUCCESS is not seen.
    os.makedirs(os.path.join(root, "t", "batch=9"))
    assert rows() == expected
    t.compact()
    assert rows() == expected and os.listdir(os.path.join(root, "t")).count("batch=1") == 0


def test_store_reset_keeps_history(spark):
    """K4 reset writes an empty newest version; older versions stay readable on disk."""
    root = tempfile.mkdtemp()
    store = TableStore(spark, root)
    store.write("state", spark.createDataFrame([(1, "a")], "conv_id long, v string"))
    store.reset("state", "conv_id long, v string")
    assert store.read("state").count() == 0
    assert sorted(os.listdir(os.path.join(root, "state"))) == ["v=1", "v=2"]


def test_corrupt_side_files_read_empty(spark):
    """A corrupt index or discovery report reads as empty; missing too."""
    from parlance.sources.tables import read_discovery, read_index
    d = tempfile.mkdtemp()
    bad = os.path.join(d, "bad.json")
    with open(bad, "w") as f:
        f.write("{not json")
    assert read_index(spark, bad).count() == 0
    assert read_discovery(spark, bad).count() == 0
    assert read_index(spark, os.path.join(d, "none.json")).count() == 0
    ok = os.path.join(d, "report.json")
    with open(ok, "w") as f:
        f.write('{"discovered_categories": [{"slug": "a", "name": "A"}, {"slug": "", "name": "x"}, {"name": "y"}]}')
    rows = read_discovery(spark, ok).collect()
    assert [(r.slug, r["count"]) for r in rows] == [("a", 1)]


def test_free_mode_and_suggestion_filter(spark):
    """M5: free mode when no category exists; P15 keeps existing slugs only in free mode."""
    from parlance.operators.discover import free_mode, new_suggestions
    cats = spark.createDataFrame([(0, "english", "English", "", [])], "cat_ord int, slug string, name string, description string, keywords array<string>")
    assert free_mode(cats.limit(0)) and not free_mode(cats) and free_mode(cats, True)
    sugg = spark.createDataFrame([(0, 0, "english"), (0, 1, ""), (0, 2, "new-one")], "batch long, item_pos long, slug string")
    assert sorted(r.slug for r in new_suggestions(sugg, cats).collect()) == ["new-one"]
    assert sorted(r.slug for r in new_suggestions(sugg, cats, free=True).collect()) == ["english", "new-one"]


def test_crashed_writes_never_block_the_table(spark):
    """Folders without _SUCCESS are neither read nor in the way; numbers go past them."""
    from parlance.sources.tables import KeyedTable
    root = tempfile.mkdtemp()
    store = TableStore(spark, root)
    rows = lambda *r: spark.createDataFrame(list(r), "conv_id long, v string")
    store.write("t", rows((1, "a"), (2, "b")))
    for left in ("v=2", "delta=3"):
        os.makedirs(os.path.join(root, "t", left))
    assert sorted(store.read("t").collect()) == [(1, "a"), (2, "b")]
    store.write("t", rows((1, "c"), (2, "b")))
    store.upsert("t", rows((2, "d"), (3, "e")))
    # A list of replaced rows whose rows were never finished counts for nothing.
    rows((1, "x")).selectExpr("conv_id", "4 AS _n").write.parquet(os.path.join(root, "t.replaced", "delta=9"))
    os.makedirs(os.path.join(root, "t", "delta=9"))
    assert sorted(store.read("t").collect()) == [(1, "c"), (2, "d"), (3, "e")]
    store.upsert("t", rows((1, "f")))
    assert sorted(store.read("t").collect()) == [(1, "f"), (2, "d"), (3, "e")]
    t = KeyedTable(spark, os.path.join(root, "k"))
    os.makedirs(os.path.join(root, "k", "batch=1"))
    t.upsert(rows((1, "a")))
    t.upsert(rows((1, "b"), (2, "c")))
    assert sorted(t.read().collect()) == [(1, "b"), (2, "c")]


def test_keyed_table_keeps_null_keys_and_columns(spark):
    store = TableStore(spark, tempfile.mkdtemp())
    store.write("t", spark.createDataFrame([(1, "a", 5), (None, "n", 6)], "conv_id long, v string, w int"))
    store.upsert("t", spark.createDataFrame([("z", 1), (None, None)], "v string, conv_id long"))
    assert sorted(map(str, store.read("t").select("conv_id", "v", "w").collect())) == sorted(map(str, [
        spark.createDataFrame([r], "conv_id long, v string, w int").first() for r in ((1, "z", None), (None, "n", 6), (None, None, None))]))
    # A new column: the table is written whole.
    store.upsert("t", spark.createDataFrame([(1, "y", 2.5)], "conv_id long, v string, extra double"))
    assert {(r.conv_id, r.v, r.extra) for r in store.read("t").collect()} == {(1, "y", 2.5), (None, "n", None), (None, None, None)}
    store.delete_keys("t", spark.createDataFrame([(1,), (7,)], "conv_id long"))
    assert store.read("t").where("conv_id = 1").count() == 0 and store.read("t").count() == 2
    store.compact("t", keep_seconds=3600)
    assert store.read("t").count() == 2


def test_small_updates_shuffle_no_large_table(spark):
    """An upsert of ten rows, and a read after it, leave the table's rows where they are."""
    from parlance.sources.tables import KeyedTable
    root = tempfile.mkdtemp()
    t = KeyedTable(spark, os.path.join(root, "t"))
    t.upsert(spark.range(5000).selectExpr("id AS conv_id", "repeat('text ', 50) AS content"))
    t.upsert(spark.range(10).selectExpr("id * 7 AS conv_id", "'new' AS content"))
    read = t.read()
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert read.count() == 5000 and read.where("content = 'new'").count() == 10
    out = upsert(spark.read.parquet(os.path.join(root, "t", "batch=1")), spark.range(10).selectExpr("id AS conv_id", "'x' AS content"))
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()


def test_text_file_of_many_parts(spark):
    from pyspark.sql import functions as F

    from parlance.sources.tables import write_text_file
    path = os.path.join(tempfile.mkdtemp(), "doc.md")
    for n in (2000, 3, 0):  # written over
        rows = spark.range(n).repartition(7).select("id", F.concat(F.lit("line "), "id").alias("block"))
        write_text_file(rows, path, [F.col("id")])
        with open(path) as f:
            assert f.read() == "".join(f"line {i}\n" for i in range(n))
    assert [f for f in os.listdir(os.path.dirname(path)) if not f.startswith(".")] == ["doc.md"]
