"""S1-S5 on inline export files: flat and tree forms, defaults, dedup."""

import json
import os
import tempfile

import pytest

from parlance.plans.ingest import ingest
from parlance.sources.export import ExportNotFound


def write(d, name, data):
    with open(os.path.join(d, name), "w") as f:
        json.dump(data, f)


def test_flat_tree_and_dedup(spark):
    d = tempfile.mkdtemp()
    write(d, "a.json", [
        {"id": "f1", "title": "Flat", "create_time": 100, "messages": [
            {"role": "system", "content": "sys"},
            {"author": {"role": "user"}, "content": "  hello \n", "timestamp": 101},
            {"role": "assistant", "content": {"content_type": "multimodal_text",
                                              "parts": [{"content_type": "image"}, "pic", {"content_type": "text", "text": "cap"}]},
             "create_time": 102},
            {"role": "user", "content": "   "},
            {"role": "tool", "content": "x"}]},
        {"conversation_id": "t1", "create_time": 50, "mapping": {
            "r": {"parent": None, "children": ["u", "ghost"], "message": None},
            "u": {"parent": "r", "children": ["a1", "a2"], "message": {"author": {"role": "user"}, "content": {"content_type": "text", "parts": ["q", 5]}}},
            "a1": {"parent": "u", "children": [], "message": {"author": {"role": "assistant"}, "content": {"content_type": "text", "parts": ["first"]}, "create_time": 51}},
            "a2": {"parent": "u", "children": [], "message": {"author": {"role": "assistant"}, "content": {"content_type": "text", "parts": ["second"]}}}}},
        {"title": "no id", "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]},
        {"id": "short", "messages": [{"role": "user", "content": "only one"}]},
    ])
    write(d, "b.json", [{"id": "f1", "title": "Flat again", "create_time": 100,
                         "messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "v"}]}])
    write(d, "ignored.txt", [])
    hdrs, msgs = ingest(spark, d)
    h = {r.conv_id: r for r in hdrs.collect()}
    assert set(h) == {"f1", "t1"}
    assert h["f1"].title == "Flat again" and h["t1"].title == "Untitled"
    m = {}
    for r in msgs.orderBy("conv_id", "pos").collect():
        m.setdefault(r.conv_id, []).append((r.role, r.content, r.ts))
    assert m["t1"] == [("user", "q", 0.0), ("assistant", "first", 51.0), ("assistant", "second", 0.0)]
    assert m["f1"] == [("user", "u", 0.0), ("assistant", "v", 0.0)]


def test_flat_content_rules(spark):
    d = tempfile.mkdtemp()
    write(d, "a.json", [{"id": "f1", "messages": [
        {"author": {"role": "user"}, "content": "  hello \n", "timestamp": 101},
        {"role": "assistant", "content": {"content_type": "multimodal_text",
                                          "parts": [{"content_type": "image"}, "pic", {"content_type": "text", "text": "cap"}]}}]}])
    _, msgs = ingest(spark, os.path.join(d, "a.json"))
    assert [(r.role, r.content, r.ts) for r in msgs.orderBy("pos").collect()] == [("user", "hello", 101.0), ("assistant", "pic\ncap", 0.0)]


def test_missing_paths(spark):
    d = tempfile.mkdtemp()
    with pytest.raises(ExportNotFound):
        ingest(spark, os.path.join(d, "nope"))
    with pytest.raises(ExportNotFound):
        ingest(spark, d)


NASTY = [
    {"id": "a", "title": 'quote " and \\ backslash', "messages": [{"role": "user", "content": "}{]["}, {"role": "assistant", "content": '\\"}'}]},
    {"id": "b", "title": "}", "mapping": {"}": {"parent": None, "children": ["x"], "message": None},
                                         "x": {"parent": "}", "children": [], "message": {"author": {"role": "user"}, "content": {"content_type": "text", "parts": ["\\\\", {"a": {}}, "{"]}}}}},
    {}, {"id": "d", "title": "\u00fc\u2028\n\t", "messages": []}, {"id": "e" * 3000, "title": "long " * 2000},
]


def _records(df):
    from pyspark.sql import functions as F
    rows = df.select("id", "title", "create_time", F.to_json(F.struct("mapping", "messages")).alias("rest"), "file", "file_pos").collect()
    return [(r.file, r.id, r.title, r.create_time, r.rest) for r in sorted(rows, key=lambda r: (r.file, r.file_pos))], len({r.file_pos for r in rows}) == len(rows)


def test_split_files_give_the_same_records(spark):
    from parlance.sources.export import read_export
    d = tempfile.mkdtemp()
    write(d, "a.json", NASTY)
    write(d, "b c+d.json", [dict(r, id=f"{i}") for i in range(4) for r in NASTY])
    write(d, "empty.json", [])
    with open(os.path.join(d, "pretty.json"), "w") as f:
        json.dump(NASTY, f, indent=2, ensure_ascii=False)
    want, _ = _records(read_export(spark, d))
    assert len(want) == 6 * 5
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4000", before):  # parts of files that begin anywhere, and whole files
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got, unique = _records(read_export(spark, d, split_bytes=0))
            assert got == want and unique
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    # Large and small files together, and a single large one.
    got, unique = _records(read_export(spark, d, split_bytes=20_000))
    assert got == want and unique
    assert _records(read_export(spark, os.path.join(d, "a.json"), split_bytes=0))[0] == [r for r in want if r[0] == "a.json"]


def test_one_large_file_makes_many_tasks(spark):
    from parlance.sources.export import split_records
    d = tempfile.mkdtemp()
    write(d, "a.json", [dict(r, id=f"{i}") for i in range(200) for r in NASTY[:2]])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
        assert spark.read.option("lineSep", "}").text(os.path.join(d, "a.json")).rdd.getNumPartitions() > 4
        assert split_records(spark, [os.path.join(d, "a.json")]).count() == 400
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("text", ['[{"id": "a"}, {"id": "b"', '[{"id": "a"} {"id": "b"}]', '[{"id": "a"}, 5]', '{"id": "a"}, {"id": "b"}', '[{"id": "a"}', '[{"id": "a}]', '[{"id": a}]'])
def test_split_files_that_are_no_arrays_fail(spark, text):
    from parlance.sources.export import read_export
    path = os.path.join(tempfile.mkdtemp(), "a.json")
    with open(path, "w") as f:
        f.write(text)
    with pytest.raises(Exception):
        read_export(spark, path, split_bytes=0).select("id", "title").collect()
