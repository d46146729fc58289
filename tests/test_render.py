"""Golden documents through the range-partitioned writer."""

import glob
import os
import tempfile

from pyspark.sql import functions as F

from parlance.operators import render as R


def read_doc(d):
    parts = sorted(glob.glob(os.path.join(d, "part-*")))
    return "".join(open(p, encoding="utf-8").read() for p in parts)


def test_transcript_golden(spark):
    hdr = spark.createDataFrame([(1, "Plan: A/B", 1704067200.0)], "conv_id long, title string, create_time double")
    msgs = spark.createDataFrame([(1, 0, "user", "Hi", 1704067260.0), (1, 1, "assistant", "Hello", 0.0)],
                                 "conv_id long, pos long, role string, content string, ts double")
    out = tempfile.mkdtemp()
    blocks = R.transcript_blocks(hdr, msgs).join(R.transcript_file_names(hdr), "conv_id")
    R.write_documents(blocks, out, doc_col="file_name", order=[F.col("part"), F.col("pos")], partitions=3)
    doc = read_doc(os.path.join(out, "file_name=Plan_AB_1.md"))
    expected = ("# Plan: A/B\n\n_Created: 01 Jan 2024 00:00_\n\n---\n\n"
                "### 🧑 User\n_01 Jan 2024 00:01_\n\nHi\n\n---\n\n"
                "### 🤖 Assistant\n\nHello\n\n---\n\n")
    assert doc == expected
    # the assembled form is the same text without the writer's final newline
    assembled = R.transcripts(hdr, msgs).first().markdown
    assert assembled + "\n" == expected


def test_category_document_order(spark):
    rows = [(i, f"T{i}", 1704067200.0 + i, 1704067200.0 + i, 4, 2, ["english"], [], "", [], (i % 5) / 4.0)
            for i in range(40)]
    lab = spark.createDataFrame(rows, "conv_id long, title string, create_time double, update_time double, message_count long, "
                                      "user_messages long, categories array<string>, tags array<string>, summary string, "
                                      "key_facts array<string>, relevance_score double")
    cats = spark.createDataFrame([(0, "english", "English", "", [])], "cat_ord int, slug string, name string, description string, keywords array<string>")
    out = tempfile.mkdtemp()
    R.write_documents(R.context_package_blocks(lab, cats, 0.0, "2024-06-01 00:00:00"), out, partitions=5)
    doc = read_doc(os.path.join(out, "slug=english"))
    assert doc.startswith("# Context Package: English\n\nGenerated: 2024-06-01 00:00:00\nConversations: 40\nMinimum relevance: 0\n")
    titles = [ln[3:] for ln in doc.split("\n") if ln.startswith("## ")]
    order = sorted(rows, key=lambda r: (-r[10], -r[2], r[0]))
    assert titles == [r[1] for r in order]


def test_file_names_never_clash(spark):
    hdr = spark.createDataFrame([(5, "A"), (6, "A"), (7, "A_5"), (8, "")], "conv_id long, title string")
    assert sorted(r.file_name for r in R.transcript_file_names(hdr).collect()) == ["8_8.md", "A_5.md", "A_5_7.md", "A_6.md"]


def test_category_json_is_complete_and_ordered(spark):
    import json
    rows = [(i, f"T{i}", 1704067200.0, 1704067200.0, 4, 2, ["english"], ["t"], "s", [], (i % 7) / 7.0) for i in range(60)]
    lab = spark.createDataFrame(rows, "conv_id long, title string, create_time double, update_time double, message_count long, "
                                      "user_messages long, categories array<string>, tags array<string>, summary string, "
                                      "key_facts array<string>, relevance_score double")
    cats = spark.createDataFrame([(0, "english", "English", "d", ["k"])], "cat_ord int, slug string, name string, description string, keywords array<string>")
    out = tempfile.mkdtemp()
    R.write_category_json(lab, cats, out)
    docs = [json.loads(ln) for ln in read_doc(os.path.join(out, "slug=english")).splitlines()]
    assert [d["id"] for d in docs] == [str(r[0]) for r in sorted(rows, key=lambda r: (-r[10], str(r[0])))]
    assert set(docs[0]) == {"id", "title", "created", "updated", "message_count", "user_messages", "categories", "tags", "summary", "key_facts", "relevance_score"}
    head = R.category_json_header(lab, cats, "now").toJSON().first()
    assert json.loads(head)["category"] == {"slug": "english", "name": "English", "description": "d", "keywords": ["k"]}


def test_snippets_count_display_columns(spark):
    from parlance.functions.text import snippet
    cases = {"a" * 80: "a" * 80, "a" * 81: "a" * 79 + "…", "日" * 40: "日" * 40, "日" * 41: "日" * 39 + "…", "a" + "日" * 40: "a" + "日" * 39 + "…",
             "é" * 81: "é" * 79 + "…", "日" * 39 + "abc": "日" * 39 + "a…", "\U00020000" * 41: "\U00020000" * 39 + "…"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", snippet("t").alias("s"))
    assert {r.t: r.s for r in df.collect()} == cases
