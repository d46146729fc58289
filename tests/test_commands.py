"""End-to-end runs of the command plans with a stub model on sf0.001."""

import os
import tempfile

import pytest

from checks.stub_model import stub_model

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
def test_command_flow(spark):
    from parlance.operators import select as Sel
    from parlance.plans import commands as C
    from parlance.sources import fixtures as X
    from parlance.session import scratch_path

    root = tempfile.mkdtemp(prefix="ws-")
    ws = C.Workspace(spark, root)
    cats = X.categories(spark)
    export_dir = X.write_export_fixture(spark, SF, scratch_path(spark, "cmd-export"))

    parsed = C.parse(ws, export_dir)
    assert parsed["summary"].first()["total"] > 0
    first_merge = parsed["merge"].first()
    assert first_merge["added"] == first_merge["total"] and first_merge["updated"] == 0
    again = C.parse(ws, export_dir)["merge"].first()
    assert again["added"] == 0 and again["updated"] == again["total"]

    kw = C.categorise(ws, cats)
    assert {r["status"] for r in kw["counts"].collect()} <= {"processed", "retried", "skipped", "error"}
    n_state = ws.state().count()
    assert n_state > 0
    # a second keyword run skips everything
    assert {r["status"] for r in C.categorise(ws, cats)["counts"].collect()} == {"skipped"}
    # the model run retries keyword rows (no summary / tags) and stores parsed labels
    C.categorise(ws, cats, model=stub_model)
    st = ws.state().collect()
    assert all(r["summary"] == "s" and r["relevance_score"] == 1.0 and list(r["categories"]) == ["english"] for r in st)

    s = C.stats(ws)
    assert s["corpus"].first()["labelled"] == n_state

    out = tempfile.mkdtemp(prefix="out-")
    C.export(ws, cats, out, "2024-06-01 00:00:00")
    assert os.path.isdir(os.path.join(out, "markdown", "slug=english"))

    res = C.ask(ws, "What?", stub_model, fan_in=2)
    assert res["answer"].first()["answer"].startswith("answer for synth")

    a, b = sorted(r["conv_id"] for r in ws.headers().collect())[:2]
    ids = Sel.id_frame(spark, [f"{a},{a}", b, "none"])
    by_id = C.ask(ws, "What?", stub_model, ids=ids, min_messages=2, out_dir=os.path.join(out, "answers"), file_stamp="t")
    assert [r["conv_id"] for r in by_id["missing"].collect()] == ["none"]
    assert [r["conv_id"] for r in by_id["sources"].orderBy("pool_rank").collect()] == [a, a, b]
    assert os.path.isfile(os.path.join(out, "answers", "ask-answer-t.md"))
    with pytest.raises(ValueError, match="no conversation"):
        C.ask(ws, "What?", stub_model, slug="nowhere")

    def broken(pdf):
        raise RuntimeError("down")

    with pytest.raises(RuntimeError, match="failed"):
        C.ask(ws, "What?", broken)
    # Without an export the pool comes from the state.
    stub = C.Workspace(spark, tempfile.mkdtemp(prefix="ws-"))
    stub.store.write("state", ws.state())
    assert C.ask(stub, "What?", stub_model)["sources"].count() > 0

    enh = C.enhance(ws, cats, stub_model, out, "2024-06-01 00:00:00", "2024-06-01T00:00:00+00:00",
                    accept=lambda d: d.select("conv_id", d.conv_id.isNotNull().alias("accept_a"), d.conv_id.isNotNull().alias("accept_b")))
    counts = {r["status"]: r["conversations"] for r in enh["counts"].collect()}
    assert counts["processed"] > 0 and counts["error"] == 0 and counts["files"] > 0
    e = enh["enhanced"].collect()
    assert e and all(r["enhanced_summary"] == "New summary" for r in e)
    assert all(r["summary"] == "New summary" for r in ws.state().collect() if r["conv_id"] in {x["conv_id"] for x in e})

    top = C.explore(ws, cats, stub_model, os.path.join(out, "discovery.json"), "2024-06-01T00:00:00+00:00")
    assert top.first()["slug"] == "topic-a"

    docs = C.transcribe(ws, os.path.join(out, "transcripts"))
    assert docs.count() == ws.headers().count()
