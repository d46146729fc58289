"""Plan shape checks: pruning, pushdown, join strategies."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")


def physical(spark, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF)
    # the initial (pre-AQE) plan shows the planner's static choices
    return df._jdf.queryExecution().executedPlan().toString()


def scans(plan):
    return [ln for ln in plan.split("\n") if "FileScan parquet" in ln]


def test_breakdown_reads_no_text(spark):
    plan = physical(spark, "category_breakdown")
    assert scans(plan)
    for ln in scans(plan):
        assert "content" not in ln and "text" not in ln


def test_filters_reach_scan(spark):
    plan = physical(spark, "first_user_messages")
    assert any("PushedFilters: [IsNotNull(role), EqualTo(role,user)" in ln for ln in scans(plan))
    assert "WindowGroupLimit" in plan


def test_membership_broadcasts_categories(spark):
    assert "BroadcastHashJoin" in physical(spark, "membership_rows")


def test_interval_join_is_equi_join(spark):
    plan = physical(spark, "range_slices")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_keyword_label_has_no_join_fanout(spark):
    plan = physical(spark, "keyword_label")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_tree_steps_read_no_text(spark):
    """The tree of a stored node table is ordered without its text."""
    from parlance.operators.tree import edges, roots
    from parlance.plans.materialize import materialize
    from parlance.sources import export as Ex
    from parlance.sources import fixtures as X
    from parlance.session import scratch_path
    raw = Ex.read_export(spark, X.write_export_fixture(spark, SF, scratch_path(spark, "plan-export")))
    nodes = materialize(Ex.tree_nodes(Ex.conversation_headers(raw)), "plan-nodes")
    plan = edges(nodes, roots(nodes))._jdf.queryExecution().executedPlan().toString()
    assert scans(plan) and all("content" not in ln for ln in scans(plan))


def test_proposals_scan_few_tables(spark):
    assert len(scans(physical(spark, "apply_proposals"))) < 15


def test_pairs_and_condensed_text_shuffle_the_text_once(spark):
    from parlance.operators.pairs import message_pairs
    from parlance.operators.render import condensed_text
    from parlance.plans.materialize import materialize
    msgs = materialize(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, pos long, role string, content string"), "plan-msgs")
    heads = materialize(spark.createDataFrame([(1, "t")], "conv_id long, title string"), "plan-heads")
    for df, column in ((message_pairs(msgs), "content"), (condensed_text(heads, msgs), "part")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") <= 2, column


def test_runs_without_an_export_say_so(spark):
    from parlance.plans import commands as C
    from parlance.session import scratch_path
    from parlance.sources import fixtures as X
    ws, cats = C.Workspace(spark, scratch_path(spark, "empty-workspace")), X.categories(spark)
    runs = [lambda: C.categorise(ws, cats), lambda: C.stats(ws), lambda: C.export(ws, cats, "x", ""), lambda: C.enhance(ws, cats, None, "x", "", ""),
            lambda: C.explore(ws, cats, None, "x", ""), lambda: C.transcribe(ws, "x")]
    for run in runs:
        with pytest.raises(C.NothingParsed, match="parse an export"):
            run()


def test_tree_rounds_shrink(spark, monkeypatch):
    """Nodes that reached their end leave the pointer-doubling rounds."""
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    from parlance.operators import tree
    sizes, real = [], Classic.checkpoint

    def counted(self, *args, **kw):
        out = real(self, *args, **kw)
        if "a_anc" not in out.columns and {"anc", "top", "path"} <= set(out.columns):
            sizes.append(out.count())
        return out

    monkeypatch.setattr(Classic, "checkpoint", counted)
    rows = [(c, str(i), i, str(i - 1) if i else None, [str(i + 1)] if i < 20 * c else []) for c in (1, 2) for i in range(20 * c + 1)]
    nodes = spark.createDataFrame(rows, "conv_id long, node_id string, map_pos long, parent string, children array<string>")
    out = tree.linearise_tree(nodes).collect()
    assert sorted(r.pos for r in out if r.conv_id == 2) == list(range(41))
    # 62 nodes at first; after k rounds those deeper than 2 ** k are left.
    assert sizes[0] == 62 and sizes[1:] == [60 - 2 * (2 ** k - 1) if 2 ** k <= 20 else 40 - (2 ** k - 1) for k in range(len(sizes) - 1)]
