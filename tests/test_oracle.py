"""Every registered query against its DuckDB oracle on the smallest scale."""

import os

import pytest

SF = os.environ.get("PARLANCE_TEST_SF", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
def test_all_queries_match_oracle(spark):
    from checks.compare import compare
    from parlance.catalog import QUERIES
    res = compare(spark, SF, set(QUERIES), verbose=False)
    assert res.keys() == QUERIES.keys()
    bad = {k: v for k, v in res.items() if v[0] != "OK"}
    assert not bad, bad


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["slug", "conversations", "avg_relevance", "high_relevance"]
