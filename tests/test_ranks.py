"""Offset-based global rank equals a single-task row_number."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.operators.sample import sample_positions
from parlance.plans.ranks import with_global_rank


def test_rank_matches_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 13).alias("g")).repartition(7)
    order = [F.col("g").desc(), F.col("k")]
    got = {r.k: r.rank for r in with_global_rank(df, order).collect()}
    ref = {r.k: r.rn for r in df.select("k", F.row_number().over(Window.orderBy(*order)).alias("rn")).collect()}
    assert got == ref


def test_sample_positions(spark):
    n, s = 77, 10
    got = [r.sample_pos for r in sample_positions(spark, n, s).orderBy("sample_ord").collect()]
    assert got == [min(int(i * n / s + 0.5), n - 1) for i in range(s)]
    assert len(set(got)) == s and got == sorted(got)


def test_one_large_group(spark):
    """A group that spans range partitions is ranked like a small one."""
    from parlance.operators.pairs import message_pairs
    rows = [(1, i, "user" if i % 3 else "assistant", f"t{i}") for i in range(50)] + [(2, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, pos long, role string, content string")
    got = sorted((r.conv_id, r.pair_index, r.user, r.assistant) for r in message_pairs(df).collect())
    want, pending = [], []
    for _, _, role, text in rows[:50]:
        if role == "user":
            pending.append(text)
        else:
            want.append((1, len(want), "\n\n".join(pending), text))
            pending = []
    if pending:
        want.append((1, len(want), "\n\n".join(pending), "(no reply)"))
    assert got == [*want, (2, 0, "x", "(no reply)")]


def test_condensed_long_conversation(spark):
    """Bounded collect gives the same text as cutting the whole text."""
    from parlance.functions.text import MIDDLE_MARKER
    from parlance.operators.render import condensed_text
    rows = [(1, i, "user" if i % 2 else "assistant", ("w%d " % i) * (i % 7 + 1)) for i in range(400)]
    msgs = spark.createDataFrame(rows, "conv_id long, pos long, role string, content string")
    hdr = spark.createDataFrame([(1, "Long one")], "conv_id long, title string")
    full = "\n".join(["# Long one\n"] + [f"[{r[2].upper()}]: {r[3]}\n" for r in rows])
    for m in (100, 600, 100000):
        got = condensed_text(hdr, msgs, m).first().condensed
        exp = full if len(full) <= m else full[: int(m * 0.6)] + MIDDLE_MARKER + full[-int(m * 0.35):]
        assert got == exp, m


def test_histogram_bins_sum(spark):
    """Bin counts sum to the rows with a positive score; five bins."""
    import random
    from parlance.operators.stats import relevance_histogram
    rng = random.Random(5)
    scores = [round(rng.choice([0.0, rng.random(), 0.2, 0.4, 0.6, 0.8, 1.0]), 3) for _ in range(300)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "conv_id long, relevance_score double")
    rows = relevance_histogram(df).collect()
    assert len(rows) == 5 and sum(r.conversations for r in rows) == sum(1 for s in scores if s > 0)
    empty = spark.createDataFrame([(1, 0.0)], "conv_id long, relevance_score double")
    assert relevance_histogram(empty).count() == 0


def test_sample_sizes(spark):
    """Exactly s distinct, increasing positions for any n > s."""
    from parlance.operators.sample import sample_positions
    for n, s in [(11, 10), (77, 10), (1000, 50), (51, 50), (7, 3)]:
        got = [r.sample_pos for r in sample_positions(spark, n, s).orderBy("sample_ord").collect()]
        assert len(got) == s and got == sorted(set(got)) and got[-1] <= n - 1


def test_grouped_rank_keeps_null_keys(spark):
    from parlance.plans.ranks import grouped_rank
    df = spark.createDataFrame([(1, 5, "a"), (1, None, "b"), (None, 7, "c"), (None, 3, "d"), (2, 1, "e")], "g int, o int, v string")
    got = sorted((r.v, r["rank"]) for r in grouped_rank(df, ["g"], ["o"]).collect())
    assert got == [("a", 2), ("b", 1), ("c", 2), ("d", 1), ("e", 1)]
