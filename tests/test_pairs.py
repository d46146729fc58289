"""W4 exchange pairing edge cases and a property."""

from parlance.operators.pairs import message_pairs


def pairs_of(spark, roles):
    rows = [(1, i, r, f"{r}{i}") for i, r in enumerate(roles)]
    df = spark.createDataFrame(rows, "conv_id long, pos long, role string, content string")
    return [(r.pair_index, r.user, r.assistant) for r in message_pairs(df).orderBy("pair_index").collect()]


def test_merged_users_and_trailing(spark):
    got = pairs_of(spark, ["user", "user", "assistant", "user"])
    assert got == [(0, "user0\n\nuser1", "assistant2"), (1, "user3", "(no reply)")]


def test_assistant_first_and_consecutive(spark):
    got = pairs_of(spark, ["assistant", "assistant", "user", "assistant"])
    assert got == [(0, "", "assistant0"), (1, "", "assistant1"), (2, "user2", "assistant3")]


def test_all_text_kept_in_order(spark):
    import random
    rng = random.Random(3)
    roles = [rng.choice(["user", "assistant"]) for _ in range(40)]
    got = pairs_of(spark, roles)
    texts = []
    for _, u, a in got:
        texts += [t for t in u.split("\n\n") if t] + ([a] if a != "(no reply)" else [])
    assert texts == [f"{r}{i}" for i, r in enumerate(roles)]


def test_keyword_label_with_a_large_taxonomy(spark):
    from parlance.catalog import _base
    from parlance.operators.label import haystacks, keyword_label
    msgs, hdrs = _base(spark, "/root/testdata/sf0.001")
    hay = {r.conv_id: r.haystack for r in haystacks(hdrs, msgs).collect()}
    words = sorted({w for h in hay.values() for w in h.split()})
    taxonomy = [(i, f"c{i}", "", "", [f"no such word {i}", words[i % len(words)].upper()] if i % 3 == 0 else [f"'\"\\ {i}"]) for i in range(11_000)]
    cats = spark.createDataFrame(taxonomy, "cat_ord int, slug string, name string, description string, keywords array<string>")
    got = {r.conv_id: list(r.categories) for r in keyword_label(hdrs, msgs, cats).collect()}
    want = {c: [slug for _, slug, _, _, kws in taxonomy if any(k.lower() in h for k in kws)] or ["other"] for c, h in hay.items()}
    assert got == want and max(map(len, got.values())) > 100


def test_one_liners_belong_to_their_chunk(spark):
    from parlance.operators.pairs import attach_one_liners
    pairs = spark.createDataFrame([(1, i, f"u{i}", f"a{i}") for i in range(5)], "conv_id long, pair_index long, user string, assistant string")
    said = spark.createDataFrame([(1, 0, 0, "zero", 0), (1, 0, 0, "zero again", 1), (1, 1, 0, "wrong chunk", 0), (1, 1, 4, "four", 1), (1, 1, -1, "stray", 2)],
                                 "conv_id long, chunk long, pair_index long, one_liner string, item_ord int")
    got = {r.pair_index: r.one_liner for r in attach_one_liners(pairs, said).collect()}
    assert got == {0: "zero again", 1: "(no summary)", 2: "(no summary)", 3: "(no summary)", 4: "four"}
