import random

import numpy as np

from parlance.llm.near_dup import components, hub_cells, keep_one, link_sets, near_duplicates, super_min_hash, unmet

from .rows import TEXTS, documents


def shingles(t, k=5):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(texts, percent):
    """Smallest reachable id per row; rows of one id are one node."""
    sets = [shingles(t) for _, t in texts]
    parent = {i: i for i, _ in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            i, j = texts[a][0], texts[b][0]
            x, y = sets[a], sets[b]
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                i, j = find(i), find(j)
                parent[max(i, j)] = min(i, j)
    return sorted((str(i), len(s), str(None if i is None else find(i))) for (i, _), s in zip(texts, sets, strict=True))


def family(seed=5, copies=60):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    texts = []
    for i in range(copies):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
            w[rng.randrange(len(w))] = f"n{rng.randint(0, 10 ** 6)}"
        texts.append((i * 3 + 1, " ".join(w)))
    texts += [(1000 + i, " ".join(f"u{rng.randint(0, 10 ** 6)}" for _ in range(rng.randint(1, 60)))) for i in range(40)]
    texts += [(2000 + i, texts[i * 2][1].upper()) for i in range(20)]
    rng.shuffle(texts)
    return texts


def collected(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    errors = []
    for own in (20, 60, 150):
        a = np.concatenate([common, rng.integers(0, 1 << 63, own).astype(np.uint64)])
        b = np.concatenate([common, rng.integers(0, 1 << 63, own).astype(np.uint64)])
        s = super_min_hash(np.concatenate([a, b]), np.repeat([0, 1], len(a)), 2, 1024)
        errors.append(abs((s[0] == s[1]).mean() - 300 / (300 + 2 * own)))
    assert max(errors) < 0.05
    # Early stopping changes nothing: a set of one element fills every component once.
    one = super_min_hash(np.array([7], np.uint64), np.array([0]), 1, 64)
    assert sorted((one[0] >> np.uint64(32)).tolist()) == list(range(64))


def test_links_connect_like_all_pairs():
    for seed in range(4):
        sets = [np.unique(np.array([hash(s) & (1 << 62) - 1 for s in shingles(t)], np.uint64)) for _, t in family(seed, 40)]

        def roots(pairs, n=len(sets)):
            r = list(range(n))
            for a, b in pairs:
                a, b = r[a], r[b]
                r = [min(a, b) if x in (a, b) else x for x in r]
            return r

        want = [(a, b) for a in range(len(sets)) for b in range(a)
                if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))]
        got = link_sets(sets, 85)
        assert set((max(p), min(p)) for p in got) <= set(want) and len(got) < len(sets)
        assert roots(got) == roots(want)


def test_whole_operator_like_brute_force(spark):
    texts = family()
    docs = documents(spark, texts)
    for cell_bytes in (1 << 22, 4000):  # one cell, and families cut into many
        assert collected(near_duplicates(docs, "doc_id", "text", 85, cell_bytes=cell_bytes)) == brute(texts, 85)


def chained(seed=9, families=12, copies=12):
    """Families of one template at some 0.5 to 0.7 of each other, each a chain of edits: candidates hang together, links only within chains."""
    rng = random.Random(seed)
    template = [f"t{i}" for i in range(160)]
    texts = []
    for f in range(families):
        w = list(template)
        for at in rng.sample(range(160), 9):
            w[at] = f"f{f}-{at}"
        for c in range(copies):
            if c:
                w[rng.randrange(160)] = f"c{f}-{c}"
            texts.append((c * families + f, " ".join(w)))
    rng.shuffle(texts)
    return texts


def test_candidates_that_hang_together(spark):
    texts = chained()
    docs = documents(spark, texts)
    want = brute(texts, 85)
    assert 1 < len({root for _, _, root in want}) < len(texts)
    for cell_bytes in (1 << 22, 20_000, 1500):
        assert collected(near_duplicates(docs, "doc_id", "text", 85, cell_bytes=cell_bytes)) == want


def test_second_pass_leaves_out_linked_and_compared_texts(spark):
    # Keys: 1-6 one family (hub 1), 7 shares a key with 3 and 5 and is not linked, 8 and 9 were compared in the only cell of 8.
    keys = {n: [10] for n in range(1, 7)} | {3: [10, 11], 5: [10, 11], 7: [11], 8: [12], 9: [12]}
    nodes = spark.createDataFrame([(n, 100, keys[n]) for n in keys], "node bigint, n_bytes bigint, keys array<bigint>")
    cells = hub_cells(nodes, 200)
    assert {r["node"]: (r["hub"], r["chunks"]) for r in cells.collect()} == {
        **{n: (1, 3) for n in range(1, 7)}, 7: (3, 1), 8: (8, 1), 9: (8, 1)}
    known = spark.createDataFrame([(n, 1) for n in range(1, 7)], "node bigint, root bigint")
    dealt = unmet(nodes, cells, known, 200).collect()
    # 3 is the hub of 7, so they have met; 5 and 7 have not, and nobody else is dealt.
    assert {r["node"] for r in dealt} == {5, 7}
    by_cell = {c: {r["node"]: r["side"] for r in dealt if r["cell"] == c} for c in {r["cell"] for r in dealt}}
    assert any({5, 7} <= set(sides) and sides[5] != sides[7] for sides in by_cell.values())


def test_awkward_rows(spark):
    assert collected(near_duplicates(documents(spark), "doc_id", "text", 85)) == brute(TEXTS, 85)
    assert near_duplicates(documents(spark, []), "doc_id", "text").count() == 0
    kept = sorted((str(r["doc_id"]), r["text"]) for r in keep_one(documents(spark), "doc_id", "text", 85).select("doc_id", "text").collect())
    ids = [i for i, _ in kept]
    # 6 is linked with 1 by its first text, so it goes with all its rows; 8 equals 7, 11 is close to 5; empty texts and the null id stay.
    assert sorted(ids) == sorted(["1", "2", "3", "4", "5", "7", "None", "9", "10", str((1 << 62) + 1)])


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(i, i + 1) for i in range(500, 540)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "t").collect()}
    assert got == root
