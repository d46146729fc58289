"""W1 against a plain stack DFS on random trees, DAGs and cycles."""

import random

from parlance.operators.tree import linearise_tree


def dfs(nodes):
    order = sorted(nodes, key=lambda n: n[1])
    children = {n[0]: n[3] for n in order}
    root = next((n[0] for n in order if n[2] in (None, "", "0")), None)
    out, seen, stack = [], set(), [root] if root is not None else []
    while stack:
        x = stack.pop()
        if x in seen or x not in children:
            continue
        seen.add(x)
        out.append(x)
        stack.extend(c for c in reversed(children[x]) if c not in seen)
    return out


def random_conv(rng, kind):
    n = rng.randint(1, 25)
    ids = [f"n{i}" for i in range(n)]
    rng.shuffle(ids)
    parent = {ids[0]: None}
    kids = {i: [] for i in ids}
    for i in range(1, n):
        p = ids[rng.randrange(0, i)]
        parent[ids[i]] = p
        kids[p].append(ids[i])
    if kind == "dag" and n > 3:
        a, b = rng.sample(ids[1:], 2)
        kids[a].append(b)
    if kind == "cycle" and n > 3:
        a = ids[-1]
        kids[a].append(ids[0])           # back edge into the root
        kids[ids[1]].append(ids[1])      # self loop
    if kind == "missing":
        kids[ids[0]].append("ghost")
    for k in kids.values():
        rng.shuffle(k)
    pos = list(range(n))
    rng.shuffle(pos)
    return [(i, pos[j], parent[i], kids[i]) for j, i in enumerate(ids)]


def test_matches_dfs(spark):
    rng = random.Random(7)
    rows, expected = [], {}
    for c in range(60):
        kind = ["tree", "dag", "cycle", "missing"][c % 4]
        nodes = random_conv(rng, kind)
        expected[f"c{c}"] = dfs(nodes)
        rows += [(f"c{c}", i, p, par, ch) for i, p, par, ch in nodes]
    df = spark.createDataFrame(rows, "conv_id string, node_id string, map_pos bigint, parent string, children array<string>")
    got = {}
    for r in linearise_tree(df).collect():
        got.setdefault(r.conv_id, []).append((r.pos, r.node_id))
    got = {k: [n for _, n in sorted(v)] for k, v in got.items()}
    for k, v in expected.items():
        assert got.get(k, []) == v, k


def test_unreachable_and_second_root(spark):
    rows = [("a", "r", 0, None, ["x"]), ("a", "x", 1, "r", []), ("a", "r2", 2, "", ["y"]), ("a", "y", 3, "r2", [])]
    df = spark.createDataFrame(rows, "conv_id string, node_id string, map_pos bigint, parent string, children array<string>")
    assert [r.node_id for r in linearise_tree(df).orderBy("pos").collect()] == ["r", "x"]
