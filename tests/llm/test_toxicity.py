import numpy as np
from pyspark.sql import functions as F

from parlance.llm.queries import op9_toxicity
from parlance.llm.toxicity import SEGMENT, STEP, WINDOW, Block, Constant, Network, _subset, fit_network, fit_toxicity, keep_clean, score_toxicity

from .rows import documents

SF = "/root/testdata/sf0.01"


def network(texts):
    block = Block(texts)
    rng = np.random.default_rng(3)
    net = Network(block.hashes[::2], rng.normal(size=len(block.hashes[::2])).astype(np.float32))
    net.p = {k: (v.astype(np.float64) + 0.1 * rng.normal(size=v.shape)) for k, v in net.p.items()}
    return net, block


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def brute_score(net, text):
    """The highest window of one text: every window by plain loops over its segment's words."""
    block = Block([text])
    x, _ = net.inputs(block)
    p, words = net.p, [int(i) for s in block.segments[:1] for i in s if i < len(block.hashes)]
    words += [int(i) for s in block.segments[1:] for i in s[WINDOW - 1:] if i < len(block.hashes)]
    if not words:
        return sigmoid(p["bo"][0])
    n_segments = 1 + max(0, -(-(len(words) - SEGMENT) // STEP))
    best = -np.inf
    for begin in range(max(1, len(words) - WINDOW + 1)):
        at = STEP * min(begin // STEP, n_segments - 1)
        inputs = [x[i] for i in words[at:at + SEGMENT]]
        states = []
        for d in "fb":
            h, out = np.zeros(8), []
            for v in inputs if d == "f" else inputs[::-1]:
                y, u = v @ p["W" + d] + p["b" + d], h @ p["U" + d]
                z, r = sigmoid(y[:8] + u[:8]), sigmoid(y[8:16] + u[8:16])
                h = z * h + (1 - z) * np.tanh(y[16:] + r * u[16:])
                out.append(h)
            states.append(out if d == "f" else out[::-1])
        s = np.array([np.concatenate(v) for v in zip(*states, inputs, strict=True)])[begin - at:begin - at + WINDOW]
        e = np.exp(np.tanh(s @ p["Wa"] + p["ba"]) @ p["va"])
        best = max(best, (e / e.sum()) @ s @ p["wo"] + p["bo"][0])
    return sigmoid(best)


def test_segments_hold_every_window_once():
    for n in (0, 1, 23, 24, 25, 47, 48, 49, 72, 73, 74, 100, 1000):
        block = Block([b" ".join(b"w%d" % i for i in range(n)), b"other words"])
        own = np.flatnonzero(block.owner == 0)
        number = {int(i): k for k, i in enumerate(i for s in block.segments[own] for i in dict.fromkeys(s.tolist()) if i < len(block.hashes))}
        windows = [tuple(block.segments[s, j:j + WINDOW]) for s in own for j in range(block.windows[s])]
        assert len(windows) == max(1, n - WINDOW + 1) == len(set(windows))
        assert len({i for w in windows for i in w if i < len(block.hashes)}) == n
        assert all(len(set(w)) == WINDOW for w in windows if n >= WINDOW) and (n or not number)


def test_every_window_is_scored():
    rng = np.random.default_rng(6)
    words = [b"w%d" % i for i in range(80)]
    texts = [b" ".join(words[i] for i in rng.integers(0, 80, n)) for n in (0, 5, 23, 24, 25, 48, 49, 90, 3, 300)]
    net, _ = network([b" ".join(words)])
    texts += texts[3:8]
    assert np.allclose(net.score(texts), [brute_score(net, t) for t in texts], atol=1e-5)


def test_passages_are_found_at_any_offset():
    rng = np.random.default_rng(2)
    clean, bad = [b"word%d" % i for i in range(400)], [b"bad%d" % i for i in range(30)]

    def text(n, passage=0, at=0):
        out = [clean[i] for i in rng.integers(0, 400, n)]
        out[at:at + passage] = [bad[i] for i in rng.integers(0, 30, passage)]
        return b" ".join(out)

    train = [text(int(rng.integers(30, 300)), int(rng.integers(6, 25)) if i % 2 else 0, int(rng.integers(0, 30))) for i in range(300)]
    net = fit_network(train, np.array([float(i % 2) for i in range(300)]))
    planted = [text(150, n, at) for n in (10, 17, 24) for at in range(0, 120, 3)]
    assert (net.score(planted) > 0.5).mean() > 0.97
    assert (net.score([text(150) for _ in range(100)]) > 0.5).mean() < 0.05


def test_gradients():
    net, block = network([b"you are a fool " * 9, b"a kind word", b"x", b"one two three four five six seven " * 10])
    target, first = np.arange(len(block.segments)) % 2, np.minimum(np.arange(len(block.segments)) * 5, block.windows - 1)

    def loss():
        x, _ = net.inputs(block)
        z = net.forward(x, block.segments, first)[0]
        return float((np.logaddexp(0, z) - target * z).sum())

    x, row = net.inputs(block)
    z, kept = net.forward(x, block.segments, first, keep=True)
    g, dx = net.backward(x, kept, 1 / (1 + np.exp(-z)) - target)
    g["words"] = np.zeros_like(net.p["words"])
    np.add.at(g["words"], row, dx[:-1, :8])
    rng = np.random.default_rng(4)
    for k in g:
        flat, grad = net.p[k].reshape(-1), g[k].reshape(-1)
        for i in rng.integers(0, len(flat), 6):
            old, eps = flat[i], 3e-3
            flat[i] = old + eps
            up = loss()
            flat[i] = old - eps
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * eps) - grad[i]) < 2e-3 + 2e-2 * abs(grad[i]), k


def test_scores_do_not_depend_on_the_block():
    texts = [b"", b"a few words", b"many " * 300, b"!!!", "日本 été".encode()]
    net, _ = network(texts)
    assert np.allclose(net.score(texts), [net.score([t])[0] for t in texts], atol=1e-5)
    block = Block(texts)
    part = _subset(block, np.arange(2))
    assert np.allclose(net.inputs(part)[0][:2], net.inputs(block)[0][:2], atol=1e-6)


def test_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in op9_toxicity(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())
    held = [(rows[x["doc_id"]]["predicted"], x["toxic"]) for x in labels if rows[x["doc_id"]]["held_out"]]
    assert np.mean([p == t for p, t in held]) > 0.92 and np.mean([p for p, t in held if t == 0]) < 0.05


def test_awkward_rows_and_missing_labels(spark):
    docs = documents(spark)
    labels = docs.select("doc_id", F.lit(0).alias("toxic"))
    model = fit_toxicity(docs, labels, "doc_id", "text", "toxic")
    assert isinstance(model, Constant) and model.share == 0
    net = fit_network([b"you idiot", b"good day", b"such an idiot", b"nice", b"idiot", b"fine words"] * 3, np.array([1, 0, 1, 0, 1, 0] * 3, float), rounds=2)
    scores = score_toxicity(docs, "doc_id", "text", net).collect()
    assert len(scores) == docs.count() and all(0 <= r["score"] <= 1 for r in scores)
    kept = keep_clean(docs, "text", net, 0.5)
    assert kept.schema == docs.schema and kept.count() == sum(r["score"] < 0.5 for r in scores)
    assert score_toxicity(documents(spark, []), "doc_id", "text", net).count() == 0
