import random
import re

import numpy as np

from parlance.llm.decontaminate import FMIndex, WaveletMatrix, Windows, _hits, find_hits, remove_hits, suffix_array

from .rows import TEXTS, documents

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items, window):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        x = words(t)
        n = min(window, len(x))
        wins = {tuple(x[i:i + n]) for i in range(len(x) - n + 1)} if x else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i:i + n]) in wins:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(w), hit, found


def test_suffix_array_and_wavelet():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 60):
        text = np.append(rng.integers(1, 4, n), 0)
        assert suffix_array(text).tolist() == sorted(range(n + 1), key=lambda i: text[i:].tolist())
    values = rng.integers(0, 9, 200)
    w = WaveletMatrix(values, 4)
    at = np.arange(200)
    symbol, before = w.access(at)
    assert symbol.tolist() == values.tolist() and before.tolist() == [int((values[:i] == values[i]).sum()) for i in at]
    assert w.rank(np.full(201, 3), np.arange(201)).tolist() == [int((values[:i] == 3).sum()) for i in range(201)]


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 4, 500)
    index = FMIndex(text)
    for n in (1, 2, 5):
        patterns = rng.integers(1, 5, (30, n))
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high, strict=True):
            want = [i for i in range(len(text) - n + 1) if (text[i:i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_hits_like_brute_force():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(6)] + ["Élan", "x1"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 9)))) for i in range(8)]
    texts = [" ".join(rng.choice([*vocab, "other", "!"]) for _ in range(rng.randint(0, 80))).encode() for _ in range(60)]
    windows = Windows([(str(i), t.encode()) for i, t in items if t], 4)
    for text, (n, spans, found, _) in zip(texts, _hits(windows, texts), strict=True):
        want = brute(text.decode(), items, 4)
        assert (n, {p for b, e in spans for p in range(b, e)}, found) == want


def test_rows_and_blocks(spark):
    items = [(7, "brown fox jumps over the lazy dog and runs away now"), (8, None), (9, "  "), (10, "One,  TWO"), (10, "large id")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    for block_bytes in (1 << 20, 4):
        rows = find_hits(documents(spark), "doc_id", "text", bench, "item_id", "text", window=5, block_bytes=block_bytes).collect()
        got = sorted((str(r["doc_id"]), r["n_words"], [(s["first"], s["end"]) for s in r["spans"]], r["items"]) for r in rows)
        want = []
        for i, t in TEXTS:
            n, hit, found = brute(t, items, 5)
            spans, at = [], sorted(hit)
            for p in at:
                if spans and spans[-1][1] == p:
                    spans[-1] = (spans[-1][0], p + 1)
                else:
                    spans.append((p, p + 1))
            want.append((str(i), n, spans, sorted(found)))
        assert got == sorted(want)
    empty = spark.createDataFrame([], "item_id int, text string")
    assert all(not r["spans"] for r in find_hits(documents(spark), "doc_id", "text", empty, "item_id", "text").collect())
    assert find_hits(documents(spark, []), "doc_id", "text", bench, "item_id", "text").count() == 0


def test_removal_leaves_no_window(spark):
    # Cutting the inner passage brings the halves of another one together.
    item = "alpha beta gamma delta epsilon zeta"
    bench = spark.createDataFrame([(1, item)], "item_id int, text string")
    docs = documents(spark, [(1, "Start here. Alpha beta gamma alpha beta gamma delta epsilon zeta delta, epsilon zeta! The end."),
                             (2, item), (3, "clean text  stays\n as it is"), (4, None), (5, ""), (6, item + " and more")])
    rows = {r["doc_id"]: r["text"] for r in remove_hits(docs, "text", bench, "item_id", "text").collect()}
    assert rows == {1: "Start here.\n! The end.", 3: "clean text  stays\n as it is", 4: None, 5: "", 6: "and more"}
    assert remove_hits(docs, "text", bench, "item_id", "text").schema == docs.schema


def test_removal_does_not_depend_on_the_blocks(spark):
    # The second item's cut joins the first's words; two items overlap; and random ones.
    rng = random.Random(5)
    items = [(1, "a b c d"), (2, "x y z v"), (3, "k l m n"), (4, "m n o p"), (5, None)] + [(i, " ".join(rng.choice("qrst") for _ in range(5))) for i in range(6, 12)]
    texts = ["go a b x y z v c d on", "go k l m n o p on", "a b x k l m n y z v c d", "a b c d", None, "", "left as  it is"]
    texts += [" ".join(rng.choice("qrstu") for _ in range(60)) for _ in range(40)]
    bench = spark.createDataFrame(items, "item_id int, text string")
    docs = documents(spark, [(i % 30, t) for i, t in enumerate(texts)])
    by_size = [sorted(map(str, remove_hits(docs, "text", bench, "item_id", "text", window=4, block_bytes=size).collect())) for size in (1 << 20, 8)]
    assert by_size[0] == by_size[1] and len(by_size[0]) < len(texts)
    rows = [r["text"] for r in remove_hits(docs, "text", bench, "item_id", "text", window=4, block_bytes=8).collect()]
    assert rows.count("go\non") == 2 and {"left as  it is", None, ""} <= set(rows)
    assert not any(brute(t, items, 4)[1] for t in rows)


def test_packed_windows():
    rng = np.random.default_rng(7)
    items = [(str(rng.integers(0, 12)), b" ".join(b"w%d" % i for i in rng.integers(0, 3, n))) for n in (0, 1, 2, 3, 3, 4, 7, 30, 30, 2, 1, 50)]
    windows = Windows(items, 4)
    want = {}
    for item, text in items:
        words = text.split()
        for i in range(max(1, len(words) - 3) if words else 0):
            want.setdefault(tuple(words[i:i + 4]), set()).add(item)
    word = {n: w for w, n in windows.vocabulary.items()}
    got = {tuple(word[s] for s in row): windows.items_of(np.array([first + i])) for _, first, rows in windows.groups for i, row in enumerate(rows.tolist())}
    assert got == want and len(windows.lengths) == len(want)
    assert not Windows([], 4).shortest and not Windows([("a", b" . ")], 4).shortest


def test_windows_of_many_items_stay_small():
    rng = np.random.default_rng(8)
    vocabulary = [b"word%d" % i for i in range(50_000)]
    items = [(str(n), b" ".join(vocabulary[i] for i in rng.integers(0, 50_000, 200))) for n in range(2000)]
    windows, text = Windows(items), sum(len(t) for _, t in items)
    size = sum(m.nbytes for _, _, m in windows.groups) + windows.owner.nbytes + windows.offset.nbytes + windows.lengths.nbytes
    assert text > 3 << 20 and size < 8 * text
