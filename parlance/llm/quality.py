"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every text, whole, becomes a row of statistics (``STATISTICS``), computed by
vector operations over blocks of texts. The trees are fitted in numpy on the
driver over quantile bins of a bounded sample of labelled rows
(``ROWS_PER_CLASS`` of each class; statistics of the sample, not its texts,
come to the driver) and flattened into complete binary arrays, which are
broadcast (about TREES * 2**DEPTH numbers) and traversed for all rows of a
block at once.

Only the text is an input of a score. Null and empty texts have zero
statistics and get the score these have. Without labels of both classes all
scores are the share of label 1, or 1 without labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from parlance.llm.labels import labelled_sample
from parlance.llm.tables import carried, restored, rows_where
from parlance.llm.words import BLANK, Words, blocks, mix

ROWS_PER_CLASS = 6000
MAX_TRAIN_BYTES = 1 << 20
TREES, DEPTH, BINS = 120, 4, 64
LEARNING_RATE, L2, MIN_ROWS, SEED = 0.12, 2.0, 8, 7

STATISTICS = [
    "log_words", "bytes_per_word", "words_per_line", "letters", "upper", "digits", "high", "punctuation", "marks", "symbols", "pipes",
    "full_stops", "commas", "distinct_bytes", "byte_entropy", "top_byte", "distinct_words", "top_word", "word_entropy", "repeats",
    "distinct_pairs", "distinct_runs", "short_words", "long_words", "longest_word", "plain_words", "capital_words", "upper_words",
    "repeated_lines", "length_spread", "pieces_per_word", "link_marks",
]


def _bytes(values: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(values.encode("latin-1"), np.uint8)] = True
    return out


def _span(a: int, b: int) -> np.ndarray:
    return (np.arange(256) >= a) & (np.arange(256) <= b)


_CLASSES = {
    "letters": _span(0x41, 0x5A) | _span(0x61, 0x7A) | _span(0x80, 0xFF), "upper": _span(0x41, 0x5A), "digits": _span(0x30, 0x39), "high": _span(0x80, 0xFF),
    "punctuation": _bytes(".,;:!?'\"()-"), "marks": _bytes("!?"), "symbols": _bytes("#$%&*+/<=>@[\\]^_`{}~"), "pipes": _bytes("|"),
    "full_stops": _bytes("."), "commas": _bytes(","), "link_marks": _bytes("/:@"),
}


def _entropy_and_share(value: np.ndarray, text: np.ndarray, n: int, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: distinct values over all, share of the most frequent, entropy over its greatest possible."""
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    count, owner = np.diff(np.append(at, len(value))), text[at]
    distinct = np.bincount(owner, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, owner, count)
    all_ = np.maximum(total, 1)
    share = count / all_[owner]
    entropy = np.bincount(owner, -share * np.log(share), minlength=n)
    return distinct / all_, top / all_, entropy / np.maximum(np.log(all_), 1)


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of ``STATISTICS`` per text."""
    n = len(texts)
    w = Words(texts, BLANK)
    raw = np.frombuffer(w.raw, np.uint8)
    owner = np.repeat(np.arange(n), w.lengths + 1)[:len(raw)]
    inside = np.ones(len(raw), bool)
    inside[(w.offsets + w.lengths)[:-1]] = False  # separators between the texts
    counts = np.bincount(owner[inside] * 256 + raw[inside], minlength=n * 256).reshape(n, 256)
    size = np.maximum(w.lengths, 1)
    words, of = np.maximum(w.counts, 1), w.text_of_word()
    out = {name: counts @ which / size for name, which in _CLASSES.items()}
    lines = counts[:, 10] + 1
    out["log_words"] = np.log1p(w.counts)
    out["bytes_per_word"] = w.lengths / words
    out["words_per_line"] = np.log1p(w.counts / lines)
    share = counts / size[:, None]
    out["distinct_bytes"] = (counts > 0).sum(axis=1) / 256
    out["byte_entropy"] = -(share * np.log(np.where(share > 0, share, 1))).sum(axis=1)
    counts[:, 32] = 0
    out["top_byte"] = counts.max(axis=1) / size if n else np.zeros(0)
    h = w.hashes
    out["distinct_words"], out["top_word"], out["word_entropy"] = _entropy_and_share(h, of, n, w.counts)
    same = of[1:] == of[:-1]
    out["repeats"] = np.bincount(of[1:][same & (h[1:] == h[:-1])], minlength=n) / words
    pair = mix(h[1:] + mix(h[:-1]))[same]
    out["distinct_pairs"] = _entropy_and_share(pair, of[1:][same], n, np.maximum(w.counts - 1, 0))[0]
    run = mix(h[:-4] + mix(h[2:-2] + mix(h[4:]))) if len(h) > 4 else h[:0]
    run_in = of[4:] == of[:-4] if len(h) > 4 else np.zeros(0, bool)
    out["distinct_runs"] = _entropy_and_share(run[run_in], of[:len(run)][run_in], n, np.maximum(w.counts - 4, 0))[0]
    length = w.ends - w.starts
    out["short_words"] = np.bincount(of[length <= 2], minlength=n) / words
    out["long_words"] = np.bincount(of[length > 14], minlength=n) / words
    longest = np.zeros(n)
    np.maximum.at(longest, of, length)
    out["longest_word"] = np.log1p(longest)
    mean = np.bincount(of, length, minlength=n) / words
    out["length_spread"] = np.sqrt(np.maximum(np.bincount(of, length.astype(float) ** 2, minlength=n) / words - mean ** 2, 0))
    # Bytes of every word by class, through cumulative counts.
    plain = np.concatenate([[0], np.cumsum(_CLASSES["letters"][raw])])
    upper = np.concatenate([[0], np.cumsum(_CLASSES["upper"][raw])])
    letters_in, upper_in = plain[w.ends] - plain[w.starts], upper[w.ends] - upper[w.starts]
    out["plain_words"] = np.bincount(of[letters_in >= length - 1], minlength=n) / words
    out["capital_words"] = np.bincount(of[(upper_in == 1) & (length > 1)], minlength=n) / words
    out["upper_words"] = np.bincount(of[(upper_in > 1) & (upper_in * 2 >= letters_in)], minlength=n) / words
    out["pieces_per_word"] = np.bincount(of, length - letters_in, minlength=n) / words
    # Lines by the sum of their words' hashes.
    line = np.concatenate([[0], np.cumsum(raw == 10)])[w.starts] if len(raw) else np.zeros(0, np.int64)
    first = np.ones(len(line), bool)
    first[1:] = (line[1:] != line[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(first)
    total = np.add.reduceat(mix(h + np.uint64(9)), at) if len(at) else h[:0]
    used = np.bincount(of[at], minlength=n)
    out["repeated_lines"] = np.where(used > 0, 1 - _entropy_and_share(total, of[at], n, used)[0], 0)
    return np.column_stack([out[name] for name in STATISTICS]).astype(np.float64) if n else np.zeros((0, len(STATISTICS)))


class Trees:
    """Complete binary trees in arrays: inner node i has children 2i + 1 and 2i + 2."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, base: float):
        self.feature, self.threshold, self.leaf, self.base = feature, threshold, leaf, base

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        every = np.arange(len(rows))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(rows), np.int64)
            while inner and node.size and node[0] < inner:  # all rows are on one level
                node = 2 * node + 1 + (rows[every, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit_trees(rows: np.ndarray, label: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS,
              rate: float = LEARNING_RATE, l2: float = L2, min_rows: int = MIN_ROWS) -> Trees:
    """Logistic boosting by second-order gain over histograms of binned features."""
    n, features = rows.shape
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(features)]
    binned = np.column_stack([np.searchsorted(e, rows[:, f], side="left") for f, e in enumerate(edges)])
    share = min(max(label.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    inner = 2 ** depth - 1
    feature, threshold = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, 2 ** depth))
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - label, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2 ** level, 2 ** level - 1
            best = np.full(width, 1e-6)
            local = node - first
            for f in range(features):
                if not len(edges[f]):
                    continue
                key = local * bins + binned[:, f]
                g, h, c = (np.bincount(key, x, width * bins).reshape(width, bins).cumsum(axis=1) for x in (grad, hess, np.ones(n)))
                ga, ha, ca = g[:, -1:], h[:, -1:], c[:, -1:]
                gain = g ** 2 / (h + l2) + (ga - g) ** 2 / (ha - h + l2) - ga ** 2 / (ha + l2)
                gain = np.where((c >= min_rows) & (ca - c >= min_rows), gain, 0)[:, :len(edges[f])]
                cut = gain.argmax(axis=1)
                better = gain[np.arange(width), cut] > best
                best = np.where(better, gain[np.arange(width), cut], best)
                feature[t, first:first + width][better] = f
                threshold[t, first:first + width][better] = edges[f][cut[better]]
            node = 2 * node + 1 + (rows[np.arange(n), feature[t, node]] > threshold[t, node])
        at = node - inner
        leaf[t] = -rate * np.bincount(at, grad, 2 ** depth) / (np.bincount(at, hess, 2 ** depth) + l2)
        margin += leaf[t][at]
    return Trees(feature, threshold, leaf, base)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                rows_per_class: int = ROWS_PER_CLASS, max_bytes: int = MAX_TRAIN_BYTES) -> Trees:
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, rows_per_class, max_bytes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks(frames, "_text"):
            yield pd.DataFrame({"_id": frame["_id"], "_label": frame["_label"], "x": list(statistics(list(frame["_text"])))})

    got = sample.mapInPandas(run, "_id string, _label int, x array<double>").collect()
    got.sort(key=lambda r: (r["_id"], r["x"]))
    label = np.array([r["_label"] for r in got], float)
    if not len(label) or label.min() == label.max():
        share = min(max(label.mean() if len(label) else 1.0, 1e-9), 1 - 1e-9)
        return Trees(np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 1)), float(np.log(share / (1 - share))))
    rows = np.array([r["x"] for r in got])
    # The sample holds the classes evenly; the base odds are those of the sample.
    return fit_trees(rows, label)


def score_quality(docs: DataFrame, id_col: str, text_col: str, trees: Trees) -> DataFrame:
    """``id_col`` and ``score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks(frames, "_text"):
            yield pd.DataFrame({"_id": frame["_id"], "score": shared.value.score(statistics(list(frame["_text"])))})

    return restored(carried(docs, id_col, text_col).mapInPandas(run, "_id string, score double"), docs, id_col)


def keep_good(docs: DataFrame, text_col: str, trees: Trees, threshold: float) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    return rows_where(docs, text_col, lambda texts: shared.value.score(statistics(texts)) >= threshold)
