"""Toxicity: a bidirectional gated recurrent network with attention pooling,
over word and character inputs, trained and run in numpy.

A text's windows are all its runs of ``WINDOW`` words (a shorter text is one
window); each is scored, whatever the text's length, and a text's score is
its highest window, so every passage of up to WINDOW words is seen whole. A word's input is an embedding, if the fit knows the
word, beside the mean embedding of its character trigrams (computed once per
distinct word of a block); both directions of gated recurrent units run over
the inputs, attention weighs a window's states and inputs into one vector,
and a logistic unit scores it.

The recurrence is shared by neighbouring windows: it runs over segments of
``SEGMENT`` words, which overlap by WINDOW - 1, so that every window lies
whole in one segment, the last that begins before it or with it. Attention
then pools each of the segment's windows apart. Fit and score do the same.

The fit uses a bounded sample of labelled rows (``ROWS_PER_CLASS`` of each
class, texts up to ``MAX_TRAIN_BYTES``) on the driver. Only whole texts are
labelled, so each round picks the highest window of every text (and a random
one of the clean texts) and takes gradient
steps on these. The first component of a word's embedding starts as the log odds of texts that hold
it. The weights, a few megabytes at most by VOCABULARY, are broadcast.

Only the text is an input of a score. Null and empty texts, and texts without
words, are one empty window. Without labels of both classes every score is
the share of label 1, or 0 without labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from parlance.llm.labels import labelled_sample
from parlance.llm.tables import carried, restored, rows_where
from parlance.llm.words import ALNUM, Words, blocks

WINDOW, SEGMENT = 24, 48
#: Windows of a segment, and words between the begins of two segments.
STEP = SEGMENT - WINDOW + 1
WORD_SIZE, CHAR_SIZE, HIDDEN, ATTENTION = 8, 8, 8, 8
TRIGRAMS = 2048
VOCABULARY = 20_000
LEAST_TEXTS = 3
ROWS_PER_CLASS = 1500
MAX_TRAIN_BYTES = 20_000
ROUNDS, LEAST_STEPS, BATCH, RATE, DECAY, SEED = 8, 500, 64, 0.01, 1e-4, 11
#: Segments that run through the network at once.
CHUNK = 2048


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _scatter(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``rows`` (their last axis stays) by ``index`` into ``n`` rows."""
    width = rows.shape[-1]
    flat = (index.reshape(-1, 1) * width + np.arange(width)).ravel()
    return np.bincount(flat, rows.ravel(), n * width).reshape(n, width).astype(np.float32)


class Block:
    """Distinct words of a block of texts with their trigrams, and its segments
    as indexes of distinct words (the last index is the padding)."""

    def __init__(self, texts: list[bytes]):
        w = Words(texts, ALNUM)
        self.hashes, where, index = np.unique(w.hashes, return_index=True, return_inverse=True)
        starts, ends = w.starts[where], w.ends[where]
        size = ends - starts
        at = np.repeat(starts, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        # The bytes beside a word's are spaces: trigrams know its begin and end.
        padded = np.concatenate([[32], w.buf, [32]]).astype(np.int64)
        self.trigrams = (padded[at] * 7919 + padded[at + 1] * 104729 + padded[at + 2] * 1299709) % TRIGRAMS
        self.trigram_begin, self.trigram_count = np.cumsum(size) - size, size
        # A text's segments begin every STEP words until its last word is inside one.
        n = 1 + np.maximum(0, -(-(w.counts - SEGMENT) // STEP))
        self.texts, self.owner = len(texts), np.repeat(np.arange(len(texts)), n)
        begin = STEP * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        left = w.counts[self.owner] - begin
        place = (w.first[:-1][self.owner] + begin)[:, None] + np.arange(SEGMENT)
        index = np.append(index, len(self.hashes)).astype(np.int32)
        self.segments = np.where(np.arange(SEGMENT) < left[:, None], index[np.minimum(place, len(index) - 1)], np.int32(len(self.hashes)))
        #: How many windows begin in the segment: one in a text shorter than a window.
        self.windows = np.clip(left - WINDOW + 1, 1, STEP)


class Network:
    def __init__(self, vocabulary: np.ndarray, odds: np.ndarray):
        """``vocabulary``: sorted word hashes; ``odds``: their log odds."""
        rng = np.random.default_rng(SEED)
        inputs, states = WORD_SIZE + CHAR_SIZE, WORD_SIZE + CHAR_SIZE + 2 * HIDDEN

        def normal(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.vocabulary = vocabulary
        words = (0.1 * rng.standard_normal((len(vocabulary) + 1, WORD_SIZE))).astype(np.float32)
        words[:, 0] = np.append(odds, 0)  # the last row is the unknown word
        self.p = {
            "words": words, "chars": (0.1 * rng.standard_normal((TRIGRAMS, CHAR_SIZE))).astype(np.float32),
            "Wa": normal(states, ATTENTION), "ba": np.zeros(ATTENTION, np.float32), "va": normal(ATTENTION),
            "wo": normal(states), "bo": np.full(1, -1, np.float32),
        }
        for d in "fb":
            self.p |= {"W" + d: normal(inputs, 3 * HIDDEN), "U" + d: normal(HIDDEN, 3 * HIDDEN), "b" + d: np.zeros(3 * HIDDEN, np.float32)}

    def inputs(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Inputs of the distinct words (a zero row for the padding) and their rows in the embedding."""
        if len(self.vocabulary):
            row = np.searchsorted(self.vocabulary, block.hashes)
            row = np.where(self.vocabulary[np.minimum(row, len(self.vocabulary) - 1)] == block.hashes, row, len(self.vocabulary))
        else:
            row = np.zeros(len(block.hashes), np.int64)
        out = np.zeros((len(block.hashes) + 1, WORD_SIZE + CHAR_SIZE), np.float32)
        out[:-1, :WORD_SIZE] = self.p["words"][row]
        if len(block.hashes):
            out[:-1, WORD_SIZE:] = np.add.reduceat(self.p["chars"][block.trigrams], block.trigram_begin) / block.trigram_count[:, None]
        return out, row

    def _scan(self, d: str, projected: np.ndarray, mask: np.ndarray, keep: bool):
        """States of one direction, (steps, segments, HIDDEN); padding leaves the state as it is."""
        steps = range(SEGMENT) if d == "f" else range(SEGMENT - 1, -1, -1)
        U, H = self.p["U" + d], HIDDEN
        h = np.zeros((projected.shape[1], H), np.float32)
        out, saved = np.empty((SEGMENT, len(h), H), np.float32), {}
        for t in steps:
            u = h @ U
            zr = _sigmoid(projected[t, :, :2 * H] + u[:, :2 * H])
            z, r = zr[:, :H], zr[:, H:]
            c = np.tanh(projected[t, :, 2 * H:] + r * u[:, 2 * H:])
            if keep:
                saved[t] = (h, z, r, c, u[:, 2 * H:])
            h = h + (mask[t][:, None] * (1 - z)) * (c - h)
            out[t] = h
        return out, saved

    def _attention(self, x: np.ndarray, segments: np.ndarray, keep: bool):
        """Of every place (steps, segments): whether it is a word, its state, its attention's inner and outer value."""
        index = segments.T
        mask = (index < len(x) - 1).astype(np.float32)
        states, saved = [], {}
        for d in "fb":
            projected = (x @ self.p["W" + d] + self.p["b" + d])[index]
            out, saved[d] = self._scan(d, projected, mask, keep)
            states.append(out)
        s = np.concatenate([*states, x[index]], axis=2)
        a = np.tanh(s @ self.p["Wa"] + self.p["ba"])
        return index, mask, s, a, a @ self.p["va"], saved

    def forward(self, x: np.ndarray, segments: np.ndarray, first: np.ndarray, keep: bool = False):
        """Logits of the windows that begin at the places ``first`` of segments of distinct-word indexes into inputs ``x``."""
        index, mask, s, a, e, saved = self._attention(x, segments, keep)
        place = np.arange(SEGMENT)[:, None]
        inside = mask * ((place >= first) & (place < first + WINDOW))
        e = np.exp(e - np.where(inside > 0, e, -np.inf).max(axis=0, initial=-1e9)) * inside if inside.any() else np.zeros_like(e)
        weight = e / np.maximum(e.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tns->ns", weight, s)
        logit = pooled @ self.p["wo"] + self.p["bo"][0]
        return logit, (index, mask, s, a, weight, pooled, saved)

    def window_logits(self, x: np.ndarray, segments: np.ndarray) -> np.ndarray:
        """Logits (segments, STEP) of the windows at every place of the segments, as ``forward`` gives them."""
        _, mask, s, _, e, _ = self._attention(x, segments, False)
        e = np.exp(np.maximum(e - e.max(axis=0), -60)) * mask
        worth = e * (s @ self.p["wo"])
        total, weight = np.zeros((STEP, len(segments)), np.float32), np.zeros((STEP, len(segments)), np.float32)
        for j in range(WINDOW):
            total += worth[j:j + STEP]
            weight += e[j:j + STEP]
        return (total / np.maximum(weight, 1e-30)).T + self.p["bo"][0]

    def backward(self, x: np.ndarray, kept, dlogit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weights and of the inputs."""
        index, mask, s, a, weight, pooled, saved = kept
        H, p, g = HIDDEN, self.p, {}
        g["wo"], g["bo"] = pooled.T @ dlogit, np.array([dlogit.sum()], np.float32)
        dpooled = dlogit[:, None] * p["wo"]
        ds = weight[:, :, None] * dpooled
        dweight = np.einsum("tns,ns->tn", s, dpooled)
        de = weight * (dweight - (weight * dweight).sum(axis=0))
        g["va"] = np.einsum("tn,tna->a", de, a)
        da = de[:, :, None] * p["va"] * (1 - a * a)
        g["Wa"], g["ba"] = np.einsum("tns,tna->sa", s, da), da.sum(axis=(0, 1))
        ds = ds + da @ p["Wa"].T
        dx = _scatter(index, ds[:, :, 2 * H:], len(x))
        for k, d in enumerate("fb"):
            dstate = ds[:, :, k * H:(k + 1) * H]
            dprojected = np.zeros((*index.shape, 3 * H), np.float32)
            U, dU = p["U" + d], np.zeros_like(p["U" + d])
            dh = np.zeros((index.shape[1], H), np.float32)
            for t in (range(SEGMENT - 1, -1, -1) if d == "f" else range(SEGMENT)):
                h, z, r, c, uc = saved[d][t]
                dh = dh + dstate[t]
                m = mask[t][:, None]
                dz, dc = dh * m * (h - c) * z * (1 - z), dh * m * (1 - z) * (1 - c * c)
                dr = dc * uc * r * (1 - r)
                du = np.concatenate([dz, dr, dc * r], axis=1)
                dprojected[t] = np.concatenate([dz, dr, dc], axis=1)
                dU += h.T @ du
                dh = dh * (1 - m * (1 - z)) + du @ U.T
            g["U" + d], g["b" + d] = dU, dprojected.sum(axis=(0, 1))
            per_word = _scatter(index, dprojected, len(x))
            g["W" + d] = x.T @ per_word
            dx += per_word @ p["W" + d].T
        return g, dx

    def logits(self, block: Block) -> np.ndarray:
        """(segments, STEP) of a block; -inf where no window begins."""
        x, _ = self.inputs(block)
        out = np.concatenate([self.window_logits(x, block.segments[i:i + CHUNK]) for i in range(0, len(block.segments), CHUNK)] or [np.zeros((0, STEP))])
        out[np.arange(STEP) >= block.windows[:, None]] = -np.inf
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Scores of a block of texts; equal ones are scored once."""
        if not texts:
            return np.zeros(0)
        place = {t: i for i, t in enumerate(dict.fromkeys(texts))}
        block = Block(list(place))
        best = np.full(block.texts, -np.inf)
        np.maximum.at(best, block.owner, self.logits(block).max(axis=1))
        return _sigmoid(best)[[place[t] for t in texts]]


class Constant:
    def __init__(self, share: float):
        self.share = share

    def score(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.share)


def _odds(block: Block, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words in at least LEAST_TEXTS texts (the VOCABULARY most frequent) and their smoothed log odds."""
    words = len(block.hashes)
    held = np.unique(np.repeat(block.owner, SEGMENT) * (words + 1) + block.segments.ravel())
    text, word = held // (words + 1), held % (words + 1)
    text, word = text[word < words], word[word < words]
    n1 = np.bincount(word, label[text], minlength=words)
    n0 = np.bincount(word, minlength=words) - n1
    keep = np.flatnonzero(n0 + n1 >= LEAST_TEXTS)
    keep = np.sort(keep[np.argsort(-(n0 + n1)[keep], kind="stable")][:VOCABULARY])
    prior = 3.0
    odds = np.log((n1 + prior) / (label.sum() + 2 * prior)) - np.log((n0 + prior) / ((1 - label).sum() + 2 * prior))
    return block.hashes[keep], np.clip(odds[keep], -3, 3).astype(np.float32)


def fit_network(texts: list[bytes], label: np.ndarray, rounds: int = ROUNDS):
    if not len(label) or label.min() == label.max():
        return Constant(float(label.mean()) if len(label) else 0.0)
    block = Block(texts)
    net = Network(*_odds(block, label))
    rng = np.random.default_rng(SEED + 1)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step, known = 0, len(net.vocabulary)
    # All windows of all texts as (segment, place).
    segment = np.repeat(np.arange(len(block.segments)), block.windows)
    place = np.arange(len(segment)) - np.repeat(np.cumsum(block.windows) - block.windows, block.windows)
    owner = block.owner[segment]
    first = np.searchsorted(owner, np.arange(block.texts))
    count = np.diff(np.append(first, len(owner)))
    clean = np.flatnonzero(label == 0)
    batches = max(1, (block.texts + len(clean)) // BATCH)
    passes = -(-LEAST_STEPS // (rounds * batches))  # small samples are passed more often
    # Rare toxic texts weigh more, up to half of the clean ones together.
    heavier = np.where(label == 1, np.clip(0.5 * len(clean) / label.sum(), 1, 4), 1)
    for round_ in range(rounds):
        if round_:
            value = net.logits(block)[segment, place]
        else:
            x, _ = net.inputs(block)
            odds = x[:, 0][block.segments]
            value = np.max([odds[segment, np.minimum(place + j, SEGMENT - 1)] for j in range(WINDOW)], axis=0)
        order = np.lexsort((-value, owner))
        top = order[first]
        other = first[clean] + (rng.random(len(clean)) * count[clean]).astype(np.int64)
        pick = np.concatenate([top, other])
        target = np.concatenate([label, np.zeros(len(clean))]).astype(np.float32)
        weight = np.concatenate([heavier, np.ones(len(clean))])
        for at in (at for _ in range(passes) for at in np.array_split(rng.permutation(len(pick)), batches)):
            # The distinct words of this batch alone.
            used, local = np.unique(block.segments[segment[pick[at]]], return_inverse=True)
            part = _subset(block, used)
            x, row = net.inputs(part)
            logit, kept = net.forward(x, local.reshape(len(at), SEGMENT), place[pick[at]], keep=True)
            g, dx = net.backward(x, kept, (weight[at] * (_sigmoid(logit) - target[at]) / len(at)).astype(np.float32))
            dx = dx[:len(part.hashes)]
            g["words"] = _scatter(row, dx[:, :WORD_SIZE], known + 1)
            g["words"][known:] *= 0.1  # the unknown word stands for many
            g["chars"] = _scatter(part.trigrams, np.repeat(dx[:, WORD_SIZE:] / part.trigram_count[:, None], part.trigram_count, axis=0), TRIGRAMS)
            step += 1
            rate = RATE * (1 - 0.9 * round_ / rounds)
            for k, v in net.p.items():
                m, s = moments[k]
                m += 0.1 * (g[k] - m)
                s += 0.001 * (g[k] ** 2 - s)
                v -= (rate * ((m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8) + DECAY * v)).astype(np.float32)
    return net


def _subset(block: Block, used: np.ndarray) -> Block:
    """The distinct words ``used`` of a block, without segments."""
    used = used[used < len(block.hashes)]
    out = object.__new__(Block)
    out.hashes = block.hashes[used]
    out.trigram_count = block.trigram_count[used]
    out.trigram_begin = np.cumsum(out.trigram_count) - out.trigram_count
    n = out.trigram_count
    out.trigrams = block.trigrams[np.repeat(block.trigram_begin[used], n) + np.arange(n.sum()) - np.repeat(out.trigram_begin, n)]
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                 rows_per_class: int = ROWS_PER_CLASS, max_bytes: int = MAX_TRAIN_BYTES):
    rows = labelled_sample(docs, labels, id_col, text_col, label_col, rows_per_class, max_bytes).collect()
    rows.sort(key=lambda r: (r["_id"], r["_text"]))
    return fit_network([bytes(r["_text"]) for r in rows], np.array([r["_label"] for r in rows], np.float64))


def score_toxicity(docs: DataFrame, id_col: str, text_col: str, model) -> DataFrame:
    """``id_col`` and ``score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks(frames, "_text"):
            yield pd.DataFrame({"_id": frame["_id"], "score": shared.value.score(list(frame["_text"]))})

    return restored(carried(docs, id_col, text_col).mapInPandas(run, "_id string, score double"), docs, id_col)


def keep_clean(docs: DataFrame, text_col: str, model, threshold: float) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows_where(docs, text_col, lambda texts: shared.value.score(texts) < threshold)
