"""Words of whole texts as numpy arrays, for the operators that score, index
or compare texts inside Arrow batches.

A block of texts is joined into one byte buffer, mapped through a 256-entry
table (lower-casing A-Z, turning separators into spaces) and cut into words by
vector operations, so no Python loop runs per word. Words are identified by a
64-bit polynomial hash of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

SPACE = 0x20
# Bytes of text gathered before a block is processed; one longer text is a block of its own.
BLOCK_BYTES = 1 << 20
# Bytes hashed at once, cut at word boundaries.
SLICE_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def _table(keep) -> bytes:
    out = bytearray()
    for b in range(256):
        low = b + 32 if 0x41 <= b <= 0x5A else b
        out.append(low if keep(low) else SPACE)
    return bytes(out)


#: Words of ASCII letters, digits and all characters above U+007F.
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: Words of everything but space and U+0009 to U+000D.
BLANK = _table(lambda b: b != SPACE and not 0x09 <= b <= 0x0D)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (uint64 to uint64), used wherever hashed bits must look random."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_LETTERS = seeds(256, 77)
_POWERS: dict[str, np.ndarray] = {}


def _powers(kind: str, base: int, n: int) -> np.ndarray:
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 4096)
        out = np.empty(size, np.uint64)
        out[0], filled = 1, 1
        while filled < size:  # doubling: out[k + j] = base**k * out[j]
            step = min(filled, size - filled)
            out[filled:filled + step] = out[:step] * np.uint64(pow(base, filled, 1 << 64))
            filled += step
        if size > SLICE_BYTES + 4096:
            return out  # for one giant word; not kept
        _POWERS[kind] = have = out
    return have


def _hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        base = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
        n = int(ends[last - 1]) - base
        terms = _LETTERS[buf[base:base + n]] * _powers("up", _BASE, n)[:n]
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(terms, out=total[1:])
        s, e = starts[first:last] - base, ends[first:last] - base
        out[first:last] = (total[e] - total[s]) * _powers("down", _BASE_INV, n)[s]
        first = last
    return mix(out + (ends - starts).astype(np.uint64))


class Words:
    """The words of a block of texts: ``starts``/``ends`` into ``buf``, the
    64-bit ``hashes`` and, per text, the range ``first[i]:first[i + 1]``."""

    def __init__(self, texts: list[bytes], table: bytes, hashed: bool = True):
        self.raw = b" ".join(texts)
        joined = self.raw.translate(table)
        self.bytes = joined
        buf = np.frombuffer(joined, np.uint8)
        self.buf = buf
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(lengths + 1)])[:len(texts)] if len(texts) else np.zeros(0, np.int64)
        self.lengths = lengths
        edge = np.empty(len(buf) + 1, np.int8)
        inside = (buf != SPACE).view(np.int8)
        edge[1:-1] = inside[1:] - inside[:-1] if len(buf) else 0
        if len(buf):
            edge[0], edge[-1] = inside[0], -inside[-1]
        else:
            edge[:] = 0
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.append(np.searchsorted(self.starts, self.offsets), len(self.starts)).astype(np.int64)
        self.counts = np.diff(self.first)
        self.hashes = _hash(buf, self.starts, self.ends) if hashed else None

    def word(self, i: int) -> bytes:
        return self.bytes[self.starts[i]:self.ends[i]]

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def shingle_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k-word shingle of every text and the text's index; a text
    with 1 to k - 1 words has its whole sequence as its one shingle."""
    n, h = len(words.starts), words.hashes
    parts = []
    coef = seeds(k, 5) | np.uint64(1)
    texts = words.text_of_word()
    if n >= k:
        acc = h[:n - k + 1] * coef[0]
        for j in range(1, k):
            acc = acc + mix(h[j:n - k + 1 + j] + np.uint64(j)) * coef[j]
        whole = texts[:n - k + 1] == texts[k - 1:]
        parts.append((mix(acc[whole]), texts[:n - k + 1][whole]))
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        acc = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = words.counts[short] > j
            acc[has] += mix(h[words.first[short[has]] + j] + np.uint64(j + 100)) * coef[j]
        parts.append((mix(acc + words.counts[short].astype(np.uint64)), short))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value, text = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(text, kind="stable")
    return value[order], text[order]


def distinct_by_text(value: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, value) pairs, sorted by text and value."""
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    if not len(value):
        return value, text
    new = np.empty(len(value), bool)
    new[0] = True
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[new], text[new]


def blocks(frames: Iterator[pd.DataFrame], text: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[pd.DataFrame]:
    """Cut Arrow batches into blocks of about ``block_bytes`` of text. The
    text column holds UTF-8 bytes; null becomes empty."""
    for frame in frames:
        texts = [t if t is not None else b"" for t in frame[text]]
        frame = frame.assign(**{text: texts})
        lengths = np.cumsum([len(t) for t in texts]) if texts else np.zeros(0)
        begin = 0
        while begin < len(texts):
            done = lengths[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(lengths, done + block_bytes, side="right")))
            yield frame.iloc[begin:end].reset_index(drop=True)
            begin = end
