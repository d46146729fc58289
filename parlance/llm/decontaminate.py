"""Benchmark decontamination with an FM-index per training shard.

A test item's windows are its runs of ``window`` consecutive words (an item
with fewer words is one window). Each task gathers the words of its documents
into shards. A shard's text is the stretches of words that occur in any
window, with separators in place of everything else (a window cannot reach
over a word that no window has, so nothing is lost). Over that text stand a
suffix array, its Burrows-Wheeler transform in a wavelet matrix with rank
counts, and suffix positions sampled every ``SAMPLE`` places. All windows are
searched backwards at once; occurrences are located by walking back to a
sampled position; overlapping spans are merged per document.

The windows go to the executors as a broadcast block, packed in arrays, of items
holding at most ``block_bytes`` of text, and the documents are not shuffled. A larger test set
goes block by block, the driver holding one at a time: every block's hits are
written and brought together by the row's number before anything is merged or
cut, so the result does not depend on ``block_bytes``.

Null and empty texts have no words and are never hit; null and empty items
have no windows. Equal items are all reported. Documents are handled row by
row, so repeated ids do not interfere.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.tables import carried, ranges, restored, utf8, written
from parlance.llm.words import ALNUM, Words, blocks
from parlance.session import scratch_path

WINDOW = 10
SAMPLE = 8
#: Text of documents per FM-index; one longer document is a shard of its own.
SHARD_BYTES = 4 << 20
#: Text of test items broadcast at once.
BLOCK_BYTES = 16 << 20

SPANS = "spans array<struct<first: bigint, end: bigint>>, items array<string>"


class Windows:
    """The distinct windows of a block of items, packed: per length a matrix
    of symbols, a window a row, and the items of every window as one array
    with offsets. It is built once, on the driver, and broadcast; it takes
    some ``4 * (window + 2)`` bytes a word of the items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        # The vocabulary is bounded by the block's bytes.
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({item for item, _ in items})
        number = {item: i for i, item in enumerate(self.items)}
        sequences, owner = [], []
        for item, text in items:
            words = (text or b"").translate(ALNUM).split()
            if words:
                sequences.append(np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words), np.int32, len(words)))
                owner.append(number[item])
        #: (length, first window's number, matrix) of every length.
        self.groups: list[tuple[int, int, np.ndarray]] = []
        lengths, owners, offsets = [], [], [np.zeros(1, np.int64)]
        sizes = np.array([min(len(q), window) for q in sequences], np.int64)
        first = held = 0
        for length in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == length).tolist()
            rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(sequences[i], length) for i in mine])
            item = np.concatenate([np.full(len(sequences[i]) - length + 1, owner[i], np.int32) for i in mine])
            order = np.lexsort((item, *rows.T[::-1]))
            rows, item = rows[order], item[order]
            new = np.append(True, (rows[1:] != rows[:-1]).any(axis=1))
            again = ~new & np.append(False, item[1:] == item[:-1])  # a window that its item repeats
            window_of = (np.cumsum(new) - 1)[~again]
            self.groups.append((length, first, np.ascontiguousarray(rows[new])))
            counts = np.bincount(window_of)
            owners.append(item[~again])
            offsets.append(held + np.cumsum(counts))
            lengths.append(np.full(len(counts), length, np.int64))
            first, held = first + len(counts), held + len(window_of)
        self.lengths = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        self.owner, self.offset = np.concatenate(owners) if owners else np.zeros(0, np.int32), np.concatenate(offsets)
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0

    def items_of(self, windows: np.ndarray) -> set[str]:
        """The items of any of these windows."""
        own = [self.owner[self.offset[w]:self.offset[w + 1]] for w in windows.tolist()]
        return {self.items[i] for i in np.unique(np.concatenate(own)).tolist()} if own else set()


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling over 64-bit keys (rank, next rank)."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[:n - step] = rank[step:] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order
        step *= 2


class WaveletMatrix:
    """Rank and access over a sequence of small integers, one bit plane a level."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before ``position``, elementwise."""
        begin, end = np.zeros_like(position), position.copy()
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            set_ = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            b, e = ones[begin], ones[end]
            begin = np.where(set_, zeros + b, begin - b)
            end = np.where(set_, zeros + e, end - e)
        return end - begin

    def access(self, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at ``position`` and its occurrences before it."""
        symbol, at, begin = np.zeros_like(position), position.copy(), np.zeros_like(position)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            o, b = ones[at], ones[begin]
            bit = ones[at + 1] - o
            symbol = symbol * 2 + bit
            at = np.where(bit == 1, zeros + o, at - o)
            begin = np.where(bit == 1, zeros + b, begin - b)
        return symbol, at - begin


class FMIndex:
    def __init__(self, text: np.ndarray):
        """``text``: positive symbols, 0 for separators. Inside, all are one
        higher and a single 0 ends the text, so walking back is one-to-one."""
        text = np.append(text + 1, 0)
        order = suffix_array(text)
        before = text[order - 1]
        self.n = len(text)
        self.symbols = int(text.max()) + 1
        self.wavelet = WaveletMatrix(before, max(1, int(self.symbols - 1).bit_length()))
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])
        sampled = order % SAMPLE == 0
        self.sampled_before = np.concatenate([[0], np.cumsum(sampled)])
        self.samples = order[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array ranges of equally long patterns (rows), by backward search."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for column in patterns.T[::-1]:
            symbol = column[live].astype(np.int64) + 1
            known = symbol < self.symbols
            low[live[~known]] = high[live[~known]] = 0
            live, symbol = live[known], symbol[known]
            low[live] = self.smaller[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.smaller[symbol] + self.wavelet.rank(symbol, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows: walk back to a sampled one."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        left, rows = np.arange(len(rows)), rows.copy()
        while len(left):
            here = self.sampled_before[rows + 1] > self.sampled_before[rows]
            out[left[here]] = self.samples[self.sampled_before[rows[here]]] + steps[left[here]]
            left, rows = left[~here], rows[~here]
            if len(left):
                symbol, occurrence = self.wavelet.access(rows)
                rows = self.smaller[symbol] + occurrence
                steps[left] += 1
        return out


def occurrences(windows: Windows, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (window, position) of the windows in the symbols ``text``."""
    if not len(windows.lengths) or not len(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    index = FMIndex(text)
    found_w, found_p = [], []
    for _, first, patterns in windows.groups:
        low, high = index.search(patterns)
        n = high - low
        rows = np.repeat(low, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        found_w.append(np.repeat(first + np.arange(len(patterns)), n))
        found_p.append(index.locate(rows))
    return np.concatenate(found_w), np.concatenate(found_p)


def _merged(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping or touching spans, sorted by begin, as their unions."""
    out: list[tuple[int, int]] = []
    for b, e in zip(begin.tolist(), end.tolist(), strict=True):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((b, e))
    return out


def _hits(windows: Windows, texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int]], set[str], list[tuple[int, int]]]]:
    """Per text: word count, hit word spans, items, and the spans in bytes."""
    tokens = [t.translate(ALNUM).split() for t in texts]
    counts = np.array([len(t) for t in tokens], np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    get = windows.vocabulary.get
    symbols = np.fromiter((get(w, 0) for t in tokens for w in t), np.int64, int(first[-1]))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    if len(symbols) and windows.shortest:
        # Runs of known words inside one document, long enough for a window.
        doc = np.repeat(np.arange(len(texts)), counts)
        cut = np.flatnonzero((np.diff(doc) != 0) | ((symbols[1:] == 0) != (symbols[:-1] == 0))) + 1
        begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(symbols)]])
        keep = (symbols[begin] > 0) & (end - begin >= windows.shortest)
        begin, end = begin[keep], end[keep]
        if len(begin):
            size = end - begin + 1  # with a separator after each run
            offset = np.cumsum(size) - size
            place = np.repeat(begin - offset, size) + np.arange(size.sum())
            text = np.where(np.arange(size.sum()) == np.repeat(offset + size - 1, size), 0, symbols[np.minimum(place, len(symbols) - 1)])
            window, position = occurrences(windows, text)
            at = place[position]
            owner = doc[at]
            order = np.lexsort((at, owner))
            window, at, owner = window[order], at[order], owner[order]
            for d in np.unique(owner):
                lo, hi = np.searchsorted(owner, [d, d + 1])
                local = at[lo:hi] - first[d]
                spans[d] = _merged(local, local + windows.lengths[window[lo:hi]])
                items[d] = windows.items_of(np.unique(window[lo:hi]))
    for i, t in enumerate(texts):
        yield int(counts[i]), spans[i], items[i], _edges(t, spans[i])


def _edges(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans of a text as spans of its bytes."""
    if not spans:
        return []
    w = Words([text], ALNUM, hashed=False)
    return [(int(w.starts[b]), int(w.ends[e - 1])) for b, e in spans]


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks whose texts hold at most ``block_bytes`` (one larger
    item is a block of its own). Rows stream to the driver partition by
    partition; null and empty items are left out."""
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), utf8(text_col).alias("t")).where(F.length("t") > 0)
    block: list[tuple[str, bytes]] = []
    size = 0
    for row in items.toLocalIterator():
        if block and size + len(row["t"]) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row["i"] or "", bytes(row["t"])))
        size += len(row["t"])
    yield block


def only_block(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[tuple[str, bytes]] | None:
    """The items, if they are one block."""
    found = item_blocks(benchmark, item_col, text_col, block_bytes)
    block = next(found)
    return block if next(found, None) is None else None


def hits_by_row(rows: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, window: int, block_bytes: int) -> DataFrame:
    """``_row``, merged ``spans`` and ``items`` over all blocks of items, of the rows (``_row``, ``_text``) that are hit."""
    spark = rows.sparkSession
    path = scratch_path(spark, "block-hits")
    for block in item_blocks(benchmark, item_col, item_text, block_bytes):
        shared = spark.sparkContext.broadcast(Windows(block, window))

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            windows = shared.value
            for frame in blocks(frames, "_text", SHARD_BYTES):
                hit = [(r, [{"first": b, "end": e} for b, e in s], sorted(i)) for r, (_, s, i, _) in zip(frame["_row"], _hits(windows, list(frame["_text"])), strict=True) if s]
                yield pd.DataFrame(hit, columns=["_row", "spans", "items"])

        rows.mapInPandas(run, f"_row bigint, {SPANS}").write.mode("append").parquet(path)
        shared.destroy()
    found = spark.read.schema(f"_row bigint, {SPANS}").parquet(path).groupBy("_row").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            both = [np.array([(s["first"], s["end"]) for s in spans], np.int64) for spans in frame["spans"]]
            yield frame.assign(spans=[[{"first": b, "end": e} for b, e in _merged(s[:, 0], s[:, 1])] for s in both])

    return written(found.mapInPandas(merge, f"_row bigint, {SPANS}"), "hits")


def find_hits(docs: DataFrame, id_col: str, text_col: str, benchmark: DataFrame, item_col: str, item_text: str,
              window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: ``id_col``, ``n_words``, ``spans`` (merged hit
    word ranges, end exclusive) and ``items`` (sorted ids of items with an
    occurring window)."""
    block = only_block(benchmark, item_col, item_text, block_bytes)
    if block is None:
        def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield frame.assign(n_words=[len(t.translate(ALNUM).split()) for t in frame["_text"]]).drop(columns="_text")

        rows = written(carried(docs, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "numbered")
        found = hits_by_row(rows.select("_row", "_text"), benchmark, item_col, item_text, window, block_bytes)
        out = rows.mapInPandas(count, "_id string, _row bigint, n_words bigint").join(found, "_row", "left").select(
            "_id", "n_words", *(F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c) for c in ("spans", "items")))
        return restored(out, docs, id_col)
    shared = docs.sparkSession.sparkContext.broadcast(Windows(block, window))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows = shared.value
        for frame in blocks(frames, "_text", SHARD_BYTES):
            found = list(_hits(windows, list(frame["_text"])))
            yield pd.DataFrame({"_id": frame["_id"], "n_words": [n for n, _, _, _ in found], "spans": [[{"first": b, "end": e} for b, e in s] for _, s, _, _ in found],
                                "items": [sorted(i) for _, _, i, _ in found]})

    return restored(carried(docs, id_col, text_col).mapInPandas(run, f"_id string, n_words bigint, {SPANS}"), docs, id_col)


def remove_hits(docs: DataFrame, text_col: str, benchmark: DataFrame, item_col: str, item_text: str,
                window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with every hit span cut out of the text; the cut leaves one
    line break. Words that come together over a cut may form a window again,
    so changed texts are searched, for all items, until nothing is hit. Texts
    that are not hit are returned as they are; rows of which nothing is left
    are dropped."""
    block = only_block(benchmark, item_col, item_text, block_bytes)
    if block is None:
        return _remove_by_blocks(docs, text_col, benchmark, item_col, item_text, window, block_bytes)
    schema = docs.schema
    column = schema.names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(Windows(block, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            values = batch.column(column)
            texts = values.cast(pa.binary()).to_pylist()
            changed: set[int] = set()
            for at, end in ranges(texts, SHARD_BYTES):
                todo = [i for i in range(at, end) if texts[i]]
                while todo:
                    edges = [e for _, _, _, e in _hits(windows, [texts[i] for i in todo])]
                    todo = [i for i, e in zip(todo, edges, strict=True) if e]
                    for i, e in zip(todo, filter(None, edges), strict=True):
                        texts[i] = _without(texts[i], e)
                        changed.add(i)
            if changed:
                batch = batch.set_column(column, batch.schema.field(column), pa.array(texts, pa.binary()).cast(values.type))
                batch = batch.filter(pa.array([i not in changed or bool(t) for i, t in enumerate(texts)], pa.bool_()))
            yield batch

    return docs.mapInArrow(run, schema)


def _remove_by_blocks(docs: DataFrame, text_col: str, benchmark: DataFrame, item_col: str, item_text: str, window: int, block_bytes: int) -> DataFrame:
    """``remove_hits`` for items of several blocks: a round cuts what any block hits, the next searches the cut texts."""
    numbered = written(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("_row")), "numbered")
    texts = numbered.select("_row", utf8(f"row.{text_col}").alias("_text"))
    cut_texts = None

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"_row": frame["_row"], "_text": [
                _without(t, _edges(t, [(s["first"], s["end"]) for s in spans])) for t, spans in zip(frame["_text"], frame["spans"], strict=True)]})

    while True:
        found = hits_by_row(texts, benchmark, item_col, item_text, window, block_bytes)
        if found.isEmpty():
            break
        texts = written(texts.join(found, "_row").mapInPandas(cut, "_row bigint, _text binary"), "cut")
        cut_texts = texts if cut_texts is None else written(texts.unionByName(cut_texts.join(texts, "_row", "left_anti")), "cut-texts")
    if cut_texts is None:
        return numbered.select("row.*")
    rows = numbered.join(cut_texts, "_row", "left").where("_text IS NULL OR length(_text) > 0")
    return rows.select(*(
        F.coalesce(F.col("_text").cast(docs.schema[c].dataType), F.col(f"row.{c}")).alias(c) if c == text_col else F.col(f"row.{c}") for c in docs.columns))


def _without(text: bytes, edges: list[tuple[int, int]]) -> bytes:
    kept, last = [], 0
    for b, e in edges:
        kept.append(text[last:b])
        last = e
    kept.append(text[last:])
    return b"\n".join(p for p in (k.strip() for k in kept) if p)
