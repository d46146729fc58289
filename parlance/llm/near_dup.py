"""Near-duplicate groups by SuperMinHash signatures, banding, exact
verification and union-find.

A text's set is its distinct ``k``-word shingles. Two texts are linked if
100 * |A & B| >= ``percent`` * |A | B|; a text's component is the smallest id
reachable over links.

1. One pass over the texts, inside the tasks that read them: a 128-bit
   fingerprint of the word sequence, the set size and the band keys of a
   SuperMinHash signature (``signatures``). Equal sequences collapse to one
   node, the smallest id, so copies of one text cost one row each from here.
2. A node's hub is the smallest node it shares a band key with. Its text goes
   to the cell of its hub, once; a hub with more than ``CELL_BYTES`` of texts
   has several cells, each with a copy of the hub's text. Inside a cell the
   full sets are compared exactly (``link_sets``), and at most one link per
   text leaves it. Families of near copies hang together after this pass.
3. What is left are pairs that share a band key, lie in different components
   so far and have not met. The texts of such pairs alone are dealt to cells,
   one for every two blocks that hold any of them, and compared in the same way.
   A block is one cell's texts linked with the hub, or up to ``CELL_BYTES`` of
   its hub's other texts. No transitive closure of mere candidates is built.
4. The links of both passes are joined into components.

Chance of missing two texts at similarity s: (1 - s**ROWS)**BANDS, 3e-7 at 0.85 and 6e-5
at 0.8; two texts at 0.5 meet with chance 0.4, at 0.3 with 0.02. There is no cap on
buckets, partners or candidates.

Null and empty texts have no shingles and are linked with nothing. A text of
fewer than ``k`` words has its whole sequence as its one shingle. Rows that
repeat an id are one node with several texts. A null id stays alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.tables import carried, utf8, written
from parlance.llm.words import BLANK, Words, blocks, distinct_by_text, mix, seeds, shingle_hashes

SHINGLE = 5
BANDS, ROWS = 32, 6
#: Text of one block; a cell holds two blocks.
CELL_BYTES = 2 << 20
#: The side of nodes that are compared with all of their cell.
ALL = 2


def super_min_hash(value: np.ndarray, text: np.ndarray, texts: int, size: int) -> np.ndarray:
    """SuperMinHash signatures (texts x size, uint64) of the sets given as
    (value, text) pairs sorted by text.

    Element d offers component p(j) of its own random permutation p the value
    j + r(j), with r(j) uniform in [0, 1): the ranks of one element are
    correlated, which spreads its offers over the components. Step j runs for
    all elements at once. A text stops as soon as all its components are
    below j + 1, for all later offers are larger (early stopping).
    Components are fixed-point: the step above 32 bits of r.
    """
    out = np.full((texts, size), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    has = np.zeros(texts, bool)
    has[text] = True
    live, perm = np.arange(len(value)), None
    for j in range(size):
        bits = mix(value[live] + seeds(size, 31)[j])
        low = bits & np.uint64(0xFFFFFFFF)
        pick = j + (((bits >> np.uint64(32)) * np.uint64(size - j)) >> np.uint64(32)).astype(np.int64)
        if perm is None:
            component = pick
        else:  # Fisher-Yates: swap places j and pick
            row = np.arange(len(live))
            component = perm[row, pick].astype(np.int64)
            perm[row, pick] = perm[:, j]
        np.minimum.at(flat, text[live] * size + component, (np.uint64(j) << np.uint64(32)) | low)
        unfinished = has & (out.max(axis=1) >= np.uint64((j + 1) << 32))
        if not unfinished.any():
            break
        stay = unfinished[text[live]]
        if perm is None:
            live, first = live[stay], pick[stay]
            perm = np.tile(np.arange(size, dtype=np.int16), (len(live), 1))
            perm[np.arange(len(live)), first] = 0
        else:
            live, perm = live[stay], perm[stay]
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, different for equal values in different bands."""
    out = np.empty((len(signature), bands), np.uint64)
    coef = seeds(bands * rows, 47) | np.uint64(1)
    for b in range(bands):
        acc = np.full(len(signature), b + 1, np.uint64)
        for r in range(b * rows, (b + 1) * rows):
            acc = acc + mix(signature[:, r] + coef[r]) * coef[r]
        out[:, b] = mix(acc)
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: ``_id`` (text), ``fingerprint`` (null without words), ``n_shingles``, ``n_bytes`` and ``keys``."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks(frames, "_text"):
            texts = list(frame["_text"])
            words = Words(texts, BLANK)
            value, text = distinct_by_text(*shingle_hashes(words, k))
            sizes = np.bincount(text, minlength=len(texts))
            keys = band_keys(super_min_hash(value, text, len(texts), bands * rows), bands, rows).view(np.int64)
            yield pd.DataFrame({
                "_id": frame["_id"],
                "fingerprint": [hashlib.blake2b(b" ".join(t.translate(BLANK).split()), digest_size=16).digest() if n else None for t, n in zip(texts, sizes, strict=True)],
                "n_shingles": sizes, "n_bytes": [len(t) for t in texts],
                "keys": [row if n else [] for row, n in zip(keys, sizes, strict=True)],
            })

    return carried(docs, id_col, text_col).mapInPandas(run, "_id string, fingerprint binary, n_shingles bigint, n_bytes bigint, keys array<bigint>")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the smallest node of
    its component, by alternating large-star and small-star steps. Edges are
    written after every round; hubs are joined by the planner's skew handling
    and never gathered."""
    both = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        # Large star: every larger neighbour points at the smallest neighbour (or the node itself).
        pairs = edges.select(F.inline(both))
        low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = pairs.join(low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # Small star: a node and its smaller neighbours point at the smallest.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.inline(F.array(F.struct(F.col("m").alias("a"), "b"), F.struct(F.col("m").alias("a"), F.col("a").alias("b"))))).where("a <> b")
        edges = written(small.distinct(), name)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
    return edges.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root").unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def link_sets(sets: list[np.ndarray], percent: int, block: np.ndarray | None = None, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning set of the links between texts with sorted distinct shingles
    ``sets``: enough links that exactly the linked texts are connected.

    Only texts that share one of their rarest shingles can be linked (prefix
    filter: of n shingles, the n - ceil(t n) + 1 rarest). Texts are compared
    in the order of fewest own shingles, each with all candidates it is not
    connected with yet; so the centre of a family of near copies connects it
    at once. With ``block``, only texts of different blocks are compared.
    Texts of equal ``known`` count as connected already.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    value = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    _, ident, df = np.unique(value, return_inverse=True, return_counts=True)
    # Shingles in the order of their frequency; position in each text's own order.
    order = np.lexsort((ident, df[ident], owner))
    owner, ident = owner[order], ident[order]
    start = np.cumsum(sizes) - sizes
    place = np.arange(len(owner)) - start[owner]
    least = -(-sizes * percent // 100)
    in_prefix = (place < (sizes - least + 1)[owner]) & (df[ident] > 1)
    shared = df[ident] > 1
    own = sizes - np.bincount(owner[shared], minlength=n)

    # Postings of prefix shingles, and of all shared shingles for the counts.
    def postings(mask):
        by = np.argsort(ident[mask], kind="stable")
        ids = ident[mask][by]
        return ids, owner[mask][by]

    prefix_ids, prefix_owner = postings(in_prefix)
    all_ids, all_owner = postings(shared)
    root = np.arange(n)
    if known is not None:
        _, first, code = np.unique(known, return_index=True, return_inverse=True)
        root = first[code]
    parent = root.tolist()

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def gather(ids, ids_sorted, owners):
        lo, hi = np.searchsorted(ids_sorted, ids), np.searchsorted(ids_sorted, ids, side="right")
        count = hi - lo
        return owners[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]

    links = []
    has_prefix = np.zeros(n, bool)
    has_prefix[prefix_owner] = True
    for x in np.lexsort((np.arange(n), own)):
        if not has_prefix[x]:
            continue
        mine = slice(start[x], start[x] + sizes[x])
        own_ids = ident[mine][in_prefix[mine]]
        candidates = np.zeros(n, bool)
        candidates[gather(own_ids, prefix_ids, prefix_owner)] = True
        candidates &= (sizes * 100 >= sizes[x] * percent) & (sizes[x] * 100 >= sizes * percent) & (root != root[x])
        if block is not None:
            candidates &= block != block[x]
        if not candidates.any():
            continue
        shared_ids = ident[mine][shared[mine]]
        common = np.bincount(gather(shared_ids, all_ids, all_owner), minlength=n)
        linked = np.flatnonzero(candidates & (100 * common >= percent * (sizes + sizes[x] - common)))
        for y in linked.tolist():
            a, b = find(int(x)), find(y)
            if a != b:
                parent[b] = a
                links.append((int(x), y))
        if len(linked):
            merged = np.isin(root, root[linked]) | (root == root[x])
            root[merged] = root[x]
    return links


def _cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole cells from rows sorted by cell."""
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        key = frame["cell"].to_numpy()
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        bounds = [0, *cut.tolist()]
        for b, e in zip(bounds[:-1], bounds[1:], strict=True):
            yield frame.iloc[b:e]
        rest = frame.iloc[bounds[-1]:]
    if rest is not None and len(rest):
        yield rest


def hub_cells(nodes: DataFrame, cell_bytes: int) -> DataFrame:
    """(node, n_bytes, hub, chunks, chunk) of every node that shares a band
    key with another: ``hub`` is the smallest node it shares one with (itself
    included), ``chunk`` of ``chunks`` its cell among the hub's."""
    members = nodes.select("node", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("high")).where("hub < high").drop("high")
    hubs = members.join(buckets, "key").groupBy("node").agg(F.min("hub").alias("hub"))
    sizes = nodes.groupBy("node").agg(F.sum("n_bytes").alias("n_bytes"))
    located = hubs.join(sizes, "node")
    chunks = located.groupBy("hub").agg(F.greatest(F.ceil(F.sum("n_bytes") / cell_bytes), F.lit(1)).cast("int").alias("chunks"))
    return located.join(chunks, "hub").select("node", "n_bytes", "hub", "chunks", F.pmod(F.xxhash64("node"), "chunks").cast("int").alias("chunk"))


def unmet(nodes: DataFrame, cells: DataFrame, known: DataFrame, cell_bytes: int) -> DataFrame:
    """(node, cell, side, known) that bring together every two nodes which
    share a band key, are of different components and have not been compared:
    a node goes to the cell of its own and another block if the other block
    holds such a node.

    Per key, the component with most nodes never meets its own blocks: nodes
    meet the blocks of other components, and only nodes of other components
    meet its blocks. So a family of near copies that holds a third of all rows
    costs the product of its size and that of the texts not yet linked with it.
    """
    comps = cells.join(known, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    placed = comps.join(comps.select(F.col("node").alias("hub"), F.col("comp").alias("of_hub")), "hub").withColumn("main", F.col("comp") == F.col("of_hub"))
    apart = placed.where("NOT main").groupBy("hub").agg(F.ceil(F.sum("n_bytes") / cell_bytes).cast("int").alias("parts"))
    placed = placed.join(apart, "hub", "left").select(
        "node", "hub", "chunks", "comp",
        F.concat_ws(":", "hub", F.when(F.col("main"), F.concat(F.lit("m"), F.col("chunk"))).otherwise(
            F.pmod(F.xxhash64("node"), F.greatest("parts", F.lit(1))).cast("string"))).alias("block"))
    held = nodes.select("node", "keys").join(placed, "node").select("*", F.explode("keys").alias("key")).drop("keys")
    mixed = held.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(
        F.max_by("comp", F.struct("n", "comp")).alias("most"), F.count(F.lit(1)).alias("comps")).where("comps > 1").drop("comps")
    held = written(held.join(mixed, "key"), "near-mixed")
    there = held.groupBy("key", F.col("block").alias("other"), F.col("hub").alias("other_hub"), "most").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("node").alias("one"), F.max("node").alias("last"))
    home = (F.col("low") == F.col("most")) & (F.col("high") == F.col("most"))
    meets = held.join(there.where(~home).drop("most"), "key").unionByName(
        held.where("comp <> most").join(there.where(home).drop("most"), "key"))
    met = (
        ((F.col("hub") == F.col("other_hub")) & (F.col("chunks") == 1))  # all of a hub's only cell
        | (F.col("node") == F.col("other_hub"))  # a hub with its cells
        | ((F.col("one") == F.col("hub")) & (F.col("last") == F.col("hub")))  # a node with its hub
    )
    pairs = meets.where(((F.col("comp") != F.col("low")) | (F.col("comp") != F.col("high"))) & ~met).select("node", "comp", "block", "other").distinct()
    return pairs.select(
        "node", F.concat_ws("/", F.least("block", "other"), F.greatest("block", "other")).alias("cell"),
        F.when(F.col("block") == F.col("other"), ALL).otherwise((F.col("block") > F.col("other")).cast("int")).alias("side"), F.col("comp").alias("known"))


def compared(texts: DataFrame, dealt: DataFrame, percent: int, k: int) -> DataFrame:
    """A spanning set of the links (a, b) between the nodes of every cell.
    Nodes of one ``side`` are not compared, unless it is ``ALL``; nodes of
    equal ``known`` are linked already. ``dealt`` is written first, so that its
    size is known when the texts are joined: while it is small they stay in
    place, and only those dealt are shuffled."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = [], []
        for cell in _cells(frames):
            side, node = cell["side"].to_numpy(), cell["node"].to_numpy()
            across = side[0] != ALL
            if len(cell) < 2 or across and (side == side[0]).all():
                continue
            words = Words(list(cell["_text"]), BLANK)
            value, text = distinct_by_text(*shingle_hashes(words, k))
            sets = np.split(value, np.searchsorted(text, np.arange(1, len(cell))))
            for x, y in link_sets(sets, percent, side if across else None, cell["known"].to_numpy()):
                a.append(node[x])
                b.append(node[y])
            if len(a) > 50_000:
                yield pd.DataFrame({"a": a, "b": b})
                a, b = [], []
        yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return texts.join(written(dealt, "near-dealt"), "node").repartition("cell").sortWithinPartitions("cell").mapInPandas(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, percent: int = 80, k: int = SHINGLE,
                    bands: int = BANDS, rows: int = ROWS, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """Per row: ``id_col`` (an integer), ``n_shingles``, ``component_id`` and ``kept``."""
    signed = written(signatures(docs, id_col, text_col, k, bands, rows).withColumn("id", F.col("_id").cast("bigint")).drop("_id"), "near-signatures")
    real = signed.where("fingerprint IS NOT NULL AND id IS NOT NULL")
    # One node per distinct sequence: its smallest id.
    nodes = written(real.groupBy("fingerprint").agg(F.min("id").alias("node"), F.max("n_bytes").alias("n_bytes"), F.first("keys").alias("keys")), "near-nodes")
    # An id with several texts links their nodes.
    same_id = real.select("id", "fingerprint").distinct().join(nodes.select("fingerprint", "node"), "fingerprint").where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"))

    texts = docs.select(F.col(id_col).cast("bigint").alias("node"), utf8(text_col).alias("_text"))
    cells = written(hub_cells(nodes, cell_bytes), "near-cells")
    # The texts that share a key with another, shuffled out of all once and alike at every size; both passes read these alone.
    texts = written(texts.join(cells.select("node").hint("merge"), "node", "left_semi"), "near-texts")
    # First pass: every text once, in its hub's cell, and the hub in all its cells.
    busy = cells.groupBy("hub", "chunks").agg(F.max(F.col("node") != F.col("hub")).alias("others")).where("others").drop("others")
    first = cells.join(busy, ["hub", "chunks"], "left_semi").select("node", "hub", "chunk").unionByName(
        busy.select(F.col("hub").alias("node"), "hub", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))).distinct()
    dealt = first.select("node", F.concat_ws(":", "hub", "chunk").alias("cell"), F.lit(ALL).alias("side"), F.col("node").alias("known"))
    known = written(components(compared(texts, dealt, percent, k).unionByName(same_id), "near-first"), "near-known")
    # Second pass: the pairs that share a key and are neither connected nor compared.
    links = compared(texts, unmet(nodes, cells, known, cell_bytes), percent, k)
    linked = written(components(links.unionByName(known.select(F.col("root").alias("a"), F.col("node").alias("b"))), "near-links"), "near-components")

    found = nodes.join(linked, "node", "left").select("fingerprint", F.coalesce("root", "node").alias("component"))
    return (
        signed.join(found, "fingerprint", "left")
        .select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_shingles",
                F.coalesce("component", "id").cast(docs.schema[id_col].dataType).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
    )


def keep_one(docs: DataFrame, id_col: str, text_col: str, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their component: the row of its
    smallest id (of rows that repeat this id, the first by text). Rows with a
    null id stay."""
    ids = near_duplicates(docs, id_col, text_col, percent).where(F.col("kept") & F.col(id_col).isNotNull()).select(id_col).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    first = Window.partitionBy("id").orderBy("text")
    one = rows.join(ids.toDF("id"), "id", "left_semi").withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return one.select("row.*").unionByName(docs.where(F.col(id_col).isNull()))
