"""Approximate nearest neighbours by a permutation index.

A bounded sample of ``PIVOTS`` vectors serves as pivots (the rows first by the
hash of their id), in their directions. Every vector is represented by its
``PREFIX`` nearest pivots in order, computed once and stored, and posted, with
its rank, in the inverted file of each. A query reads the inverted files of
its own pivots and ranks what it finds by the footrule distance of the two
pivot orders, pivots beyond the prefix counting as rank PREFIX. The order
tells directions alone, and the inner product also grows with the length, so
the rank is by how much nearer than the block's average a vector is by
footrule, times its length; for vectors of one length this is the order of the
footrule distance. The first ``RERANK`` of a block are reranked by the exact
measure, the inner product in double precision.

Every row is indexed. The index is cut into blocks by the hash of the id, the
queries likewise; each pair of a query block and an index block is one task
group that holds both in memory, and only the best ``k`` of a query leave it.
A repeated or very common vector spreads over the blocks like any other.
A block's share is reranked whatever its size, so a small table is searched
as a large one is, except that at least ``k`` + 1 of a block are reranked.

Vectors of each length (number of components) are searched apart, with pivots
of their own. Vectors that are null, zero, or hold null or non-finite
components take no part; nor do null ids. Rows that repeat an id are one
candidate with the best of their scores. Ties go to the smaller id. With
fewer than ``k`` candidates all are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.tables import written

PIVOTS, PREFIX = 256, 64
#: Share of a block that is reranked.
RERANK = 0.18
BLOCK_ROWS, QUERY_ROWS = 8192, 4096


def pivot_orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` nearest pivots of every vector, nearest first."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :prefix]


class InvertedFiles:
    """Per pivot: the weight (prefix less rank) that it has in the order of every vector, 0 beyond its prefix."""

    def __init__(self, orders: np.ndarray, pivots: int):
        n, prefix = orders.shape
        # Wide enough for a whole sum of weights.
        self.weight = np.zeros((pivots, n), np.uint16 if prefix < 256 else np.int64)
        self.weight[orders.ravel(), np.repeat(np.arange(n), prefix)] = np.tile(prefix - np.arange(prefix), n)
        self.own = (prefix - np.arange(prefix)).astype(self.weight.dtype)[:, None]
        self.lists = np.empty((prefix, n), self.weight.dtype)

    def nearness(self, order: np.ndarray) -> np.ndarray:
        """prefix * (prefix + 1) less the footrule distance, halved, to every
        vector: the sum over shared pivots of prefix less the greater rank."""
        np.take(self.weight, order, axis=0, out=self.lists, mode="clip")
        np.minimum(self.lists, self.own, out=self.lists)
        return np.add.reduce(self.lists, axis=0, dtype=self.lists.dtype)


def leading(score: np.ndarray, ids: np.ndarray, k: int, slack: float) -> np.ndarray:
    """Places of all rows that can be among the best ``k`` ids, where every score is off by ``slack`` at most."""
    size = 2 * k
    while size < len(score) and np.isfinite(score).all():
        first = np.argpartition(-score, size)[:size]
        if len(np.unique(ids[first])) >= k:
            return np.flatnonzero(score >= score[first].min() - 2 * slack)
        size *= 4
    return np.arange(len(score))


def search_block(ids: np.ndarray, vectors: np.ndarray, orders: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, query_orders: np.ndarray,
                 pivots: int, k: int, rerank: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of the best ``k`` found in the block per query."""
    files, lengths = InvertedFiles(orders, pivots), np.sqrt((vectors ** 2).sum(axis=1))
    count = min(len(ids), max(math.ceil(rerank * len(ids)), k + 1))
    # Either order of addition is off by less than this times the query's length.
    rounding = 2 * vectors.shape[1] * np.finfo(float).eps * lengths.max()
    out = []
    for query, own, order in zip(queries, query_ids, query_orders, strict=True):
        near = files.nearness(order)
        near = (near - near.mean()) * lengths
        found = np.argpartition(-near, count - 1)[:count] if count < len(ids) else np.arange(len(ids))
        found = found[ids[found] != own]
        # All are measured; those that can be among the best are added up from the first component on, whatever the block looks like.
        found = found[leading(vectors[found] @ query, ids[found], k, rounding * np.sqrt((query ** 2).sum()))]
        score = np.cumsum(vectors[found] * query, axis=1)[:, -1]
        best = found[np.lexsort((ids[found], -score))]
        score = np.sort(score)[::-1]
        # An id may be repeated: its best row counts.
        _, first = np.unique(ids[best], return_index=True)
        first = np.sort(first)[:k]
        out.append((np.full(len(first), own), ids[best[first]], score[first]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _with_orders(rows: DataFrame, pivots: dict[int, np.ndarray], prefix: int) -> DataFrame:
    """Add ``o``, the pivot order of every vector ``v``."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            orders = pd.Series([None] * len(frame), index=frame.index, dtype=object)
            for d, part in frame.groupby("d"):
                found = pivot_orders(np.stack(part["v"]), shared.value[d], min(prefix, len(shared.value[d])))
                orders[part.index] = pd.Series(list(found.astype(np.int32)), index=part.index)
            yield frame.assign(o=orders)

    return rows.mapInPandas(run, "id bigint, v array<double>, q boolean, d int, o array<int>")


def nearest(vectors: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int = 20, pivots: int = PIVOTS, prefix: int = PREFIX,
            rerank: float = RERANK, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the nearest found to every query row."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.exists("v", lambda x: x != 0)
        & F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))).withColumn("d", F.size("v"))
    schema = "query_id bigint, vec_id bigint, score double"
    spark = vectors.sparkSession
    # A row per length of vectors, and a bounded sample of each.
    sizes = {r["d"]: (r["n"], r["nq"]) for r in rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("q").cast("int")).alias("nq")).where("nq > 0").collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    first = Window.partitionBy("d").orderBy(F.xxhash64("id"), "id", "v")
    sample = rows.where(F.col("d").isin(*sizes)).withColumn("r", F.row_number().over(first)).where(F.col("r") <= pivots).select("d", "r", "v").collect()
    own = {d: np.array([r["v"] for r in sorted((r for r in sample if r["d"] == d), key=lambda r: r["r"])]) for d in sizes}
    own = {d: v / np.sqrt((v ** 2).sum(axis=1, keepdims=True)) for d, v in own.items()}
    counts = {d: len(v) for d, v in own.items()}
    indexed = written(_with_orders(rows.where(F.col("d").isin(*sizes)), own, prefix), "permutation-index")
    blocks = {d: (math.ceil(n / block_rows), math.ceil(nq / query_rows)) for d, (n, nq) in sizes.items()}

    def of_length(i: int) -> Column:
        """The number of index (0) or query (1) blocks of a row's length."""
        return F.element_at(F.create_map(*[F.lit(x) for d, b in blocks.items() for x in (d, b[i])]), F.col("d"))

    def block(n: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(17), "id"), n).cast("int")

    def every(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    index = indexed.select("d", "id", "v", "o", block(of_length(0)).alias("b"), every(of_length(1)).alias("qb"))
    queries = indexed.where("q").select("d", "id", "v", "o", block(of_length(1)).alias("qb"), every(of_length(0)).alias("b"))

    def run(frame: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(frame) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        found = search_block(frame["id"].to_numpy(), np.stack(frame["v"]), np.stack(frame["o"]), asked["id"].to_numpy(), np.stack(asked["v"]), np.stack(asked["o"]),
                             counts[int(frame["d"].iloc[0])], k, rerank)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    found = index.groupBy("d", "b", "qb").cogroup(queries.groupBy("d", "b", "qb")).applyInPandas(run, schema)
    # Queries of a length are all in it, but an id may be repeated with another.
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
