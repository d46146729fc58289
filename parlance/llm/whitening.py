"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Every entry c of a vector becomes the whole number ``floor(64 c) + 1000000``.
The fit list is each distinct vector of these numbers once; ``A`` is its
matrix of rows less their mean. The bidiagonalisation builds orthonormal
columns V (of the vectors' length, on the driver) and U (of the fit list's
length, never stored: U = A S for a small matrix S) with U'A V bidiagonal:

* ``P = A Q`` and ``A'P``, the two alternating products, are summed over the
  rows in one pass, with ``P'P`` and ``U'P``. Q is the newest columns of V
  less their parts along U, so P is new to U up to rounding, which the
  products ``U'P`` take out: U is fully reorthogonalised.
* ``A'U`` of the new columns, less its parts along all of V (twice), gives the
  next columns of V. Where nothing is left (a space closed early, equal
  deviations), random columns orthogonal to V go on.

Columns come in blocks of ``BLOCK``, the block form of the method, so a fit
takes about length / BLOCK passes; with a block of 1 it is the plain form. The fit
ends when V spans the whole space, or when the residuals of the leading
components are at rounding level. The singular vectors of the small matrix
U'AV turn V into components, its singular values are the deviations times
the root of n.

A task reads Arrow batches and returns sums, which Spark adds up; only
matrices of the vectors' length by the number of columns reach the driver.

Rows whose vector is null or holds null, non-finite or huge entries (beyond
2^54, which have no long) take no part; nor do empty vectors. Vectors of each
length are fitted apart. Components whose variance is 0 at rounding level are
left out: a table of equal vectors gives no rows. Repeated rows count once in
the fit and each get their own rows; null ids are kept. Means are subtracted
in whole numbers, so large offsets cost no precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.tables import written

SCALE, OFFSET = 64, 1_000_000
BLOCK = 8
#: Entries are at most this on the grid.
LARGEST = float(1 << 60)
#: Residual of a component, and of a new column, against the largest deviation.
RESIDUAL, NEW = 1e-14, 1e-11
#: A block whose squared lengths differ more is orthonormalised in another pass.
EVEN = 1e-4


def grid(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + OFFSET)


def usable(vector: Column) -> Column:
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) * SCALE < LARGEST, F.lit(False))), F.lit(False))


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    values = batch.column(batch.schema.get_field_index(column)).flatten().to_numpy(zero_copy_only=False)
    return values.reshape(batch.num_rows, -1)


@dataclass
class Centre:
    """The mean S / n in whole numbers: ``whole`` + ``rest`` / n."""
    n: int
    whole: np.ndarray
    rest: np.ndarray

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum of (n x - S)^2 per row, exact."""
        less = x - self.whole
        bound = int(np.abs(less).max(initial=0)) * self.n + self.n
        if bound * bound * x.shape[1] < 1 << 63:
            return [int(v) for v in ((self.n * less - self.rest) ** 2).sum(axis=1)]
        return [sum((self.n * int(v) - int(r)) ** 2 for v, r in zip(row, self.rest, strict=True)) for row in less]


def _summed(rows: DataFrame, length: int, products) -> np.ndarray:
    """The sum of ``products(x)`` (a vector of ``length`` numbers) over the batches of ``x``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for batch in batches:
            if batch.num_rows:
                total += products(_matrix(batch, "x"))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(length, dtype=np.int64)), pa.array(total)], ["i", "v"])

    sums = rows.select("x").mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(length)
    for r in sums:
        out[r["i"]] = r["v"]
    return out


def centre_of(fit: DataFrame, d: int) -> Centre:
    """Exact column sums: the high and the low 31 bits apart, so that no sum overflows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, "x")
                n += len(x)
                high, low = (x >> 31).sum(axis=0), (x & ((1 << 31) - 1)).sum(axis=0)
                total = [t + (int(h) << 31) + int(lo) for t, h, lo in zip(total, high, low, strict=True)]
        values = pa.array([str(v) for v in [*total, n]], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int64()), values], ["i", "v"])

    got = fit.select("x").mapInArrow(run, "i bigint, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("string").alias("v")).collect()
    sums = {r["i"]: int(r["v"]) for r in got}
    n = sums[d]
    return Centre(n, np.array([sums[j] // n for j in range(d)], np.int64), np.array([sums[j] % n for j in range(d)], np.int64))


@dataclass
class Components:
    centre: Centre
    #: One unit column per component, their variances, and the trace of the covariance.
    columns: np.ndarray
    variances: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centre.rows(x) @ self.columns / np.sqrt(self.variances)


def _orthonormal(w: np.ndarray, v: np.ndarray, least: float) -> np.ndarray:
    """An orthonormal basis of the columns of ``w`` beyond ``v``; what is shorter than ``least`` is nothing."""
    for _ in range(2):
        w = w - v @ (v.T @ w)
    left, size, _ = np.linalg.svd(w, full_matrices=False)
    left = left[:, size > least]
    left = left - v @ (v.T @ left)
    return np.linalg.qr(left)[0] if left.shape[1] else left


def bidiagonalise(fit: DataFrame, centre: Centre, d: int, k: int, block: int = BLOCK, seed: int = 0) -> Components:
    """The ``k`` leading components of the rows ``x`` of ``fit``."""
    rng = np.random.default_rng(seed)
    trace = float(_summed(fit, 1, lambda x: np.array([(centre.rows(x) ** 2).sum()]))[0])
    v = np.linalg.qr(rng.standard_normal((d, min(block, d))))[0]  # all columns of V
    new = v                                                       # the newest of them
    s = np.zeros((d, 0))                                          # U = A S
    w = np.zeros((d, 0))                                          # W = A'U, so U'A V = W'V
    scale = np.sqrt(trace) or 1.0
    least = NEW * scale
    while trace > 0:
        q = new - s @ (w.T @ new)
        b, held = q.shape[1], s.shape[1]

        def products(x, q=q, s=s):
            a = centre.rows(x)
            p = a @ q
            return np.concatenate([(a.T @ p).ravel(), (p.T @ p).ravel(), ((a @ s).T @ p).ravel()])

        sums = _summed(fit, d * b + b * b + held * b, products)
        ap, pp, up = sums[:d * b].reshape(d, b), sums[d * b:d * b + b * b].reshape(b, b), sums[d * b + b * b:].reshape(held, b)
        # Take the parts along U out of P, then orthonormalise what is left by its Gram matrix.
        q, ap, pp = q - s @ up, ap - w @ up, pp - up.T @ up
        size, turn = np.linalg.eigh((pp + pp.T) / 2)
        some = size > least ** 2
        turn = turn[:, some] / np.sqrt(size[some])
        if some.any() and size[some].min() < EVEN * size[some].max():
            # Columns of very uneven length: their Gram matrix is exact only once they are about orthonormal.
            new, least = q @ turn, 0.0
            continue
        s, w, least = np.hstack([s, q @ turn]), np.hstack([w, ap @ turn]), NEW * scale

        small = w.T @ v
        _, deviations, right = np.linalg.svd(small, full_matrices=False)
        missing = d - v.shape[1]
        if not missing:
            break
        new = _orthonormal(w[:, held:], v, NEW * scale)
        if new.shape[1]:
            # A component's residual is the part of A'U u beyond V.
            left, sizes, _ = np.linalg.svd(small, full_matrices=False)
            beyond = np.linalg.norm((w - v @ (v.T @ w)) @ left, axis=0)
            if len(sizes) >= k and (beyond[:k] <= RESIDUAL * scale).all() and v.shape[1] >= 2 * k + 2 * block:
                break
        if new.shape[1] < min(block, missing):
            # Nothing left in some direction: go on with random columns, so that equal deviations and closed spaces are all found.
            more = rng.standard_normal((d, min(block, missing) - new.shape[1]))
            new = np.hstack([new, _orthonormal(more, np.hstack([v, new]), 1e-8)])
        v = np.hstack([v, new])
    if trace <= 0:
        return Components(centre, np.zeros((d, 0)), np.zeros(0), trace)
    some = deviations[:k] > 4 * d * np.finfo(float).eps * deviations[0]
    return Components(centre, (v @ right.T)[:, :k][:, some], deviations[:k][some] ** 2 / centre.n, trace / centre.n)


def identity_error(fit: DataFrame, c: Components) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(c.variances)

    def products(x):
        z = c.project(x)
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    sums = _summed(fit, k + k * k, products)
    mean = sums[:k] / c.centre.n
    return float(np.abs(sums[k:].reshape(k, k) / c.centre.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str, vector_col: str, k: int = 16, block: int = BLOCK) -> DataFrame:
    """Per row and component (from 1, by falling variance): ``id_col``,
    ``component``, ``n`` (rows of the fit list), ``deviation``, ``whitened``,
    ``explained`` (share of the variance) and ``identity_error``.
    ``deviation`` is exact, and null where it does not fit a long."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(usable(F.col("v"))).select("id", grid(F.col("v")).alias("x"))
    rows = written(rows.withColumn("d", F.size("x")), "whiten-rows")
    fits = written(rows.select("d", "x").distinct(), "whiten-fit")
    id_type = dict(rows.dtypes)["id"]
    schema = f"id {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    parts = [_whitened(rows.where(F.col("d") == d), fits.where(F.col("d") == d), d, k, block, schema)
             for d in sorted(r["d"] for r in fits.select("d").distinct().collect())]
    if not parts:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("id", id_col)


def _whitened(rows: DataFrame, fit: DataFrame, d: int, k: int, block: int, schema: str) -> DataFrame:
    c = bidiagonalise(fit, centre_of(fit, d), d, k, block)
    m = len(c.variances)
    error = identity_error(fit, c) if m else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not m:
                continue
            x = _matrix(batch, "x")
            size = len(x) * m
            deviation = [v if v < 1 << 63 else None for v in c.centre.deviations(x)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), m))),
                pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))),
                pa.array(np.full(size, c.centre.n)),
                pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), m))),
                pa.array(c.project(x).ravel()),
                pa.array(np.tile(c.variances / c.trace, len(x))),
                pa.array(np.full(size, error)),
            ], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("id", "x").mapInArrow(run, schema)
