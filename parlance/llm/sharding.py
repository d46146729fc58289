"""Uniform shuffle into shards of exact sizes by a drawn communication matrix.

1. Every input partition's rows are numbered and written once with their
   number, so partitions and counts stay fixed whatever is recomputed later.
2. On the driver one row per partition is drawn: how many of its rows go to
   each shard, from the multivariate hypergeometric law of a uniform
   permutation (``communication_matrix``). The rows of the matrix add up to
   the partition sizes, its columns to the exact shard sizes.
3. Each partition permutes its rows locally by a seeded hash; the first
   ``m[p][0]`` go to shard 0, the next ``m[p][1]`` to shard 1, and so on.
4. After that exchange every shard is permuted again. A shard may be far
   larger than a task, so it is cut into buckets by random bits; a row's slot
   is its bucket's offset plus its rank inside the bucket.

Nothing depends on values of the rows, so repeated rows, ties and hot keys
spread like any others. Empty input: no rows out. Nulls: rows like any other.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.tables import written

#: Rows of a shard that one task permutes at most, on average.
BUCKET_ROWS = 500_000


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes that differ by one at most; the first ``rows % shards`` are the larger ones."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _log_ratio(a: int, b: int) -> float:
    """log(a! / b!). Large ones by Stirling's series, arranged so that no large terms cancel."""
    if min(a, b) < 16:
        return math.lgamma(a + 1) - math.lgamma(b + 1)

    def rest(x: int) -> float:
        return 1 / (12 * x) - 1 / (360 * x ** 3) + 1 / (1260 * x ** 5)

    return (a - b) * math.log(b) + (a + 0.5) * math.log1p((a - b) / b) - (a - b) + rest(a) - rest(b)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows drawn without replacement from ``good + bad``
    are good; exact for any counts.

    By symmetry less than half of the rows are drawn from a smaller good
    side. Small expected counts are drawn row by row of the smaller side, the
    others by the ratio of uniforms: a point under the square root of the
    density about its mode, as Stadlober gives its bounds."""
    total = good + bad
    if 2 * n > total:
        return good - hypergeometric(rng, good, bad, total - n)
    if good > bad:
        return n - hypergeometric(rng, bad, good, n)
    if n > good:  # exchange the parts: the rows drawn are the good ones
        return hypergeometric(rng, n, total - n, good)
    if n <= 10:
        drawn = 0
        for i in range(n):
            drawn += int(rng.integers(total - i)) < good - drawn
        return drawn
    share = good / total
    mean, spread = n * share + 0.5, math.sqrt((total - n) / (total - 1) * n * share * (1 - share) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + (3 - 2 * math.sqrt(3 / math.e))
    mode = (n + 1) * (good + 1) // (total + 2)
    while True:
        u, v = rng.random(), rng.random()
        if not u:
            continue
        k = math.floor(mean + width * (v - 0.5) / u)
        if 0 <= k <= n:
            log_density = _log_ratio(mode, k) + _log_ratio(good - mode, good - k) + _log_ratio(n - mode, n - k) + _log_ratio(bad - n + mode, bad - n + k)
            if 2 * math.log(u) <= log_density:
                return k


def communication_matrix(partition_rows: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Partition-to-shard counts of a uniform permutation of all rows, whose number has no bound."""
    rng = np.random.default_rng(seed)
    left = list(sizes)
    out = []
    for n in partition_rows:
        drawn, beyond = [], sum(left)
        for size in left:
            beyond -= size
            drawn.append(hypergeometric(rng, size, beyond, n))
            n -= drawn[-1]
        left = [size - k for size, k in zip(left, drawn, strict=True)]
        out.append(drawn)
    return out


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``shard`` (int), ``slot`` (long, gapless from 0 in every shard) and
    ``row``, a struct of all columns of ``df``, so that no names clash."""
    spark = df.sparkSession
    numbered = written(df.select(F.struct(*df.columns).alias("row"), F.monotonically_increasing_id().alias("_row")), "shard-input")
    # The high bits of the number are the input partition.
    numbered = numbered.withColumn("_part", F.shiftright("_row", 33).cast("int"))
    counts = sorted((r["_part"], r["count"]) for r in numbered.groupBy("_part").count().collect())
    sizes = shard_sizes(sum(n for _, n in counts), shards)
    matrix = communication_matrix([n for _, n in counts], sizes, seed)
    ends = [(p, [int(x) for x in np.cumsum(row)]) for (p, _), row in zip(counts, matrix, strict=True)]
    # One row per input partition; joined by the planner's choice.
    dealt = spark.createDataFrame(ends, "_part int, _ends array<bigint>")

    local = Window.partitionBy("_part").orderBy(F.xxhash64(F.lit(seed), "_row"), "_row")
    assigned = (
        numbered.withColumn("_rank", F.row_number().over(local))
        .join(dealt, "_part")
        .withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_rank"))).cast("int"))
        .drop("_rank", "_ends", "_part")
    )
    exchanged = written(assigned, "shard-exchanged")

    buckets = max(1, math.ceil(max(sizes) / bucket_rows))
    key = F.xxhash64(F.lit(seed + 1), "_row")
    exchanged = exchanged.withColumn("_bucket", F.pmod(F.shiftrightunsigned(key, 20), F.lit(buckets)).cast("int"))
    earlier = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        exchanged.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .select("shard", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    again = Window.partitionBy("shard", "_bucket").orderBy(key, "_row")
    return (
        exchanged.withColumn("_rank", F.row_number().over(again))
        .join(offsets, ["shard", "_bucket"])
        .withColumn("slot", (F.col("_offset") + F.col("_rank") - 1).cast("bigint"))
        .drop("_bucket", "_rank", "_offset", "_row")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write each shard to its own folder, in slot order, over as many files as the session's partitions."""
    (sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
