"""Global ranks without a single-task window (W6, W7, W8 O-note).

``row_number()`` over an unpartitioned window moves every row into one
task. Instead: range-partition and sort by the order keys, tag each row
with its partition and position inside it, materialise that once
(checkpoint to the shared folder, so recomputation after an executor loss
cannot reorder rows), count rows per partition (one row per partition),
turn the counts into offsets and add them back with a broadcast join whose
size is bounded by the partition count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.session import ensure_checkpoint_dir


def with_global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Add a dense 1-based rank column following ``order`` (which must be a
    total order: end it with a unique key)."""
    ensure_checkpoint_dir(df.sparkSession)
    tagged = (
        df.orderBy(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
        .checkpoint(eager=True)
    )
    counts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"),
    ).fillna(0, ["_off"])
    # _mid = (partition << 33) + position within the partition.
    local = F.col("_mid") - F.shiftleft(F.col("_part").cast("bigint"), 33)
    return (
        tagged.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_off") + local + 1)
        .drop("_part", "_mid", "_off")
    )


def chunk_index(rank: Column, n: int) -> Column:
    """0-based chunk of ``n`` consecutive ranks."""
    return F.floor((rank - 1) / n).cast("bigint")


def grouped_rank(df: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """1-based rank inside each group by the ascending ``order`` columns,
    which must be unique within a group.

    Only the keys (group and order columns, no payload such as message text)
    are ranked, by the offset-based global rank; a group's first rank is
    subtracted and the rank is joined back on the composite key, nulls
    included. So neither a hot group nor its payload ever sits in one task,
    whatever its size."""
    ranked = with_global_rank(df.select(*group, *order), [F.col(c) for c in group + order], "_g")
    firsts = ranked.groupBy(*[F.col(c).alias(f"_f_{c}") for c in group]).agg(F.min("_g").alias("_first"))
    with_first = ranked.join(firsts, _same(ranked, firsts, group, "_f_"))
    ranks = with_first.select(*[F.col(c).alias(f"_k_{c}") for c in group + order], (F.col("_g") - F.col("_first") + 1).alias(name))
    return df.join(ranks, _same(df, ranks, group + order, "_k_")).drop(*[f"_k_{c}" for c in group + order])


def _same(left: DataFrame, right: DataFrame, columns: list[str], prefix: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & left[c].eqNullSafe(right[prefix + c])
    return out
