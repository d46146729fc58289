"""Even-step sampling (W7) and fixed-size chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.select import newest_order
from parlance.plans.ranks import chunk_index, with_global_rank


def sample_positions(spark, n: int, s: int) -> DataFrame:
    """0-based positions min(round(i*n/s), n-1), i = 0..s-1, computed in
    exact integer arithmetic (round half up of i*n/s)."""
    i = F.col("id")
    pos = F.least(F.floor((2 * i * n + s) / (2 * s)), F.lit(n - 1)).cast("bigint")
    return spark.range(s).select(i.alias("sample_ord"), pos.alias("sample_pos"))


def stratified_sample(df: DataFrame, s: int, order=None) -> DataFrame:
    """``s`` rows evenly spaced over ``order`` (newest first by
    default); all rows when ``s`` is 0 or not below the row count.

    Ranks come from the offset-based global rank; the positions table has
    exactly ``s`` rows and is joined by the planner's choice."""
    order = order or newest_order()
    ranked = with_global_rank(df, order, "_rank")
    n = ranked.count()
    if s <= 0 or s >= n:
        return ranked.withColumn("sample_ord", F.col("_rank") - 1).drop("_rank")
    pos = sample_positions(df.sparkSession, n, s)
    return ranked.join(pos, ranked["_rank"] - 1 == pos["sample_pos"]).drop("_rank", "sample_pos")


def chunked(df: DataFrame, n: int, order=None, name: str = "batch") -> DataFrame:
    """W6 over the whole frame: ``name`` = floor((rank-1)/n)."""
    order = order or newest_order()
    ranked = with_global_rank(df, order, "_rank")
    return ranked.withColumn(name, chunk_index(F.col("_rank"), n)).withColumnRenamed("_rank", f"{name}_rank")
