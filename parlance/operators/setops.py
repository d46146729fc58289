"""Keyed set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.plans.materialize import materialize


def upsert(base: DataFrame, new: DataFrame, key: str | list[str] = "conv_id") -> DataFrame:
    """New rows win per key, other base rows kept.

    ``new`` is evaluated once, by storing it; from there on its size is
    known, so the keys of a few new rows are broadcast and the base is not
    shuffled. Rows with a null key are all kept."""
    keys = [key] if isinstance(key, str) else key
    new = materialize(new, "upsert-new")
    return base.join(new.select(*keys), keys, "left_anti").select(*base.columns).unionByName(new, allowMissingColumns=True)


def except_keys(a: DataFrame, b: DataFrame, key: str = "conv_id") -> DataFrame:
    """Keys of ``a`` absent from ``b`` (added)."""
    return a.join(b.select(key), key, "left_anti")


def intersect_keys(a: DataFrame, b: DataFrame, key: str = "conv_id") -> DataFrame:
    """Keys of ``a`` present in ``b`` (updated)."""
    return a.join(b.select(key), key, "left_semi")


def merge_counts(new: DataFrame, old: DataFrame, key: str = "conv_id") -> DataFrame:
    """A3: added, updated and merged total in one pass over a key-only
    full outer join."""
    n = new.select(key, F.lit(True).alias("_n")).distinct()
    o = old.select(key, F.lit(True).alias("_o")).distinct()
    j = n.join(o, key, "full")
    return j.agg(
        F.count_if(F.col("_n").isNotNull() & F.col("_o").isNull()).alias("added"),
        F.count_if(F.col("_n").isNotNull() & F.col("_o").isNotNull()).alias("updated"),
        F.count(F.lit(1)).alias("total"),
    )


def union_distinct(a, b) -> Column:
    """U4: ordered array union keeping first occurrences."""
    return F.array_distinct(F.concat(F.coalesce(a, F.array()), F.coalesce(b, F.array())))


def distinct_values(a) -> Column:
    """U5."""
    return F.array_distinct(a)
