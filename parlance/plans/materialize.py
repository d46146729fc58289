"""Stage outputs written as parquet under the shared checkpoint folder.

A pipeline stage (ingest, labelling, each enhance pass) ends in a written
table: later stages start from a short lineage, read only the columns they
need (column pruning, pushed filters), and a lost executor never forces a
recomputation back to the raw input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from parlance.session import scratch_path


def materialize(df: DataFrame, name: str, partition_cols: list[str] | None = None) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    w = df.write.mode("overwrite")
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.parquet(path)
    return df.sparkSession.read.parquet(path)
