"""Bounded samples of labelled rows for the trained operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.tables import held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                    rows_per_class: int, max_bytes: int) -> DataFrame:
    """``_id`` (text), ``_text`` (bytes) and ``_label`` (0/1) of at most
    ``rows_per_class`` labelled ids of each class that are not held out, the
    first by the hash of their id; texts over ``max_bytes`` are left out of
    the fit (scores cover all). An id labelled several times has its mean
    label, rounded up at one half; null ids and labels are ignored."""
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("_key")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("_label"))
    )
    picked = None
    for label in (0, 1):
        part = known.where(F.col("_label") == label).orderBy(F.xxhash64("_key"), "_key").limit(rows_per_class)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col(id_col).alias("_key"), F.col(text_col).cast("string").alias("_raw"))
    # The sample holds 2 * rows_per_class ids at most.
    return (texts.join(F.broadcast(picked), "_key")
            .select(F.col("_key").cast("string").alias("_id"), F.encode(F.coalesce("_raw", F.lit("")), "UTF-8").alias("_text"), "_label")
            .where(F.length("_text") <= max_bytes))
