"""Reading the given tables and cutting lineage on the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.session import ensure_checkpoint_dir, scratch_path


#: Rows and bytes of one Arrow batch between Spark and a Python worker: with
#: whole texts in a row, Spark's 10,000 rows would be tens of megabytes, held
#: several times on either side.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """Set the session's Arrow batches to BATCH_ROWS and BATCH_BYTES; called by every query and stage."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet under the shared checkpoint folder and
    read back: later steps neither recompute it nor depend on one executor."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def utf8(column: str) -> Column:
    """The UTF-8 bytes of a string column; null as empty."""
    return F.coalesce(F.encode(F.col(column).cast("string"), "UTF-8"), F.lit(b""))


def held_out(doc_id: str) -> Column:
    """Rows that no label is learned from: crc32 of the id's decimal text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def carried(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id`` (the id as text, so that pandas keeps nulls and large integers) and ``_text`` (UTF-8 bytes)."""
    return docs.select(F.col(id_col).cast("string").alias("_id"), utf8(text_col).alias("_text"))


def restored(df: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    """Give ``_id`` its name and type in ``docs`` back."""
    return df.select(F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col), *(c for c in df.columns if c != "_id"))


def ranges(texts: list[bytes | None], size: int) -> Iterator[tuple[int, int]]:
    """Neighbouring rows in ranges of about ``size`` bytes of text; one longer text is a range of its own."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if i > begin and held + len(t or b"") > size:
            yield begin, i
            begin, held = i, 0
        held += len(t or b"")
    if begin < len(texts):
        yield begin, len(texts)


def rows_where(docs: DataFrame, text_col: str, keep: Callable[[list[bytes]], list[bool]], size: int = 1 << 20) -> DataFrame:
    """The rows of ``docs``, untouched, whose text ``keep`` accepts. It gets the UTF-8 bytes of a block of texts (null as empty)."""
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
            mask = [bool(k) for b, e in ranges(texts, size) for k in keep(texts[b:e])]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
