"""Cleaning documents for training, stage by stage.

Each stage takes (spark, documents, sf_dir) and returns documents; the last
returns their tokens. ``run`` writes every stage's rows as Parquet under the
shared checkpoint folder and reads them back for the next. Every stage works
on all rows its predecessor kept:

1. toxicity: fitted on the labels of its input; documents that score 0.5 or more go.
2. quality classifier: likewise; documents that score below 0.3 go.
3. MinHash near-dedup: five-word shingles, similarity 0.8; the smallest id of each component stays.
4. benchmark decontamination: passages of the benchmark are cut out of the texts.
5. byte-level BPE: token ids of every text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.bpe import encode_texts
from parlance.llm.decontaminate import remove_hits
from parlance.llm.near_dup import keep_one
from parlance.llm.quality import fit_quality, keep_good
from parlance.llm.queries import QUALITY_FROM, TOXIC_FROM
from parlance.llm.tables import small_batches, table, written
from parlance.llm.toxicity import fit_toxicity, keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic")
    return keep_clean(docs, "text", model, TOXIC_FROM)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    trees = fit_quality(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "quality")
    return keep_good(docs, "text", trees, QUALITY_FROM)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return keep_one(docs, "doc_id", "text", percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    clean = remove_hits(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    import public_tokenizers

    return encode_texts(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity),
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE encoding and decoding", tokens),
]

#: SQL cannot express the trained stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return docs
