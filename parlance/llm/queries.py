"""One query per operator, applied to its whole table with production parameters."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.tables import held_out, small_batches, table

# Fixed values of the url query's contract: (host, path, decision).
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

SHARDS = 16
#: From these scores on a document is of good quality, or toxic.
QUALITY_FROM, TOXIC_FROM = 0.3, 0.5


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule or language-model verdict for every page url."""
    from parlance.llm.url_filter import judge_urls
    return judge_urls(table(spark, sf_dir, "pages"), "page_id", "url", URL_RULES)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    from parlance.llm.quality import fit_quality, score_quality
    docs = table(spark, sf_dir, "documents")
    trees = fit_quality(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "quality")
    return score_quality(docs, "doc_id", "text", trees).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= QUALITY_FROM).cast("int").alias("predicted"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from parlance.llm.html_text import extract_text
    return extract_text(table(spark, sf_dir, "pages"), "page_id", "url", "html").select("page_id", "url", "text", "n_chars")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside occurrences of benchmark windows."""
    from parlance.llm.decontaminate import find_hits
    hits = find_hits(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["first"])
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of the bytes they decode to."""
    import public_tokenizers

    from parlance.llm.bpe import encode_texts
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text",
                        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document at similarity 0.85."""
    from parlance.llm.near_dup import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", percent=85)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    from parlance.llm.license_scan import scan_licenses
    return scan_licenses(table(spark, sf_dir, "documents"), "doc_id", "text").drop("spans")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt uniformly into 16 shards of equal row counts."""
    from parlance.llm.sharding import shuffle_into_shards
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    dealt = shuffle_into_shards(rows, SHARDS)
    return dealt.select("row.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    from parlance.llm.toxicity import fit_toxicity, score_toxicity
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic")
    return score_toxicity(docs, "doc_id", "text", model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth vector."""
    from parlance.llm.permutation_index import nearest
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0)


def op11_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of the sources by weights 5, 2, 1 takes of every document."""
    from parlance.llm.entropy_mix import balance, n_words
    return balance(table(spark, sf_dir, "documents"), "doc_id", "source", n_words("text"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every word of the documents."""
    from parlance.llm.spelling import group_variants, word_counts
    return group_variants(word_counts(table(spark, sf_dir, "documents"), "doc_id", "text", least_letters=5, least_count=3, damage=97))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 16 leading whitened components of every vector."""
    from parlance.llm.whitening import whiten
    return whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 16)


def _in_small_batches(query):
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(small_batches(spark), sf_dir)
    return run


QUERIES = {f.__name__: _in_small_batches(f) for f in (
    op1_url_filter, op2_quality, op3_html_text, op4_decontaminate, op5_bpe, op6_minhash, op7_license_scan, op8_sharding, op9_toxicity, op10_neighbours,
    op11_entropy_mix, op12_spelling, op13_whitening)}
