"""Grouping of spelling variants by PartEnum signatures.

Two words are near if one inserted, deleted or replaced letter makes them
equal. Seen as the set of (letter, how many of it came before), a word is a
binary vector, and near words' vectors are at Hamming distance at most two.

1. Partition: the vector's dimensions are dealt into ``PARTS`` parts.
2. Enumerate: every way of leaving out two parts gives a signature, the exact
   content of the other parts. Vectors that differ in at most two dimensions
   differ in at most two parts, so they share a signature; none is missed.
3. Equi-join: words that share a signature meet. Letters say nothing of their
   order, so the join key also holds one half of the word: one edit leaves
   the first or the last half of the shorter word's letters as they are.
   A word stands on the left as the shorter or equal one, on the right as the
   equal or longer one.
4. Verify: pairs whose edit distance is not one go.

A word's form is its most frequent near word, if that is ``RATIO`` times as
frequent; its root is found by following forms, by pointer doubling. Counts
at least double along a chain, so few rounds are needed.

Words are counted before anything is joined, so frequent words, hot sources
and copies of documents cost nothing further. A bucket of the join holds
words that agree in two of four parts and in half their letters. Null and
empty texts have no words; ties go to the word first in code-point order;
repeated rows count each time. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.tables import written
from parlance.llm.words import mix

PARTS = 4
RATIO = 2
#: Letters, of which a word is a maximal run, after A-Z are lower-cased; all of them are in Latin-1.
LETTERS = "[a-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, id_col: str, text_col: str, least_letters: int, least_count: int, damage: int | None = None) -> DataFrame:
    """(word, n) of the words long and frequent enough. With ``damage``, a run
    whose crc32 with its document's id (null: empty) is divisible by it loses
    the letter at that crc32 modulo its length."""
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate(F.col(text_col), _UPPER, _LOWER), F.lit(LETTERS), F.lit(0))).alias("run"),
    ).where(F.length("run") >= least_letters)
    word = F.col("run")
    if damage:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        word = F.when(h % damage == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(word)
    return (runs.select(word.alias("word")).where(F.length("word") >= least_letters)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count))


def part_hashes(words: list[str], parts: int = PARTS) -> np.ndarray:
    """Per word and part, a 64-bit sum of the part's dimensions that the word has."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    order = np.lexsort((letters, owner))
    letters = letters[order]
    new = np.ones(len(letters), bool)
    new[1:] = (letters[1:] != letters[:-1]) | (owner[1:] != owner[:-1])
    at = np.arange(len(letters))
    before = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.zeros((len(words), parts), np.uint64)
    np.add.at(out, (owner, (letters + 3 * before) % parts), mix((letters.astype(np.uint64) << np.uint64(40)) + before.astype(np.uint64) + np.uint64(1)))
    return out


def _with_parts(words: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                hashes = part_hashes(batch.column(0).to_pylist(), parts).view(np.int64)
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, hashes.size + 1, parts), pa.int32()), pa.array(hashes.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values], ["word", "n", "parts"])

    return words.select("word", "n").mapInArrow(run, "word string, n bigint, parts array<bigint>")


def _keys(parts: int, shorter: Column) -> Column:
    """The join keys of a word as one of a pair whose shorter word has
    ``shorter`` letters: every signature with either half."""
    half = F.floor(shorter / 2).cast("int")
    halves = [F.xxhash64(F.lit(0), shorter, F.substring("word", F.lit(1), half)),
              F.xxhash64(F.lit(1), shorter, F.substring("word", F.length("word") - shorter + half + 1, F.length("word")))]
    return F.array(*[
        F.xxhash64(F.lit(i), h, *[F.col("parts")[p] for p in range(parts) if p not in out])
        for i, out in enumerate(combinations(range(parts), 2)) for h in halves])


def near_pairs(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """Both orders of every pair of near words: (word, other, other_n), each once."""
    signed = written(_with_parts(words, parts), "spelling-parts")
    length = F.length("word")
    left = signed.select(F.col("word").alias("a"), F.col("n").alias("an"), F.explode(_keys(parts, length)).alias("key"))
    right = signed.select(F.col("word").alias("b"), F.col("n").alias("bn"), F.explode(F.concat(_keys(parts, length), _keys(parts, length - 1))).alias("key"))
    near = F.levenshtein("a", "b", 1) == 1
    order = (F.length("a") < F.length("b")) | ((F.length("a") == F.length("b")) & (F.col("a") < F.col("b")))
    pairs = left.join(right, "key").where(order & near).select("a", "an", "b", "bn").distinct()
    return pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("bn").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("an").alias("other_n")))).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of (word, form), by pointer doubling."""
    at = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while not at.where("moved").isEmpty():
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = written(at.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
    return at.select("word", "root")


def group_variants(words: DataFrame, parts: int = PARTS, ratio: int = RATIO) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of every row of (word, n)."""
    words = written(words.select("word", "n"), "spelling-words")
    best = near_pairs(words, parts).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    has_form = -F.col("best.minus") >= ratio * F.col("n")
    formed = written(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(has_form, F.col("best.other")).alias("form"), F.when(has_form, -F.col("best.minus")).alias("form_n")), "spelling-forms")
    ends = roots(formed.where(F.col("form").isNotNull()))
    return formed.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
