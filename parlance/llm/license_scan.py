"""License scan by diagonal voting over word k-grams.

Every k-gram of a text's words is hashed and joined with the k-grams of the
license templates. A match at word ``pos`` of the text and ``tpos`` of the
template votes for the diagonal ``pos - tpos``, where the template would
start. Votes are summed per document, template and diagonal; diagonals at
most ``GAP`` apart are merged, so that a few inserted or missing words do not
break a license apart; a merged span is verified by the share of the
template's k-grams it holds.

Templates marked exact are phrases: only a diagonal on which every k-gram
voted is a place, which by then is the phrase word for word. ``K`` is the
number of words of the shortest phrase.

Everything is DataFrame code. The templates are a parameter, usually of a few
hundred k-grams, whose side of the join is broadcast after a check of its
size; then only matches are shuffled. Each
document adds one marker row holding its word count, so documents without
matches are kept without a second scan.

Null and empty texts have no words, no places and score 0. Rows with equal
id and equal text each get the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 3
GAP = 3
#: Template k-grams up to which their side of the join is broadcast (about 10 MB); larger sets are shuffled.
BROADCAST_GRAMS = 200_000
#: Least share of a template's k-grams in a verified span.
COVERAGE = 0.6

# Phrases and short public license notices, as (label, words, exact).
PHRASES = [
    ("mit", "under the mit license", True),
    ("apache-2", "apache license version 2", True),
    ("cc-by-nc", "cc by nc", True),
]
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", False),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", False),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", False),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", False),
    ("gpl", "this work is licensed under the gnu general public license version 3", False),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license", False),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", False),
    ("cc-by", "this work is licensed under a creative commons attribution international license", False),
    ("unlicense", "this is free and unencumbered software released into the public domain", False),
    ("proprietary", "all rights reserved", False),
]

# Whole texts of short public licenses, their words in order.
TEXTS = [
    ("mit", """
permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to
deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or
sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above
copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as
is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular
purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an
action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software""", False),
    ("isc", """
permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above
copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with
regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special
direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract
negligence or other tortious action arising out of or in connection with the use or performance of this software""", False),
    ("bsd", """
redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1
redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in
binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other
materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied
warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event
shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but
not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory
of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software
even if advised of the possibility of such damage""", False),
    ("zlib", """
this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from
the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it
and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that
you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is
not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice
may not be removed or altered from any source distribution""", False),
    ("unlicense", """
this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this
software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that
recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we
make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an
overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law""", False),
]

_MARK = "mark"


def words_of(text: Column) -> Column:
    """Words of ASCII letters, digits and characters above U+007F, A-Z lower-cased.

    ``lower`` also maps letters above U+007F, to others above it; the two that
    would become ASCII are replaced first, so counts and ASCII words are exact.
    """
    full = F.coalesce(text, F.lit(""))
    safe = F.when(F.contains(full, F.lit("\u212a")) | F.contains(full, F.lit("\u0130")), F.translate(full, "\u212a\u0130", "\u00e9\u00e9")).otherwise(full)
    return F.regexp_extract_all(F.lower(safe), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def _hashes(words: str, k: int) -> Column:
    """Hash of the k-gram at every word; the last k - 1 hash fewer words and match nothing."""
    return F.transform(words, lambda w, i: F.xxhash64(w, *(F.get(F.col(words), i + j) for j in range(1, k))))


def template_grams(spark, templates: list[tuple[str, str, bool]], k: int) -> DataFrame:
    rows = [(i, label, text.split(), len(text.split()) - k + 1, exact) for i, (label, text, exact) in enumerate(templates)]
    table = spark.createDataFrame(rows, "template int, label string, words array<string>, grams int, exact boolean")
    return (table.withColumn("h", _hashes("words", k)).select("template", "label", "grams", "exact", F.posexplode("h").alias("tpos", "h"))
            .where("tpos < grams"))


def scan_spans(docs: DataFrame, id_col: str, text_col: str, templates: list[tuple[str, str, bool]] | None = None,
               k: int = K, gap: int = GAP, coverage: float = COVERAGE) -> DataFrame:
    """One row per distinct (id, text): ``_id``, ``_text_hash``, ``copies``
    (equal rows), ``n_words`` and ``spans``, an array sorted by start of
    struct(first, last, label, exact, score): verified spans, first and last
    word numbers counted from 0."""
    spark = docs.sparkSession
    templates = PHRASES + NOTICES + TEXTS if templates is None else templates
    grams = template_grams(spark, templates, k)
    small = sum(max(0, len(text.split()) - k + 1) for _, text, _ in templates) <= BROADCAST_GRAMS
    # The marker hash is joined like a gram; its position is the word count.
    mark = F.xxhash64(F.lit("\u0000" + _MARK))
    marker = spark.range(1).select(F.lit(-1).alias("template"), F.lit(_MARK).alias("label"), F.lit(0).alias("grams"), F.lit(False).alias("exact"), F.lit(0).alias("tpos"), mark.alias("h"))
    table = grams.unionByName(marker)
    votes = (
        docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text_hash"), words_of(F.col(text_col).cast("string")).alias("words"))
        .select("_id", "_text_hash", F.posexplode(F.concat(_hashes("words", k), F.array(mark))).alias("pos", "h"))
        .join(F.broadcast(table) if small else table, "h")
        .select("_id", "_text_hash", "template", "label", "grams", "exact", (F.col("pos") - F.col("tpos")).alias("diagonal"), "tpos")
    )
    key = ["_id", "_text_hash"]
    diagonals = (
        votes.groupBy(*key, "template", "label", "grams", "exact", "diagonal")
        .agg(F.collect_set("tpos").alias("tpos"), F.count(F.lit(1)).alias("n"))
    )
    # Merge neighbouring diagonals of a template; phrases and markers stand alone.
    along = Window.partitionBy(*key, "template").orderBy("diagonal")
    apart = F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(along) > gap)
    merged = (
        diagonals.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
        .withColumn("span", F.sum("new").over(along))
        .groupBy(*key, "template", "label", "grams", "exact", "span")
        .agg(F.array_distinct(F.flatten(F.collect_list("tpos"))).alias("tpos"), F.max("n").alias("n"), F.max("diagonal").alias("diagonal"),
             F.min(F.col("diagonal") + F.array_min("tpos")).alias("first"), F.max(F.col("diagonal") + F.array_max("tpos") + k - 1).alias("last"))
        .withColumn("score", F.when(F.col("grams") > 0, F.size("tpos") / F.col("grams")).otherwise(0.0))
    )
    verified = (F.col("template") >= 0) & F.when(F.col("exact"), F.col("score") == 1).otherwise(F.col("score") >= coverage)
    span = F.struct(F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"), "label", "exact", F.col("score").cast("double").alias("score"))
    return merged.groupBy(*key).agg(
        F.max(F.when(F.col("template") < 0, F.col("n"))).alias("copies"),
        F.max(F.when(F.col("template") < 0, F.col("diagonal"))).cast("bigint").alias("n_words"),
        F.array_sort(F.collect_list(F.when(verified, span))).alias("spans"),
    )


def scan_licenses(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """One row per input row: ``id_col``, ``n_words``, ``n_base`` (places of
    exact phrases), ``first_word`` and ``last_word`` (their first and last
    start), ``base_labels``, ``labels`` and ``score`` (1 with a base place,
    else the best share of a verified notice, else 0), and the ``spans``."""
    found = scan_spans(docs, id_col, text_col, **options)
    base = F.filter("spans", lambda s: s["exact"])
    starts = F.transform(base, lambda s: s["first"])

    def joined(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        F.col("_id").alias(id_col), "n_words", F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("spans")).alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0))).alias("score"),
        "spans",
    )
