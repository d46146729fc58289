"""Awkward documents: nulls, empty and long texts, ties, repeated rows and ids, clashing column names."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, _id string, _text string, id int, node int, root int, key string, keys string, label int"

LONG = " ".join(f"word{i % 977} x{i % 31}" for i in range(40_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away."), (2, None), (3, ""), (4, "   \n\t "), (5, LONG),
    (6, "The quick brown fox jumps over the lazy dog and runs away."), (6, "The quick brown fox jumps over the lazy dog and runs away."),
    (7, "one two"), (8, "one two"), (None, "a row without an id"), (9, "été ÉTÉ K İ 日本語 \U0001f600"), (10, "!!! ... |||"),
    (11, LONG + " end"), (6, "another text of the same id"), ((1 << 62) + 1, "a large id"),
]


def documents(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "x", "y", 1, 2, 3, "k", "ks", 4) for i, t in texts], SCHEMA)
