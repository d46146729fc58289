import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parlance.llm.bpe import encode_texts, encoder, pieces

from .rows import documents

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abZ09 \n\t'’!?.,éß日一 \x1c\U0001f600", max_size=200), st.integers(1, 12))
def test_pieces_encode_like_the_whole(text, chunk):
    enc = encoder(RANKS, PATTERN)
    assert "".join(pieces(text, chunk)) == text
    assert [i for p in pieces(text, chunk) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


@pytest.mark.parametrize("text", ["it's we'll I'd 's''ve " * 30, "a" * 300, "x1y22z " * 50, " \n \n  x" * 40, "don't!'s 12's" * 20])
def test_contractions_and_runs(text):
    enc = encoder(RANKS, PATTERN)
    assert [i for p in pieces(text, 7) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_every_row_round_trips(spark):
    docs = documents(spark)
    rows = encode_texts(docs, "doc_id", "text", RANKS, PATTERN, with_bytes=True).collect()
    texts = sorted((str(r["doc_id"]), r["text"] or "") for r in docs.collect())
    assert sorted((str(r["doc_id"]), bytes(r["decoded"]).decode()) for r in rows) == texts
    enc = encoder(RANKS, PATTERN)
    by_bytes = {bytes(r["decoded"]).decode(): r for r in rows}
    for _, text in texts:
        r, ids = by_bytes[text], enc.encode_ordinary(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark):
    assert encode_texts(documents(spark, []), "doc_id", "text", RANKS, PATTERN).count() == 0
