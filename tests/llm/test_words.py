import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from parlance.llm.words import ALNUM, BLANK, Words, shingle_hashes

TEXT = st.lists(st.text(alphabet="aB é日1 \n\t.,|\x1c", max_size=40), max_size=6)


def _lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@settings(max_examples=60, deadline=None)
@given(TEXT)
def test_words_and_hashes(texts):
    for table, pattern in ((ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (BLANK, r"[^\x20\x09-\x0D]+")):
        w = Words([t.encode() for t in texts], table)
        want = [re.findall(pattern, _lower(t)) for t in texts]
        got = [[w.word(i).decode() for i in range(w.first[k], w.first[k + 1])] for k in range(len(texts))]
        assert got == want
        by_word = {}
        for word, h in zip((x for t in want for x in t), w.hashes.tolist(), strict=True):
            assert by_word.setdefault(word, h) == h
        assert len(set(by_word.values())) == len(by_word)


@settings(max_examples=60, deadline=None)
@given(TEXT)
def test_shingles(texts):
    w = Words([t.encode() for t in texts], BLANK)
    value, owner = shingle_hashes(w, 3)
    words = [re.findall(r"[^\x20\x09-\x0D]+", _lower(t)) for t in texts]
    want = [[tuple(x[i:i + 3]) for i in range(max(1, len(x) - 2))] if x else [] for x in words]
    assert np.bincount(owner, minlength=len(texts)).tolist() == [len(x) for x in want]
    table = {}
    for shingle, h in zip((s for x in want for s in x), value.tolist(), strict=True):
        assert table.setdefault(shingle, h) == h
    assert len(set(table.values())) == len(table)


def test_word_longer_than_a_slice():
    long = b"a" * (3 << 20)
    w = Words([long, b"b " + long + b" a"], BLANK)
    assert w.hashes[0] == w.hashes[2] != w.hashes[3]
