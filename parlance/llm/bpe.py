"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Each task builds the encoder once from the rank file (its path is a
parameter; the file must exist on the executors, as an installed package
does). Long texts are cut first at boundaries that no match of the
pre-splitting pattern can cross, so the ids equal those of the whole text
while the library never sees more than about ``CHUNK`` characters at once.
Decoding goes back to raw bytes, which need not be valid UTF-8 piece by piece.

Null and empty texts have no tokens. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame

from parlance.llm.tables import carried, restored

CHUNK = 1 << 16
#: Places no match of the pattern crosses: a match holds white space only at
#: its front, and changes between letters, digits and punctuation end it (the
#: apostrophe of a contraction comes first in its match). ASCII on one side
#: keeps this independent of the Unicode version of either library.
SAFE = regex.compile(r"(?<=[\p{L}\p{N}])(?=[ \n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z0-9])(?=[!-/:-@\[-`{-~])")


@lru_cache(maxsize=2)
def encoder(rank_path: str, pattern: str):
    import tiktoken

    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, chunk: int = CHUNK) -> Iterator[str]:
    """``text`` cut at safe boundaries into pieces of about ``chunk`` characters."""
    begin = 0
    while len(text) - begin > chunk:
        cut = SAFE.search(text, begin + chunk)
        if cut is None:
            break
        yield text[begin:cut.start()]
        begin = cut.start()
    yield text[begin:]


def encode(enc, text: str) -> list[int]:
    if len(text) <= CHUNK:
        return enc.encode_ordinary(text)
    return [i for piece in pieces(text) for i in enc.encode_ordinary(piece)]


def encode_texts(docs: DataFrame, id_col: str, text_col: str, rank_path: str, pattern: str,
                 with_ids: bool = True, with_bytes: bool = False) -> DataFrame:
    """One row per input row: ``id_col``, ``n_tokens``, ``ids_sha256``,
    ``decoded_sha256`` and, if asked for, the ``ids`` and the ``decoded`` bytes."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(rank_path, pattern)
        names = [str(i) for i in range(enc.max_token_value + 1)]
        for frame in frames:
            for at in range(0, len(frame), 512):
                part = frame.iloc[at:at + 512]
                n, sha, back, ids_out, bytes_out = [], [], [], [], []
                for raw in part["_text"]:
                    ids = encode(enc, raw.decode("utf-8", "replace"))
                    decoded = enc.decode_bytes(ids)
                    n.append(len(ids))
                    sha.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                    back.append(hashlib.sha256(decoded).hexdigest())
                    if with_ids:
                        ids_out.append(ids)
                    if with_bytes:
                        bytes_out.append(decoded)
                out = {"_id": part["_id"].values, "n_tokens": n, "ids_sha256": sha, "decoded_sha256": back}
                if with_ids:
                    out["ids"] = ids_out
                if with_bytes:
                    out["decoded"] = bytes_out
                yield pd.DataFrame(out)

    schema = "_id string, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" if with_ids else ""
    schema += ", decoded binary" if with_bytes else ""
    return restored(carried(docs, id_col, text_col).mapInPandas(run, schema), docs, id_col)
