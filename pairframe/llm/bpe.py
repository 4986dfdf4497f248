"""Byte-level BPE encoding and decoding with tiktoken and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts beyond this are cut, at safe places only, before the pattern runs over them.
LONG = 1 << 16
#: A match never goes on from a non-space into a space, and digits and letters never share one.
_SAFE = re.compile(r"(?<=\S)(?=\s)|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = LONG) -> Iterator[str]:
    """text in pieces of about ``size`` characters whose encodings join to that of the whole.

    Cuts fall where the pattern can have no match across them; a run without
    such a place stays whole.
    """
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None or cut.start() <= start:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(enc, text: str) -> list[int]:
    if len(text) <= LONG:
        return enc.encode_ordinary(text)
    return [i for piece in safe_pieces(text) for i in enc.encode_ordinary(piece)]


def bpe_tokens(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, ids (array<int>), decoded (binary, the bytes the ids stand for).

    Null counts as empty; an empty text has no ids. Text that looks like a
    special token is ordinary text. Texts over ``LONG`` characters are encoded
    whole, piece by piece. Repeated rows and ties of ids get a row each, an
    empty table gives none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            ids = [encode(enc, t) for t in batch.column(1).to_pylist()]
            decoded = [enc.decode_bytes(i) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return _plain(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def bpe_digests(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bpe_tokens with digests in place of ids and bytes, made in the same task: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        names = [str(i) for i in range(enc.n_vocab)]
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = encode(enc, text)
                n.append(len(ids))
                ids_sha.append(sha(",".join([names[i] for i in ids]).encode()))
                text_sha.append(sha(enc.decode_bytes(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _plain(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
