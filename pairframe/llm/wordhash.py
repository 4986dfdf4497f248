"""Word hashes of whole texts in numpy, and messages between document groups and hash buckets.

Texts are dealt into groups by a hash; one exchange of the texts serves every
step of an operator, for Spark reuses it. What a step asks about the corpus
travels as one row per (group, bucket) that holds sorted 64-bit keys as byte
planes: their high bytes hardly vary and compress away.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairframe.llm.common import UPPER, shuffle_partitions

U = np.uint64
LOWER_TABLE = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
MESSAGE = "to int, src int, n long, body binary"


def group_count(df: DataFrame) -> int:
    return 3 * shuffle_partitions(df.sparkSession)


def bucket_count(df: DataFrame) -> int:
    return shuffle_partitions(df.sparkSession)


def dealt(docs: DataFrame, id_col: str, text_col: str, groups: int) -> DataFrame:
    """src, doc_id, body (UTF-8 bytes; null counts as empty), dealt out evenly whatever the ids or texts repeat."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    return docs.select(
        F.pmod(F.xxhash64(f"`{id_col}`", F.octet_length(text), F.crc32(text)), F.lit(groups)).cast("int").alias("src"),
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        text.alias("body"),
    )


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps around."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def then(a: np.ndarray, b: np.ndarray, seed: int = 1) -> np.ndarray:
    """Hash of the sequence a, b of hashes."""
    return mix(a * U(0x9E3779B97F4A7C15) + b + U(seed))


def word_hashes(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and the number of words of each text.

    bytes.split() without arguments splits at just the characters that words may
    not hold: space and 0x09 to 0x0D.
    """
    split = [(t.translate(LOWER_TABLE) if lower else t).split() for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(split)), U, int(counts.sum()))
    return hashes, counts


def windows(hashes: np.ndarray, counts: np.ndarray, length: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``length`` words from each word on, and whether they lie in one text.

    Built by doubling: a window is two overlapping windows of a power of two.
    """
    n = len(hashes)
    power, span = hashes, 1
    while 2 * span <= length:
        joined = power.copy()
        if n > span:
            joined[: n - span] = then(power[: n - span], power[span:], seed + span)
        power, span = joined, 2 * span
    if span < length:
        joined = power.copy()
        shift = length - span
        if n > shift:
            joined[: n - shift] = then(power[: n - shift], power[shift:], seed + length)
        power = joined
    ends = np.repeat(np.cumsum(counts), counts)
    return power, np.arange(n) + length <= ends


def planes(values: np.ndarray, width: int) -> bytes:
    """The ``width`` low bytes of every value, byte by byte; a value that needs more is an error."""
    if width < 8 and len(values) and int(values.max()) >> (8 * width):
        raise OverflowError(f"a value does not fit in {width} bytes")
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(width, n).T
    return out.view("<u8").reshape(n).astype(U)


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of ``buckets`` equal ranges of the key space starts among sorted keys."""
    return np.searchsorted(keys, np.array([(b << 64) // buckets for b in range(buckets)], U)).tolist() + [len(keys)]


def send(src: int, keys: np.ndarray, columns: list[tuple[np.ndarray, int]], buckets: int) -> pa.Table:
    """Messages with the sorted keys and their columns (values, bytes wide), one row per bucket that gets any."""
    edges = bucket_edges(keys, buckets)
    rows = [(b, edges[b], edges[b + 1]) for b in range(buckets) if edges[b] < edges[b + 1]]
    body = [planes(keys[a:z], 8) + b"".join(planes(v[a:z], w) for v, w in columns) for _, a, z in rows]
    return messages([b for b, _, _ in rows], [src] * len(rows), [z - a for _, a, z in rows], body)


def messages(to: list[int], src: list[int], n: list[int], body: list[bytes]) -> pa.Table:
    return pa.table([pa.array(to, pa.int32()), pa.array(src, pa.int32()), pa.array(n, pa.int64()), pa.array(body, pa.binary())], names=["to", "src", "n", "body"])


def received(group: pa.Table, *widths: int) -> tuple[list[int], list[int], np.ndarray, list[np.ndarray]]:
    """Senders, their numbers of keys, all keys and all columns of the messages of one bucket."""
    src, n = group.column("src").to_pylist(), group.column("n").to_pylist()
    parts: list[list[np.ndarray]] = [[] for _ in range(1 + len(widths))]
    for size, body in zip(n, group.column("body").to_pylist(), strict=True):
        at = 0
        for out, width in zip(parts, (8, *widths), strict=True):
            out.append(unplanes(body[at : at + size * width], size, width))
            at += size * width
    whole = [np.concatenate(p) for p in parts]
    return src, n, whole[0], whole[1:]


def answers(group: pa.Table) -> list[bytes]:
    """Bodies of a group's replies, by bucket; buckets hold rising key ranges, so they follow the sorted keys."""
    src, body = group.column("src").to_pylist(), group.column("body").to_pylist()
    return [body[i] for i in sorted(range(len(src)), key=src.__getitem__)]


class Texts:
    """The texts of one group in an order that every step finds again."""

    def __init__(self, group: pa.Table, lower: bool):
        ids, texts = group.column("doc_id").to_pylist(), group.column("body").to_pylist()
        # a null id comes last
        order = sorted(range(len(texts)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.src = group.column("src")[0].as_py() if group.num_rows else -1
        self.ids = [ids[i] for i in order]
        self.texts = [texts[i] for i in order]
        self.hashes, self.counts = word_hashes(self.texts, lower)
        self.rows = np.repeat(np.arange(len(self.texts)), self.counts)
        #: ids as unsigned numbers of the same order
        self.rank = np.array([(1 << 64) - 1 if i is None else i + (1 << 63) for i in self.ids], U)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    changed = np.zeros(n, bool)
    changed[0] = True
    for k in keys:
        changed[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(changed)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def split_replies(bucket: int, src: list[int], n: list[int], flags: np.ndarray) -> pa.Table:
    """One reply of bits to each sender, in the order of its keys."""
    ends = np.cumsum(n).tolist()
    return messages(src, [bucket] * len(src), n, [bits(flags[e - k : e]) for e, k in zip(ends, n, strict=True)])


def joined_bits(group: pa.Table) -> np.ndarray:
    """The bits of all replies to a group, along its sorted keys."""
    src, n, body = (group.column(c).to_pylist() for c in ("src", "n", "body"))
    order = [i for i in sorted(range(len(src)), key=src.__getitem__) if src[i] >= 0]
    return np.concatenate([np.zeros(0, bool), *[unbits(body[i], n[i]) for i in order]])


def note_to_self(src: int, flags: np.ndarray) -> pa.Table:
    """A message that the buckets hand back: group g writes to bucket -1 - g."""
    return messages([-1 - src], [src], [len(flags)], [bits(flags)])


def own_note(group: pa.Table) -> np.ndarray:
    src, n, body = (group.column(c).to_pylist() for c in ("src", "n", "body"))
    return next(unbits(body[i], n[i]) for i in range(len(src)) if src[i] < 0)


def handed_back(group: pa.Table) -> pa.Table:
    """Notes return to their writers with a negative sender."""
    return messages(group.column("src").to_pylist(), [-1] * group.num_rows, group.column("n").to_pylist(), group.column("body").to_pylist())
