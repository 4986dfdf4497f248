"""Byte-exact dedup on sampled suffixes by bucket-pointer refinement.

Every place of a text has the identifier of its 8-byte gram; identifiers of
longer strings are made from those at later offsets, level by level (16, 32, 64,
128 bytes), each level from the one before. Only some suffixes are sorted into
buckets: the anchors. A window of ``length`` bytes has the place of its least
gram as its anchor, so equal windows have equal anchors at equal offsets, and
consecutive windows with one anchor form a cell.

1. Cells fall into the initial buckets of the 64-byte gram at their anchor. A
   cell alone in its bucket has no repeated window.
2. Buckets are refined by the identifiers of all bytes that a cell's windows
   cover: what still shares its bucket is repeated as a whole.
3. Cells that aren't are cut into short runs of windows, which fall into
   buckets by the bytes common to the run and are refined in the same way, and
   what is left of those into single windows.

Buckets are rows of a shuffle; equal ones are counted before it. Texts are
shuffled once, and that exchange serves the later steps.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairframe.llm.common import forgotten, stored
from pairframe.llm.wordhash import U, mix, runs, then

LENGTH, GRAM, BUCKET, RUN = 200, 8, 64, 12
#: Windows of a text that are worked on at a time; a place within them fits in PLACE bits.
BLOCK, PLACE = 1 << 18, 20
CELLS = "th long, s long, m int, a int, bucket long, full long, n long"
Piece = tuple[int, int, bytes]


def grams(data: bytes) -> np.ndarray:
    """The identifier of the eight bytes from each place on."""
    return mix(np.ndarray((max(0, len(data) - GRAM + 1),), "<u8", data, 0, (1,)).astype(U))


def identifier(gram: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Identifiers of the strings of ``length`` (a power of two) bytes from ``at`` on, from those of their halves."""
    if length == GRAM:
        return gram[at]
    return then(identifier(gram, at, length // 2), identifier(gram, at + length // 2, length // 2), length)


def wide_identifier(gram: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Identifiers of strings of 128 to 384 bytes: of three strings of 128 that cover them."""
    late = size - 128
    parts = [identifier(gram, at + shift, 128) for shift in (np.zeros_like(late), late // 2, late)]
    return then(then(parts[0], parts[1], 3), parts[2] + size.astype(U), 5)


def pieces(row: int, text: bytes, length: int) -> Iterator[Piece]:
    """(row, start, bytes): the windows of a text in blocks."""
    for at in range(0, len(text) - length + 1, BLOCK):
        yield row, at, text[at : at + BLOCK + length - 1]


def chunks(found: Iterable[Piece], size: int = 2 * BLOCK) -> Iterator[list[Piece]]:
    """Lists of pieces of about ``size`` bytes."""
    out, held = [], 0
    for piece in found:
        if out and held + len(piece[2]) > size:
            yield out
            out, held = [], 0
        out.append(piece)
        held += len(piece[2])
    if out:
        yield out


def least_places(gram: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of ``width`` identifiers from each place on; of equal ones the first."""
    low = U((1 << PLACE) - 1)
    out, span = (gram & ~low) | np.arange(len(gram), dtype=U), 1
    while span < width:
        step = min(span, width - span)
        out, span = np.minimum(out[:-step], out[step:]), span + step
    return (out & low).astype(np.int64)


def cells(held: list[Piece], length: int) -> tuple[np.ndarray, ...]:
    """piece, s (place in all bytes), m (windows), a (from s to the anchor), bucket, full of the cells of some pieces; and the identifiers."""
    data = b"".join(p[2] for p in held)
    sizes = np.array([len(p[2]) for p in held])
    ends = np.cumsum(sizes)
    gram = grams(data)
    anchor = least_places(gram, length - BUCKET + 1)[: len(data) - length + 1]
    place = np.arange(len(anchor))
    whole = place + length <= np.repeat(ends, sizes)[: len(anchor)]
    place, anchor = place[whole], anchor[whole]
    at = runs(anchor, place - np.arange(len(place)))  # a new anchor, or a gap
    s, m, a = place[at], np.diff(np.append(at, len(place))), anchor[at] - place[at]
    return np.searchsorted(ends, s, side="right"), s, m, a, identifier(gram, s + a, BUCKET), wide_identifier(gram, s, length - 1 + m), ends - sizes


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _ranges(lo: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """Merged ranges (lo, size) of overlapping or touching ones."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate((lo + size)[order])
    new = np.flatnonzero(np.append(True, lo[1:] > hi[:-1]))
    return list(zip(lo[new].tolist(), (np.append(hi[new[1:] - 1], hi[-1]) - lo[new]).tolist(), strict=True))


def _emit(ids: pa.Array, hashes: pa.Array, out: list[tuple]) -> pa.RecordBatch:
    """Rows of CELLS, with the ids in front, from tuples (row, s, m, a, bucket, full, n) of arrays."""
    row, s, m, a, bucket, full, n = (np.concatenate(c) for c in zip(*out, strict=True))
    own = pa.array(row)
    return pa.RecordBatch.from_arrays(
        [ids.take(own), hashes.take(own), pa.array(s.astype(np.int64)), pa.array(m.astype(np.int32)), pa.array(a.astype(np.int32)), _signed(bucket), _signed(full), pa.array(n.astype(np.int64))],
        names=["doc_id", "th", "s", "m", "a", "bucket", "full", "n"],
    )


def first_cells(length: int):
    """Texts to cells. Cells that one batch of pieces has twice are repeated: one of them is sent, with its number, and the ranges of all of them are noted with n = 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = enumerate(batch.column("body"))
            for held in chunks(p for i, text in texts for p in pieces(i, text.as_py(), length)):
                piece, s, m, a, bucket, full, starts = cells(held, length)
                rows, base = np.array([p[0] for p in held]), np.array([p[1] for p in held])
                row, s = rows[piece], s - starts[piece] + base[piece]
                order = np.lexsort((full, bucket))
                at = runs(bucket[order], full[order])
                count = np.diff(np.append(at, len(order)))
                first = order[at]
                out = [(row[first], s[first], m[first], a[first], bucket[first], full[first], count)]
                twice = np.flatnonzero(np.repeat(count > 1, count))
                again = order[twice]
                for r in np.unique(row[again]).tolist():
                    mine = again[row[again] == r]
                    spans = np.array(_ranges(s[mine], m[mine])).reshape(-1, 2)
                    none = np.zeros(len(spans), np.int64)
                    out.append((none + r, spans[:, 0], spans[:, 1], none, none.astype(U), none.astype(U), none))
                yield _emit(batch.column("doc_id"), batch.column("th"), out)

    return run


def _rows_by_size(sizes: np.ndarray, most: int = 2 * BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, end
        at = end


def cut_cells(length: int, run_length: int):
    """Texts with their unresolved cells to runs of windows, or to single windows."""
    core = length - run_length + 1

    def cut(data: bytes, s: np.ndarray, m: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, ...]:
        gram, anchor = grams(data), s + a
        # runs are aligned on the anchor: number k holds the windows that start k * run_length bytes and more before it
        k0, k1 = (a - m + 1) // run_length, a // run_length
        many = k1 - k0 + 1
        own = np.repeat(np.arange(len(s)), many)
        k = k0[own] + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
        top = anchor[own] - k * run_length
        lo, hi = np.maximum(s[own], top - run_length + 1), np.minimum((s + m - 1)[own], top)
        size = hi - lo + 1
        bucket = wide_identifier(gram, top, np.full(len(top), core)) if run_length > 1 else identifier(gram, lo, 128)
        return own, lo, size, anchor[own] - lo, bucket, wide_identifier(gram, lo, length - 1 + size), np.ones(len(lo), np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, todo = batch.column("body"), batch.column("todo")
            sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
            for at, end in _rows_by_size(sizes):
                data = b"".join(texts.slice(at, end - at).to_pylist())
                held = todo.slice(at, end - at)
                cells_ = held.flatten()
                row = np.repeat(np.arange(end - at), np.diff(held.offsets.to_numpy()))
                start = (np.cumsum(sizes[at:end]) - sizes[at:end])[row]
                s, m, a = (cells_.field(c).to_numpy().astype(np.int64) for c in ("s", "m", "a"))
                own, lo, *rest = cut(data, s + start, m, a)
                yield _emit(batch.column("doc_id"), batch.column("th"), [(at + row[own], lo - start[own], *rest)])

    return run


def removed(length: int):
    """Texts with the ranges of their repeated windows to what is left of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, gone, spans, kept = batch.column("body").to_pylist(), [], [], [], []
            for text, hits in zip(texts, batch.column("hits").to_pylist(), strict=True):
                n.append(len(text))
                cut = []
                if hits:
                    lo, m = (np.array(x, np.int64) for x in zip(*((h["s"], h["m"]) for h in hits), strict=True))
                    cut = _ranges(lo, m + length - 1)
                at, parts = 0, []
                for lo_, size in cut:
                    parts.append(text[at:lo_])
                    at = lo_ + size
                kept.append(b"".join([*parts, text[at:]]) if cut else text)
                gone.append(sum(size for _, size in cut))
                spans.append(len(cut))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in (n, gone, spans)], pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def refined(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repeated, contested) cells of stored ones, both stored.

    Repeated cells share their bucket and their full identifier with another.
    Contested ones share a bucket alone; with them goes one repeated cell of
    each kind in their bucket, for their windows may occur in such.
    """
    place = F.struct("doc_id", "th", "s", "m", "a")
    open_ = found.filter("n > 0")
    shared = stored(open_.groupBy("bucket").agg(F.sum("n").alias("held")).filter("held > 1").select("bucket"), "buckets")
    alive = stored(open_.join(shared, "bucket", "left_semi"), "cells")
    kinds = stored(alive.groupBy("bucket", "full").agg(F.sum("n").alias("held"), F.min(place).alias("place")), "kinds")
    repeated = stored(alive.join(kinds.filter("held > 1").select("bucket", "full"), ["bucket", "full"], "left_semi").select("doc_id", "th", "s", "m"), "repeated")
    single = stored(kinds.filter("held = 1").groupBy("bucket").agg(F.count("*").alias("singles")).select("bucket"), "buckets")
    witnesses = kinds.filter("held > 1").join(single, "bucket", "left_semi")
    contested = stored(kinds.filter("held = 1").select("place.*").unionAll(witnesses.select("place.*")), "contested")
    forgotten(shared, alive, kinds, single)
    return repeated, contested


def repeated_bytes(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (binary).

    A byte goes if a string of ``length`` bytes (160 to 256) that covers it also
    starts anywhere else: in another row, even with the same id and text, or in
    the same one; overlaps count. Null and empty texts have no bytes, and texts
    shorter than ``length`` lose none; null ids are kept; an empty table gives
    no rows; other columns are ignored. What is kept need not be valid UTF-8.
    Strings are compared by two 64-bit identifiers. Texts are worked on in
    blocks, so a long one costs what its bytes do.
    """
    if not 160 <= length <= 256:
        raise ValueError("length must be from 160 to 256")
    body = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(body).alias("th"), body.alias("body"))
    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, {CELLS}"

    def by_text(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        return rows.groupBy(F.col("doc_id").alias("id_"), F.col("th").alias("th_")).agg(F.collect_set(F.struct(*columns)).alias(name))

    def beside(rows: DataFrame, how: str) -> DataFrame:
        same = texts["doc_id"].eqNullSafe(rows["id_"]) & (texts["th"] == rows["th_"])
        return texts.hint("merge").join(rows, same, how).drop("id_", "th_")

    found = stored(texts.mapInArrow(first_cells(length), schema), "cells")
    sure = found.filter("n = 0").select("doc_id", "th", "s", "m")
    hits, left = refined(found)
    every = [sure, hits]
    for run_length in (RUN, 1):
        cut = stored(beside(by_text(left, "todo", "s", "m", "a"), "inner").mapInArrow(cut_cells(length, run_length), schema), "cells")
        hits, left = refined(cut)
        forgotten(cut)
        every.append(hits)
    whole = every[0]
    for more in every[1:]:
        whole = whole.unionAll(more)
    out = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary"
    return beside(by_text(whole, "hits", "s", "m"), "left").mapInArrow(removed(length), out)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS MATERIALIZED (SELECT r, 128 * j AS base, substr(h, 256 * j + 1, 654) AS b FROM d, range(greatest(0, (strlen(h) // 2 - 200) // 128 + 1)) AS t(j) WHERE strlen(h) >= 400),
w AS MATERIALIZED (SELECT r, base + i AS i, md5_number(substr(b, 2 * i + 1, 400)) AS k FROM b, range(128) AS t(i) WHERE 2 * i + 400 <= strlen(b)),
s AS (SELECT r, i FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
g AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200, true)::INT AS new FROM s),
n AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM g),
c AS (SELECT r, min(i) AS lo, max(i) + 200 AS hi FROM n GROUP BY r, g),
e AS (SELECT r, lo, hi, lead(lo) OVER (PARTITION BY r ORDER BY lo) AS next FROM c),
k AS (SELECT r, count(*) AS n_spans, sum(hi - lo)::BIGINT AS n_removed,
        string_agg(CASE WHEN next IS NULL THEN substr(h, 2 * hi + 1) ELSE substr(h, 2 * hi + 1, 2 * (next - hi)) END, '' ORDER BY lo) AS rest, min(lo) AS first FROM e JOIN d USING (r) GROUP BY r)
SELECT doc_id, strlen(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE substr(h, 1, 2 * first) || rest END)) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
