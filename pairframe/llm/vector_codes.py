"""Product codes of vectors by active-entry Lloyd rounds on integer components.

Every part position has a codebook. A round assigns every part to its nearest
entry and then moves entries to the floored means of their parts. Codes and
exact distances are stored with the vectors. In the next round a part whose
entry stayed where it was compares only the entries that moved with its stored
distance; a part whose entry moved compares all of them again. Vectors never
leave their partition; a round's sums are one row per (part, entry) and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairframe.llm.common import forgotten, stored

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Larger integer components could overflow a sum of squares.
LARGEST = 1 << 26
#: Rows that are compared with all entries at a time.
BLOCK = 4096


def lattice(vectors: pa.Array, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) of equally long vectors, one row each."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.diff(vectors.offsets.to_numpy())
    if not (sizes == width).all():
        raise ValueError(f"vectors must have {width} components like the first one")
    out = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(len(vectors), width)
    if out.size and np.abs(out).max() >= LARGEST:
        raise OverflowError(f"scaled components must be below {LARGEST}")
    return out.astype(np.int64)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties: the lowest) and its squared distance, for every row of x."""
    code, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for at in range(0, len(x), BLOCK):
        d = ((x[at : at + BLOCK, None, :] - entries) ** 2).sum(-1)
        code[at : at + BLOCK] = d.argmin(1)
        error[at : at + BLOCK] = d.min(1)
    return code, error


def reassigned(x: np.ndarray, code: np.ndarray, error: np.ndarray, entries: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What nearest(x, entries) gives, from the codes and distances before the entries flagged in ``moved`` changed."""
    code, error = code.copy(), error.copy()
    active = np.flatnonzero(moved)
    if not len(active):
        return code, error
    again = moved[code]
    code[again], error[again] = nearest(x[again], entries)
    still = np.flatnonzero(~again)
    which, d = nearest(x[still], entries[active])
    which = active[which]
    better = (d < error[still]) | ((d == error[still]) & (which < code[still]))
    code[still[better]], error[still[better]] = which[better], d[better]
    return code, error


def _books(first: np.ndarray, parts: int) -> np.ndarray:
    """[part, entry, component] from the first vectors."""
    return first.reshape(len(first), parts, first.shape[1] // parts).transpose(1, 0, 2).copy()


def _sums(rows: DataFrame, books: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and component sums of the parts of every entry: as many numbers as the codebooks have."""
    parts, entries, width = books.shape

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            x = lattice(batch.column("vector"), scale, parts * width).reshape(-1, parts, width)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                counts[p] += np.bincount(code[:, p], minlength=entries)
                np.add.at(sums[p], code[:, p], x[:, p])
        p, e = np.nonzero(counts)
        columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), *[pa.array(sums[p, e, k]) for k in range(width)]]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", *[f"s{k}" for k in range(width)]])

    names = [f"s{k}" for k in range(width)]
    found = rows.select("vector", "code").mapInArrow(partial, "part int, entry int, n long, " + ", ".join(f"{s} long" for s in names))
    counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
    for row in found.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).collect():
        counts[row.part, row.entry], sums[row.part, row.entry] = row.n, [row[s] for s in names]
    return counts, sums


def _assigned(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None, scale: int) -> DataFrame:
    """rows with code (a byte a part) and distances (8 bytes a part); moved is None in the first round."""
    parts, _, width = books.shape

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = lattice(batch.column("vector"), scale, parts * width).reshape(-1, parts, width)
            code, error = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), np.int64)
            if moved is not None:
                code[:] = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
                error[:] = np.frombuffer(b"".join(batch.column("distances").to_pylist()), "<i8").reshape(-1, parts)
            for p in range(parts):
                found = nearest(x[:, p], books[p]) if moved is None else reassigned(x[:, p], code[:, p], error[:, p], books[p], moved[p])
                code[:, p], error[:, p] = found
            packed = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (code.astype(np.uint8), error.astype("<i8"))]
            kept = [batch.column(c) for c in ("vec_id", "label", "vector")]
            yield pa.RecordBatch.from_arrays([*kept, *packed, pa.array(error.sum(1))], names=["vec_id", "label", "vector", "code", "distances", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in ("vec_id", "label", "vector"))
    return rows.mapInArrow(assign, kinds + ", code binary, distances binary, error long")


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, vector, code, distances, error) of every kept row, and the codebooks [part, entry, component].

    Rows whose vector is null or has a null or non-finite component are left
    out. The first codebooks are the vectors of the ``entries`` smallest ids
    (null ids come last, equal ids by their vectors), fewer if there are fewer
    rows; equal entries tie to the lower index. Repeated rows each count. An
    empty table gives no rows and empty codebooks; other columns are ignored. A
    vector of another length than the first, a length that the parts do not
    divide, or a scaled component of 2**26 and more is an error.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is a byte, so at most 256 entries")
    clean = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vector").isNotNull() & clean).withColumn("vector", F.col("vector").cast(vectors.schema[vector_col].dataType))
    first = rows.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    width = len(first[0].vector) if first else 0
    if width % parts or (first and not width):
        raise ValueError(f"{parts} equal parts cannot be cut from {width} components")
    books = _books(lattice(pa.array([r.vector for r in first], pa.list_(pa.float64())), scale, width), parts)
    if not first:
        return rows.withColumns({"code": F.lit(b""), "distances": F.lit(b""), "error": F.lit(0).cast("long")}), books
    state, moved = stored(_assigned(rows, books, None, scale), "codes"), None
    for _ in range(rounds):
        counts, sums = _sums(state, books, scale)
        means = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], books)
        moved, books = (means != books).any(-1), means
        state, before = stored(_assigned(state, books, moved, scale), "codes"), state
        forgotten(before)
    return state, books


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes with label_error: error summed over equal labels, null ones together. A label's rows are summed before the shuffle and a join that splits hot keys hands the sum back."""
    sums = stored(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    sums = sums.withColumnRenamed("label", "of_label")
    return codes.join(sums, codes["label"].eqNullSafe(sums["of_label"])).drop("of_label")


def hex_digits(code: str) -> Column:
    return F.lower(F.hex(code))


def books_sha256(books: np.ndarray) -> str:
    """Of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


ORACLE = """
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, len(embedding) // 16 AS width FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * width + 1:(p + 1) * width] AS x FROM kept, range(16) AS t(p)),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64),
c0 AS (SELECT p, e, x FROM parts JOIN seeds USING (vec_id)),
{rounds}
final AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id, label),
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM final, books
"""

_ASSIGN = """
a{k} AS MATERIALIZED (
    SELECT vec_id, label, p, x, m % 64 AS e, m // 64 AS d FROM (
        SELECT vec_id, any_value(label) AS label, parts.p AS p, any_value(parts.x) AS x,
               min(64 * list_sum(list_transform(list_zip(parts.x, c{k}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT + e) AS m
        FROM parts JOIN c{k} USING (p) GROUP BY vec_id, parts.p)),"""

_MOVE = """
c{k} AS MATERIALIZED (
    SELECT p, e, coalesce(m.x, c{j}.x) AS x FROM c{j} LEFT JOIN (
        SELECT p, e, list(((s - (((s % n) + n) % n)) // n)::BIGINT ORDER BY i) AS x FROM (
            SELECT p, e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{j}, range(1, 65) AS t(i) WHERE i <= len(x) GROUP BY p, e, i)
        GROUP BY p, e) AS m USING (p, e)),"""

ORACLE = ORACLE.replace("{rounds}", "".join(_ASSIGN.format(k=k) + (_MOVE.format(k=k + 1, j=k) if k < ROUNDS else "") for k in range(ROUNDS + 1)))
