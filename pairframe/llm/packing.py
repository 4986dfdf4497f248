"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents' tokens. In each round a source earns
``quantum`` times its target share as credit and sends as many whole tokens as
its credit reaches; the fraction it can't spend stays as its deficit for the
next round, in whatever window or partition that falls. Round r of a source with
credit c therefore sends its tokens from floor(r c) up to floor((r + 1) c), so no
task has to walk the rounds: two prefix sums over small tables, one per source
and one over rounds, give every piece its place in the packed stream, which is
then cut into windows of ``length``.

A round's tokens differ from each source's credit by less than one, and with the
quantum of one window a window holds one round but for fewer tokens than there
are sources. So every window has the target mix to that precision, as long as
all queues last. A document is cut where the rounds of its source end.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairframe.llm.bpe import encode
from pairframe.llm.common import stored

#: A round fills one window, so the quantum is the length.
LENGTH, QUANTUM = 2048, 2048
BLOCK = 1024
#: Tokens that are cut into pieces at a time, a longer document excepted.
CUT_TOKENS = 1 << 21


@lru_cache(maxsize=2)
def encoder(tokenizer_file: str, pattern: str):
    """The byte-level BPE of a tokenizer file as a tiktoken encoding: the same ids, several times faster.

    In such a file ids rise with the rank of their merges, so they are the ranks.
    Strings of special tokens in a text get those tokens, as the file's own
    library has it.
    """
    import tiktoken
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(tokenizer_file)
    special = {t.content: i for i, t in made.get_added_tokens_decoder().items()}
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    shown = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(shown[c] for c in token): i for token, i in made.get_vocab(with_added_tokens=False).items() if token not in special}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def encoded(enc, text: str) -> list[int]:
    if any(s in text for s in enc.special_tokens_set):
        return enc.encode(text, allowed_special="all")
    return encode(enc, text)


def tokenized(docs: DataFrame, tokenizer_file: str, pattern: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, part, row, n, queued (tokens of its source before it in its part), ids (u2 or u4 binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_file, pattern)
        kind = "H" if max(enc.n_vocab, end_id + 1) <= 1 << 16 else "I"
        part, row, sent = TaskContext.get().partitionId(), 0, {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                ids, n, queued = [], [], []
                for text, source in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    one = array(kind, encoded(enc, text))
                    one.append(end_id)
                    ids.append(one.tobytes())
                    n.append(len(one))
                    queued.append(sent.get(source, 0))
                    sent[source] = queued[-1] + len(one)
                rows = len(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([part] * rows, pa.int32()), pa.array(range(row, row + rows), pa.int64()), pa.array(n, pa.int64()), pa.array(queued, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "source", "part", "row", "n", "queued", "ids"],
                )
                row += rows

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    source = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")) if source_col in docs.columns else F.lit("")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), source.alias("source"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, part int, row long, n long, queued long, ids binary")


def pack(
    docs: DataFrame,
    tokenizer_file: str,
    pattern: str,
    end_id: int,
    weights: DataFrame | None = None,
    length: int = LENGTH,
    quantum: int = QUANTUM,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Pieces of the packed stream: doc_id, source, start, length, doc_tokens, sequence_id, offset, ids (binary, u4).

    Every token of every document, its end id included, lies in exactly one
    piece. All sequences are full but for those of the tail, whose lengths are
    powers of two. ``weights`` (source, weight) sets the target shares; sources
    it leaves out, and all sources without it, weigh as many as their tokens.
    A null or empty text is its end id alone; a null source is the source "";
    repeated rows are packed as often as they occur; an empty table gives no
    rows; other columns are ignored.
    """
    tokens = stored(tokenized(docs, tokenizer_file, pattern, end_id, id_col, text_col, source_col), "tokens")
    meta = tokens.select("part", "row", "source", "n", "queued")
    parts = meta.groupBy("source", "part").agg(F.sum("n").alias("tokens"))
    sources = parts.groupBy("source").agg(F.sum("tokens").cast("double").alias("weight"))
    if weights is not None:
        given = weights.select("source", F.col("weight").cast("double").alias("given"))
        sources = sources.join(given, "source", "left").select("source", F.greatest(F.coalesce("given", "weight"), F.lit(1e-9)).alias("weight"))
    total, mass = parts.agg(F.sum("tokens")).first()[0] or 0, sources.agg(F.sum("weight")).first()[0]
    if not total:
        return tokens.select("doc_id", "source", F.lit(0).cast("long").alias("start"), F.col("n").alias("length"), F.col("n").alias("doc_tokens"), F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids").limit(0)

    before = F.sum("tokens").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("source", "part", F.coalesce(before, F.lit(0)).alias("begin")).join(sources, "source")
    credit = F.greatest(F.col("weight") / F.lit(float(mass)) * F.lit(float(quantum)), F.lit(1e-6))
    marked = meta.join(starts, ["source", "part"]).select("part", "row", "source", credit.alias("credit"), "n", (F.col("begin") + F.col("queued")).alias("at"))
    last, c = F.col("at") + F.col("n") - 1, F.col("credit")
    begun = lambda r: F.floor(r * c)
    # rounds tile the queue, so one more at either end makes rounding harmless: what isn't the document's is empty
    rounds = F.transform(F.sequence(F.floor(F.col("at") / c) - 1, F.floor(last / c) + 1), lambda r: F.struct(r.alias("round"), F.greatest(begun(r), "at").alias("at"), F.least(begun(r + 1), last + 1).alias("end")))
    # with less than one token's credit most rounds send nothing, so the tokens are listed instead
    singles = F.transform(F.sequence("at", last), lambda t: F.struct((F.ceil((t + 1) / c) - 1).alias("round"), t.alias("at"), (t + 1).alias("end")))
    sent = F.filter(F.when(c >= 1, rounds).otherwise(singles), lambda x: x["end"] > x["at"])
    packets = marked.select("part", "row", "source", F.col("at").alias("head"), F.explode(sent).alias("sent"))
    packets = packets.select("part", "row", "source", (F.col("sent.at") - F.col("head")).alias("start"), (F.col("sent.end") - F.col("sent.at")).alias("n"), F.col("sent.at").alias("at"), F.col("sent.round").alias("round"))
    # the stream's order is (round, source, queue place); both prefix sums run over sums, block by block
    sends = packets.groupBy("source", "round").agg(F.sum("n").alias("tokens"), F.min("at").alias("first")).withColumn("block", F.floor(F.col("round") / BLOCK))
    blocks = sends.groupBy("block").agg(F.sum("tokens").alias("block_tokens"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("block_tokens").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("block").orderBy("round", "source").rowsBetween(Window.unboundedPreceding, -1)
    sends = sends.withColumn("within", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(blocks, "block")
    placed = (
        packets.join(sends.select("source", "round", "first", (F.col("base") + F.col("within")).alias("sent")), ["source", "round"])
        .groupBy("part", "row")
        .agg(F.collect_list(F.struct("start", "n", (F.col("sent") + F.col("at") - F.col("first")).alias("place"))).alias("packets"))
    )
    edges = [total - total % length]
    for bit in range(length.bit_length(), -1, -1):
        if total % length >> bit & 1:
            edges.append(edges[-1] + (1 << bit))
    full, tail = total // length, np.array([*edges, np.iinfo(np.int64).max], np.int64)
    begins = lambda w: np.where(w < full, w * length, tail[np.clip(w - full, 0, len(tail) - 1)])
    window = lambda at: np.where(at < tail[0], at // length, full + np.searchsorted(tail, at, "right") - 1)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc_id, source, n, data, packets = batch.columns
        n, runs = n.to_numpy(), packets.flatten()
        start, size, place = (runs.field(k).to_numpy() for k in range(3))
        doc = np.repeat(np.arange(batch.num_rows), packets.value_lengths().to_numpy())
        order = np.lexsort((start, doc))
        doc, start, size, place = doc[order], start[order], size[order], place[order]
        first = window(place)
        many = window(place + size - 1) - first + 1
        at = np.repeat(np.arange(len(doc)), many)
        seq = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        low = np.maximum(place[at], begins(seq))
        take = np.minimum(place[at] + size[at], begins(seq + 1)) - low
        # by document and start the pieces are the batch's ids one after the other
        offsets = data.buffers()[1]
        bounds = np.frombuffer(offsets, np.int32)[data.offset : data.offset + batch.num_rows + 1]
        raw = np.frombuffer(data.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        flat = raw.view("<u2" if len(raw) == 2 * n.sum() else "<u4").astype("<u4")
        ends = np.concatenate([[0], np.cumsum(4 * take)]).astype(np.int32)
        ids = pa.Array.from_buffers(pa.binary(), len(take), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
        rows = pa.array(doc[at])
        numbers = [pa.array(c, pa.int64()) for c in (start[at] + low - place[at], take, n[doc[at]], seq, low - begins(seq))]
        return pa.RecordBatch.from_arrays([doc_id.take(rows), source.take(rows), *numbers, ids], ["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            upto, at = np.cumsum(whole.column(2).to_numpy()), 0
            while at < whole.num_rows:
                limit = (upto[at - 1] if at else 0) + CUT_TOKENS
                stop = max(at + 1, int(np.searchsorted(upto, limit, "right")))
                yield cut(whole.slice(at, stop - at))
                at = stop

    joined = tokens.join(placed, ["part", "row"]).select("doc_id", "source", "n", "ids", "packets")
    return joined.mapInArrow(pieces, "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
