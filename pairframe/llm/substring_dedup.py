"""Substring dedup by level-wise doubling of repeated word windows.

Windows of ``first`` words that occur in two documents are looked for; only
where one does may the window of twice as many words be repeated, so only those
are extended, level after level, until ``words`` is reached or nothing is left.
Below the last level one short window stands for each place: the one of least
hash inside the full window. Equal full windows pick equal short ones, so none
is lost, and about a quarter of the places has to be sent.

Texts are exchanged once, into groups; levels exchange sorted hash keys by
ranges and answer with one bit a key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pairframe.llm.wordhash import (
    MESSAGE,
    Texts,
    U,
    bucket_count,
    dealt,
    group_count,
    handed_back,
    joined_bits,
    messages,
    note_to_self,
    own_note,
    received,
    runs,
    send,
    split_replies,
    windows,
)

WORDS, FIRST = 13, 4


def levels(first: int, words: int) -> list[int]:
    """Doubled lengths from first, the last one cut to words."""
    out = [min(first, words)]
    while out[-1] < words:
        out.append(min(2 * out[-1], words))
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the ``width`` values from each place on."""
    span, out = 1, values
    while span < width:
        step = min(span, width - span)
        nearer = out.copy()
        nearer[: len(out) - step] = np.minimum(out[: len(out) - step], out[step:])
        out, span = nearer, span + step
    return out


def _stand_ins(texts: Texts, length: int, words: int) -> np.ndarray:
    """For each place, the least hash of the windows of ``length`` inside the one of ``words``."""
    return _least(windows(texts.hashes, texts.counts, length)[0], words - length + 1)


def _ask(texts: Texts, places: np.ndarray, length: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct stand-ins of the candidate places, whether two documents here have them, and each place's key index."""
    keys, docs = _stand_ins(texts, length, words)[places], texts.rank[texts.rows[places]]
    order = np.argsort(keys, kind="stable")
    at = runs(keys[order])
    index = np.empty(len(keys), np.int64)
    index[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(keys))))
    if not len(at):
        return keys, np.zeros(0, bool), index
    several = np.minimum.reduceat(docs[order], at) != np.maximum.reduceat(docs[order], at)
    return keys[order][at], several, index


def _first_ids(texts: Texts, places: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct full windows: hash, 32 more bits, least document here, and each place's key index."""
    keys = windows(texts.hashes, texts.counts, words)[0][places]
    more = windows(texts.hashes, texts.counts, words, seed=977)[0][places] >> U(32)
    docs = texts.rank[texts.rows[places]]
    order = np.lexsort((more, keys))
    at = runs(keys[order], more[order])
    index = np.empty(len(keys), np.int64)
    index[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(keys))))
    least = np.minimum.reduceat(docs[order], at) if len(at) else docs
    return keys[order][at], more[order][at], least, index


def _candidates(texts: Texts, replies: pa.Table | None, done: int, words: int) -> np.ndarray:
    """Places whose window may still be repeated, as flags, after the level of length ``done``."""
    if replies is None:
        return windows(texts.hashes, texts.counts, words)[1]
    flags = own_note(replies)
    places = np.flatnonzero(flags)
    _, _, index = _ask(texts, places, done, words)
    flags[places] = joined_bits(replies)[index]
    return flags


def repeated_passages(docs: DataFrame, words: int = WORDS, first: int = FIRST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept (binary: kept words joined by one space).

    A word goes if a window of ``words`` words that covers it also starts in a
    document with a smaller id. Null and empty texts have no words and texts
    shorter than the window lose none; a null id counts as larger than all
    others; rows with equal ids count as one document, so copies under the same
    id stay; an empty table gives no rows; other columns are ignored. Windows
    are compared by 96 bits of hash.
    """
    buckets, steps = bucket_count(docs), levels(first, words)
    groups = dealt(docs, id_col, text_col, group_count(docs))

    def asker(level: int):
        length, done = steps[level], steps[level - 1]

        def ask(group: pa.Table, replies: pa.Table | None = None) -> pa.Table:
            if not group.num_rows:
                return messages([], [], [], [])
            texts = Texts(group, lower=False)
            flags = _candidates(texts, replies, done, words)
            places = np.flatnonzero(flags)
            if length < words:
                keys, several, _ = _ask(texts, places, length, words)
                sent = send(texts.src, keys, [(several, 1)], buckets)
            else:
                keys, more, least, _ = _first_ids(texts, places, words)
                sent = send(texts.src, keys, [(more, 4), (least, 8)], buckets)
            return pa.concat_tables([sent, note_to_self(texts.src, flags)])

        return ask

    def shared(group: pa.Table) -> pa.Table:
        bucket = group.column("to")[0].as_py()
        if bucket < 0:
            return handed_back(group)
        src, n, keys, (several,) = received(group, 1)
        order = np.argsort(keys, kind="stable")
        at = runs(keys[order])
        sizes = np.diff(np.append(at, len(keys)))
        flags = np.empty(len(keys), bool)
        flags[order] = np.repeat((sizes > 1) | (np.maximum.reduceat(several[order], at) > 0), sizes)
        return split_replies(bucket, src, n, flags)

    def owned(group: pa.Table) -> pa.Table:
        bucket = group.column("to")[0].as_py()
        if bucket < 0:
            return handed_back(group)
        src, n, keys, (more, least) = received(group, 4, 8)
        order = np.lexsort((more, keys))
        at = runs(keys[order], more[order])
        sizes = np.diff(np.append(at, len(keys)))
        flags = np.empty(len(keys), bool)
        flags[order] = least[order] == np.repeat(np.minimum.reduceat(least[order], at), sizes)
        return split_replies(bucket, src, n, flags)

    def cut(group: pa.Table, replies: pa.Table) -> pa.Table:
        texts = Texts(group, lower=False)
        out: list[list] = [[], [], [], []]
        gone = np.zeros(len(texts.hashes), np.int64)
        if len(texts.hashes):
            places = np.flatnonzero(own_note(replies))
            _, _, least, index = _first_ids(texts, places, words)
            here_first = joined_bits(replies)[index]
            dropped = places[~here_first | (texts.rank[texts.rows[places]] > least[index])]
            size = len(gone) + 1
            gone = np.cumsum(np.bincount(dropped, minlength=size) - np.bincount(dropped + words, minlength=size))[: len(gone)]
        ends = np.cumsum(texts.counts)
        for doc_id, text, n, end in zip(texts.ids, texts.texts, texts.counts.tolist(), ends.tolist(), strict=True):
            keep = gone[end - n : end] == 0
            kept = text.split()
            if not keep.all():
                kept = [w for w, k in zip(kept, keep.tolist(), strict=True) if k]
            for column, value in zip(out, (doc_id, n, n - len(kept), b" ".join(kept)), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept"])

    by_group = lambda: groups.groupBy("src")
    replies = None
    for level, length in enumerate(steps):
        asked = by_group().applyInArrow(_alone(asker(level)), MESSAGE) if replies is None else by_group().cogroup(replies.groupBy("to")).applyInArrow(asker(level), MESSAGE)
        replies = asked.groupBy("to").applyInArrow(shared if length < words else owned, MESSAGE)
    return by_group().cogroup(replies.groupBy("to")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept binary")


def _alone(ask):
    def run(group: pa.Table) -> pa.Table:
        return ask(group)

    return run


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
f AS (SELECT k, min(doc_id) AS low FROM v GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM v JOIN f USING (k) WHERE low < doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM w),
left_ AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN left_ USING (doc_id)
"""
