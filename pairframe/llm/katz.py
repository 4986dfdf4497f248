"""Language-model scoring: a Katz backoff bigram model of the whole corpus.

Counts are Good-Turing discounted, and what the discounts free goes to words
not seen after a history, by backoff weights that make every history's
probabilities sum to one over the vocabulary and one unknown word.

The model lives in tables partitioned by key: word counts by ranges of word
hashes, bigram counts by history. Groups of documents ask the partitions for
their own words and bigrams and get counts back; a history that holds more than
a thousandth of all tokens is spread over all partitions by its next words, and
the parts of its sums are added up again by whoever asked. Each token is then
scored recursively: bigram if seen, else backoff weight times unigram.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairframe.llm.wordhash import MESSAGE, Texts, U, bucket_count, dealt, group_count, messages, planes, received, runs, send, unplanes

#: Hash of the token that ends every text and stands before its first word.
END = U(0x5EED0FE7D0C0DE01)
#: Counts up to K are discounted.
K = 5
#: Histories with at least 1/HOT of all tokens are spread; there are at most HOT.
HOT = 1000
#: Bytes of counts and word ids in messages.
WIDE = 5
REPLY = MESSAGE + ", stats array<bigint>"


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """Good-Turing factors d[1..K] (d[0] unused) from n[1..K+1], smoothed by a log-linear fit of n[r] over r.

    Copies raise some n[r], so raw factors can leave (0, 1). Along the fit A r^b
    the Turing ratio (r + 1) n[r+1] / (r n[r]) is ((r + 1) / r)^(b + 1), and all
    factors lie in (0, 1) whatever b is. Each n[r] weighs as much as it counts,
    the inverse of the variance of its logarithm. With fewer than two n[r] above
    0 there is no slope to fit, and b is -2, as under Zipf's law.
    """
    n = np.asarray(counts_of_counts, float)[1 : K + 2]
    out = np.ones(K + 1)
    r = np.arange(1, K + 2)
    some = n > 0
    b = -2.0
    if some.sum() > 1:
        x, y, weight = np.log(r[some]), np.log(n[some]), n[some] / n[some].sum()
        x = x - (weight * x).sum()
        b = (weight * x * y).sum() / (weight * x * x).sum()
    # as b goes to -1, powers less 1 over b + 1 go to logarithms
    less = np.expm1((b + 1) * np.log(np.append((r[:-1] + 1) / r[:-1], K + 1))) if abs(b + 1) > 1e-9 else np.log(np.append((r[:-1] + 1) / r[:-1], K + 1))
    out[1:] = 1 - less[:-1] / less[-1]
    return out


@dataclass(frozen=True)
class Unigrams:
    """Discounted word probabilities; counts of 0 are the one unknown word."""

    tokens: int
    words: int
    d: np.ndarray
    unknown: float
    scale: float

    @classmethod
    def of(cls, stats: list[int]) -> Unigrams:
        """stats: tokens, distinct words, then how many words have counts 1 .. K+1."""
        n = np.array([0, *stats[2 : K + 3]], float)
        d = discounts(n)
        tokens = stats[0]
        freed = float((np.arange(K + 1) * n[: K + 1] * (1 - d)).sum()) / tokens if tokens else 1.0
        scale = 1.0 if freed > 1e-12 else tokens / (tokens + 1)
        return cls(tokens, stats[1], d, 1 - scale * (1 - freed), scale)

    def p(self, count: np.ndarray) -> np.ndarray:
        c = count.astype(float)
        return np.where(count > 0, self.scale * self.d[np.where(count <= K, count, 0).astype(int)] * c / max(1, self.tokens), self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        """log10 of the add-one probability over the vocabulary and one more word."""
        return np.log10((count.astype(float) + 1) / (self.tokens + self.words + 1))


def trains(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 != 2


class _Tokens:
    """A group's texts as indices into its sorted distinct words, ends included."""

    def __init__(self, group: pa.Table):
        texts = Texts(group, lower=True)
        self.src, self.ids = texts.src, texts.ids
        self.lengths = texts.counts + 1
        last = np.cumsum(self.lengths) - 1
        every = np.empty(int(self.lengths.sum()), U)
        inner = np.ones(len(every), bool)
        inner[last] = False
        every[inner], every[last] = texts.hashes, END
        self.keys, self.at = np.unique(every, return_inverse=True)
        end = np.searchsorted(self.keys, END)
        self.before = np.empty_like(self.at)
        self.before[1:] = self.at[:-1]
        self.before[last - self.lengths + 1] = end
        self.train = np.repeat(np.array([trains(i) for i in self.ids], bool), self.lengths)

    def counts(self) -> np.ndarray:
        return np.bincount(self.at[self.train], minlength=len(self.keys))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (history, word) indices, every token's pair, and the pairs' training counts."""
        code, pair = np.unique(self.before * len(self.keys) + self.at, return_inverse=True)
        history, word = np.divmod(code, max(1, len(self.keys)))
        return history, word, pair, np.bincount(pair[self.train], minlength=len(code))


def _replies(table: pa.Table) -> tuple[list[int], list[bytes], list[int]]:
    """Sizes and bodies by bucket, and the global sums that came with them."""
    src, n, body = (table.column(c).to_pylist() for c in ("src", "n", "body"))
    order = sorted(range(len(src)), key=src.__getitem__)
    return [n[i] for i in order], [body[i] for i in order], table.column("stats")[0].as_py()


def _with_stats(table: pa.Table, rows: list[list[int] | None]) -> pa.Table:
    return table.append_column("stats", pa.array(rows, pa.list_(pa.int64())))


class _Asked:
    """How a group's bigrams are laid out over the buckets; the asking and the scoring step both need it."""

    def __init__(self, tokens: _Tokens, replies: pa.Table, buckets: int):
        sizes, bodies, stats = _replies(replies)
        read = lambda k: np.concatenate([unplanes(b[k * n * WIDE : (k + 1) * n * WIDE], n, WIDE) for b, n in zip(bodies, sizes, strict=True)])
        self.count, word_id = read(0), read(1)
        self.unigrams = Unigrams.of(stats)
        self.history, self.word, self.pair, self.train = tokens.pairs()
        hot = self.count * U(HOT) >= U(max(1, self.unigrams.tokens))
        spread = np.where(hot[self.history], word_id[self.history] + word_id[self.word] // U(buckets) * U(7919) + word_id[self.word], word_id[self.history]) % U(buckets)
        self.order = np.lexsort((word_id[self.word], word_id[self.history], spread))
        self.edges = np.searchsorted(spread[self.order], np.arange(buckets + 1, dtype=U))
        self.word_id = word_id
        self.hot = np.flatnonzero(hot)

    def histories(self, bucket: int) -> tuple[np.ndarray, np.ndarray]:
        """Histories of a bucket's bigrams, with how many each has; hot ones without any come last."""
        h = self.history[self.order[self.edges[bucket] : self.edges[bucket + 1]]]
        at = runs(h)
        found, many = h[at], np.diff(np.append(at, len(h)))
        rest = np.setdiff1d(self.hot, found)
        return np.concatenate([found, rest]), np.concatenate([many, np.zeros(len(rest), many.dtype)])


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Rows whose crc32 of the id as text is 2 modulo 7 are held out of learning. A
    null or empty text is its end token alone. With nothing to learn from, all
    words are the unknown one. Rows with equal ids are scored and learned from
    each; an empty table gives no rows; other columns are ignored. Words are
    known by 64-bit hashes.
    """
    # larger groups repeat fewer words and bigrams, and smaller buckets hold their sums
    buckets = bucket_count(docs) * 6 // 5 + 1
    word_buckets = bucket_count(docs) * 3 // 5 + 1
    groups = dealt(docs, id_col, text_col, group_count(docs) * 2 // 3)

    def ask_words(group: pa.Table) -> pa.Table:
        tokens = _Tokens(group)
        return send(tokens.src, tokens.keys, [(tokens.counts(), WIDE)], word_buckets)

    def count_words(group: pa.Table) -> pa.Table:
        bucket = group.column("to")[0].as_py()
        src, n, keys, (counts,) = received(group, WIDE)
        order = np.argsort(keys, kind="stable")
        at = runs(keys[order])
        total = np.add.reduceat(counts[order], at)
        rank = np.empty(len(at), U)
        rank[np.argsort(-total.astype(np.int64), kind="stable")] = np.arange(len(at), dtype=U)
        size = np.diff(np.append(at, len(keys)))
        count, ids = np.empty(len(keys), U), np.empty(len(keys), U)
        count[order], ids[order] = np.repeat(total, size), np.repeat(rank * U(word_buckets) + U(bucket), size)
        ends = np.cumsum(n).tolist()
        out = messages(src, [bucket] * len(src), n, [planes(count[e - k : e], WIDE) + planes(ids[e - k : e], WIDE) for e, k in zip(ends, n, strict=True)])
        stats = [int(total.sum()), int((total > 0).sum()), *[int((total == r).sum()) for r in range(1, K + 2)]]
        return pa.concat_tables([_with_stats(out, [None] * len(src)), _with_stats(messages([-1], [bucket], [0], [b""]), [stats])])

    def ask_bigrams(group: pa.Table, replies: pa.Table) -> pa.Table:
        tokens = _Tokens(group)
        asked = _Asked(tokens, replies, buckets)
        u = asked.unigrams
        head = np.array([u.tokens, u.unknown, u.scale, *u.d[1:]], "<f8").tobytes()
        n, body = [], []
        for b in range(buckets):
            pick = asked.order[asked.edges[b] : asked.edges[b + 1]]
            histories, many = asked.histories(b)
            word = asked.word[pick]
            body.append(
                head + len(histories).to_bytes(8, "little") + planes(asked.word_id[histories], WIDE) + planes(many, WIDE)
                + planes(asked.word_id[word], WIDE) + planes(asked.count[word], WIDE) + planes(asked.train[pick], WIDE)
            )
            n.append(len(pick))
        some = [b for b in range(buckets) if n[b] or len(asked.hot)]
        return messages(some, [tokens.src] * len(some), [n[b] for b in some], [body[b] for b in some])

    def count_bigrams(group: pa.Table) -> pa.Table:
        bucket = group.column("to")[0].as_py()
        src, n, bodies = (group.column(c).to_pylist() for c in ("src", "n", "body"))
        head = 8 * (3 + K)
        first = np.frombuffer(bodies[0], "<f8", 3 + K)
        u = Unigrams(int(first[0]), 0, np.array([1.0, *first[3:]]), first[1], first[2])
        history_ids, many, word_ids, counts, train, histories = [], [], [], [], [], []
        for k, body in zip(n, bodies, strict=True):
            m = int.from_bytes(body[head : head + 8], "little")
            at = head + 8
            for out, size in ((history_ids, m), (many, m), (word_ids, k), (counts, k), (train, k)):
                out.append(unplanes(body[at : at + size * WIDE], size, WIDE))
                at += size * WIDE
            histories.append(m)
        h_all, many_all = np.concatenate(history_ids), np.concatenate(many).astype(np.int64)
        h, w, c, t = np.repeat(h_all, many_all), np.concatenate(word_ids), np.concatenate(counts), np.concatenate(train)
        order = np.lexsort((w, h))
        at = runs(h[order], w[order])
        total = np.add.reduceat(t[order], at) if len(at) else t
        every = np.empty(len(h), U)
        every[order] = np.repeat(total, np.diff(np.append(at, len(h))))
        # sums of each history over its distinct seen words
        names, place = np.unique(h_all, return_inverse=True)
        own = np.searchsorted(names, h[order][at])
        seen = total > 0
        own, total_seen, p = own[seen], total[seen], u.p(c[order][at][seen])
        few = [np.bincount(own[total_seen == r], minlength=len(names)) for r in range(1, K + 1)]
        most = np.bincount(own, weights=np.where(total_seen > K, total_seen, 0).astype(float), minlength=len(names)).astype(np.int64)
        mass = np.bincount(own, weights=p, minlength=len(names))
        out, at_pair, at_history = [], 0, 0
        for k, m in zip(n, histories, strict=True):
            mine = place[at_history : at_history + m]
            out.append(planes(every[at_pair : at_pair + k], WIDE) + b"".join(planes(x[mine], WIDE) for x in (*few, most)) + planes(mass[mine].view(U), 8))
            at_pair, at_history = at_pair + k, at_history + m
        stats = [int((total == r).sum()) for r in range(1, K + 2)]
        replies = messages(src, [bucket] * len(src), n, out)
        return pa.concat_tables([_with_stats(replies, [None] * len(src)), _with_stats(messages([-1], [bucket], [0], [b""]), [stats])])

    def score(group: pa.Table, replies: pa.Table) -> pa.Table:
        tokens = _Tokens(group)
        words = replies.filter(pa.compute.equal(replies.column("step"), 1))
        asked = _Asked(tokens, words, buckets)
        u = asked.unigrams
        _, bodies, stats = _replies(replies.filter(pa.compute.equal(replies.column("step"), 2)))
        d = discounts(np.array([0, *stats], float))
        keys = len(tokens.keys)
        few, most, mass = np.zeros((K, keys)), np.zeros(keys), np.zeros(keys)
        count = np.zeros(len(asked.history), U)
        some = [b for b in range(buckets) if asked.edges[b] < asked.edges[b + 1] or len(asked.hot)]
        for b, body in zip(some, bodies, strict=True):
            pick = asked.order[asked.edges[b] : asked.edges[b + 1]]
            histories, _ = asked.histories(b)
            k, m = len(pick), len(histories)
            count[pick] = unplanes(body[: k * WIDE], k, WIDE)
            at = k * WIDE
            for sums in (*few, most):
                np.add.at(sums, histories, unplanes(body[at : at + m * WIDE], m, WIDE).astype(float))
                at += m * WIDE
            np.add.at(mass, histories, unplanes(body[at : at + 8 * m], m, 8).view(np.float64))
        own = asked.count.astype(float)
        kept = ((np.arange(1, K + 1) * d[1:])[:, None] * few).sum(0) + most
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.where(own > 0, kept / own, 0.0)
            scale = np.where((own > 0) & (share > 1 - 1e-12), own / (own + 1), 1.0)
            backoff = np.where(own > 0, (1 - scale * share) / (1 - mass), 1.0)
            c = count.astype(float)
            given = scale[asked.history] * d[np.where(count <= K, count, 0).astype(int)] * c / own[asked.history]
            log_p = np.log10(np.where(count > 0, given, backoff[asked.history] * u.p(asked.count)[asked.word]))
        by_text = lambda x: np.add.reduceat(x, np.cumsum(tokens.lengths) - tokens.lengths)
        rows = len(tokens.ids)
        return pa.table({
            "doc_id": pa.array(tokens.ids, pa.int64()), "held_out": pa.array([not trains(i) for i in tokens.ids], pa.bool_()),
            "n_tokens": pa.array(tokens.lengths, pa.int64()), "n_known": pa.array(by_text((asked.count[tokens.at] > 0).astype(np.int64)), pa.int64()),
            "train_tokens": pa.array([u.tokens] * rows, pa.int64()),
            "base_score": pa.array(by_text(u.base(asked.count)[tokens.at]), pa.float64()), "score": pa.array(by_text(log_p[asked.pair]), pa.float64()),
        })

    def with_sums(replies: DataFrame, sums: int) -> DataFrame:
        """Replies to groups, each with the sums over all buckets."""
        total = replies.filter("to < 0").agg(F.array(*[F.sum(F.get("stats", F.lit(i))) for i in range(sums)]).alias("stats"))
        return replies.filter("to >= 0").drop("stats").select("*", total.scalar().alias("stats"))

    by_group = lambda: groups.groupBy("src")
    words = with_sums(by_group().applyInArrow(ask_words, MESSAGE).groupBy("to").applyInArrow(count_words, REPLY), K + 3)
    asked = by_group().cogroup(words.groupBy("to")).applyInArrow(ask_bigrams, MESSAGE)
    bigrams = with_sums(asked.groupBy("to").applyInArrow(count_bigrams, REPLY), K + 1)
    both = words.withColumn("step", F.lit(1)).union(bigrams.withColumn("step", F.lit(2)))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return by_group().cogroup(both.groupBy("to")).applyInArrow(score, schema)
