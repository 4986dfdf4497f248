"""N-gram Jaccard join by grouped prefixes.

A document is the set of its distinct word shingles; equal sets form a class.
Shingles are ordered by how many classes hold them, so a set's prefix starts
with its rarest ones, and two sets that reach the threshold share a token of
their prefixes. Classes of equal size and prefix are one group; groups are
paired over shared prefix tokens, filtered by size, by the places of the token
in both and by the number of tokens the prefixes share, expanded to their
classes, and verified on all tokens that more than one set has.

The first token two sets share, in that order, bounds what they can share by
what lies behind it in each. So a posting (token, set) has a range of partner
sizes of its own, and where no other holder of the token is in range it is
dropped before any pair is made: pages of one template that are too different
to link cost as many postings as they are, not their square.

Large families of near copies would be all pairs. So first every group is
verified against one leader only, the links found are contracted to components,
and only pairs of different components are looked at in full after that. Every
component comes out whole: a pair is left out only where both sides are already
connected.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairframe.llm.common import fresh, shuffle_partitions, stored
from pairframe.llm.components import components
from pairframe.llm.wordhash import MESSAGE, Texts, U, bucket_count, group_count, messages, planes, received, runs, send, unplanes, windows

SHINGLE, PERCENT = 5, 75
#: Holders of a token that meet a group at a time.
CHUNK = 1000
#: Bytes of a token.
TOKEN = 8
#: Holders of a token whose sizes differ by less than this factor stand in one list.
STEP = 1.1


def _dealt(docs: DataFrame, id_col: str, text_col: str, groups: int) -> DataFrame:
    """src, doc_id, body: equal texts meet in one group, but for texts with more copies than a group should have.

    Fewer than ``groups`` texts can have more than 1/groups of all rows, which
    bounds what is broadcast.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("body"), F.xxhash64(text).alias("text_hash"))
    most = rows.count() / groups
    hot = rows.groupBy("text_hash").agg(F.count("*").alias("copies")).filter(F.col("copies") > F.lit(float(most))).select("text_hash", F.lit(True).alias("hot"))
    spread = F.when(F.col("hot"), F.xxhash64("text_hash", "doc_id")).otherwise(F.col("text_hash"))
    return rows.join(F.broadcast(hot), "text_hash", "left").select(F.pmod(F.xxhash64(spread), F.lit(groups)).cast("int").alias("src"), "doc_id", "body")


class _Sets:
    """Shingle sets of a group's texts: distinct sets one after another, and each text's set."""

    def __init__(self, group: pa.Table, shingle: int):
        texts = Texts(group, lower=True)
        hashes, whole = windows(texts.hashes, texts.counts, shingle)
        rows, keys = [texts.rows[whole]], [hashes[whole]]
        ends = np.cumsum(texts.counts)
        for i in np.flatnonzero((texts.counts > 0) & (texts.counts < shingle)).tolist():
            words = texts.hashes[ends[i] - texts.counts[i] : ends[i]]
            rows.append(np.array([i]))
            keys.append(np.array([xxhash.xxh3_64_intdigest(words.tobytes(), seed=5)], U))
        rows_, keys_ = np.concatenate(rows), np.concatenate(keys)
        order = np.lexsort((keys_, rows_))
        at = runs(rows_[order], keys_[order])
        rows_, keys_ = rows_[order][at], keys_[order][at]
        starts = np.searchsorted(rows_, np.arange(len(texts.ids) + 1))
        self.src, self.ids = texts.src, texts.ids
        self.sizes = np.diff(starts).tolist()
        self.digests: list[bytes | None] = []
        #: digest -> its tokens, for the first text that has it
        self.sets: dict[bytes, np.ndarray] = {}
        for i, size in enumerate(self.sizes):
            tokens = keys_[starts[i] : starts[i] + size]
            digest = xxhash.xxh3_128_digest(tokens.tobytes()) if size else None
            self.digests.append(digest)
            if digest is not None and digest not in self.sets:
                self.sets[digest] = tokens

    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct tokens, the index of every token of every set, and the classes here that hold each."""
        return np.unique(np.concatenate([np.zeros(0, U), *self.sets.values()]), return_inverse=True, return_counts=True)


def shingle_classes(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """One row per row of docs: doc_id, n, digest of its set; and, once per group and class that can have a partner:
    lone (prefix tokens no other set has), prefix (the others, in order), tokens (all shared ones, sorted)."""
    buckets = bucket_count(docs)
    groups = _dealt(docs, id_col, text_col, group_count(docs))

    def ask(group: pa.Table) -> pa.Table:
        sets = _Sets(group, shingle)
        keys, _, counts = sets.tokens()
        return pa.concat_tables([send(sets.src, keys, [(np.minimum(counts, 65535), 2)], buckets), messages([-1 - sets.src], [sets.src], [0], [b""])])

    def count(group: pa.Table) -> pa.Table:
        bucket = group.column("to")[0].as_py()
        if bucket < 0:
            return messages(group.column("src").to_pylist(), [-1] * group.num_rows, [0] * group.num_rows, [b""] * group.num_rows)
        src, n, keys, (counts,) = received(group, 2)
        order = np.argsort(keys, kind="stable")
        at = runs(keys[order])
        total = np.minimum(np.add.reduceat(counts[order], at), U(65535))
        out = np.empty(len(keys), U)
        out[order] = np.repeat(total, np.diff(np.append(at, len(keys))))
        ends = np.cumsum(n).tolist()
        return messages(src, [bucket] * len(src), n, [planes(out[e - k : e], 2) for e, k in zip(ends, n, strict=True)])

    def classes(group: pa.Table, replies: pa.Table) -> pa.Table:
        sets = _Sets(group, shingle)
        src, n, body = (replies.column(c).to_pylist() for c in ("src", "n", "body"))
        held = np.concatenate([np.zeros(0, U), *[unplanes(body[i], n[i], 2) for i in sorted(range(len(src)), key=src.__getitem__) if src[i] >= 0]])
        held = held[sets.tokens()[1]]
        found: dict[bytes, tuple] = {}
        at = 0
        for digest, tokens in sets.sets.items():
            size = len(tokens)
            of = held[at : at + size]
            at += size
            shared = of > 1
            lone = size - int(shared.sum())
            prefix = size - (percent * size + 99) // 100 + 1
            if lone < prefix:
                mine, of = tokens[shared], of[shared]
                first = np.lexsort((mine, of))[: prefix - lone]
                found[digest] = (lone, mine[first].view(np.int64).tolist(), planes(mine, TOKEN))
        seen: set = set()
        out: list[list] = [[] for _ in range(6)]
        for doc_id, size, digest in zip(sets.ids, sets.sizes, sets.digests, strict=True):
            extra = found.get(digest, (None,) * 3) if digest not in seen else (None,) * 3
            seen.add(digest)
            for column, value in zip(out, (doc_id, size, digest, *extra), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "n", "digest", "lone", "prefix", "tokens"])

    replies = groups.groupBy("src").applyInArrow(ask, MESSAGE).groupBy("to").applyInArrow(count, MESSAGE)
    schema = "doc_id long, n long, digest binary, lone long, prefix array<long>, tokens binary"
    return stored(groups.groupBy("src").cogroup(replies.groupBy("to")).applyInArrow(classes, schema), "classes")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of digests whose sets reach the threshold.

    Pairs are dealt out by a and a salt of b, so that a set with many partners
    is compared in many tasks; its tokens go once to each of them.
    """
    spread = 8 * shuffle_partitions(pairs.sparkSession)
    dealt = pairs.withColumn("deal", F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.lit(64))), F.lit(spread)).cast("int"))
    right = dealt.join(sets.withColumnRenamed("digest", "b"), "b").select("deal", "a", "b", "n", "tokens")
    left = dealt.select("deal", "a").distinct().join(sets.withColumnRenamed("digest", "a"), "a")
    left = left.select(F.col("deal").alias("to"), F.col("a").alias("key"), F.col("n").alias("size"), F.col("tokens").alias("mine"))

    def compare(lefts: pa.Table, rights: pa.Table) -> pa.Table:
        read = lambda data: unplanes(data, len(data) // TOKEN, TOKEN)
        known = {a: (n, read(t)) for a, n, t in zip(*(lefts.column(c).to_pylist() for c in ("key", "size", "mine")), strict=True)}
        out: tuple[list, list] = ([], [])
        for a, b, n, data in zip(*(rights.column(c).to_pylist() for c in ("a", "b", "n", "tokens")), strict=True):
            size, mine = known[a]
            common = len(np.intersect1d(mine, read(data), assume_unique=True))
            if 100 * common >= percent * (size + n - common):
                out[0].append(a)
                out[1].append(b)
        return pa.table([pa.array(c, pa.binary()) for c in out], names=["a", "b"])

    return stored(left.groupBy("to").cogroup(right.groupBy("deal")).applyInArrow(compare, "a binary, b binary"), "links")


def prefixes(made: DataFrame) -> DataFrame:
    """One row per class that can have a partner: digest, n, lone, prefix, and its group: equal size and prefix. A prefix with a token of its own is like no other."""
    one = made.filter("tokens is not null").select("digest", "n", "lone", "prefix").dropDuplicates(["digest"])
    group = F.when(F.col("lone") > 0, F.col("digest")).otherwise(F.unhex(F.md5(F.concat_ws(",", F.col("n").cast("string"), F.array_join("prefix", ",")).cast("binary"))))
    return one.select("digest", "n", "lone", group.alias("group"), "prefix")


def postings(one: DataFrame, percent: int) -> DataFrame:
    """(token, g, n, top, lone) for the prefix tokens of every group: size n, and the largest partner size the token's place allows.

    Two sets of n and m that link share percent (n + m) / (100 + percent) tokens
    at least, all of them from their first shared one on; in a set with r tokens
    from there on, m is at most r (100 + percent) / percent - n.
    """
    places = F.posexplode("prefix").alias("place", "token")
    rows = one.dropDuplicates(["group"]).select("group", "n", "lone", places)
    behind = F.col("n") - F.col("lone") - F.col("place")
    top = F.least(F.floor(behind * (100 + percent) / percent) - F.col("n"), F.floor(F.col("n") * 100 / percent)).cast("long")
    return rows.select("token", "group", F.xxhash64("group").alias("g"), "n", "lone", top.alias("top"))


def in_range(post: DataFrame) -> DataFrame:
    """Postings that have another size in reach and are in another one's reach, by the token's least size and farthest reach."""
    reach = post.groupBy("token").agg(F.min("n").alias("least"), F.max("top").alias("farthest"), F.count("*").alias("holders"))
    return post.join(reach.filter("holders > 1"), "token").filter("least <= top and n <= farthest").drop("least", "farthest", "holders")


def _across(post: DataFrame, span: DataFrame, one: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups (group, group2) that lie in different components and may hold linked sets.

    The side in the smaller component looks for the other one, so a large family
    of copies is looked at by strangers only. A group meets lists of its tokens'
    holders, which are of about one size and ``CHUNK`` at most, and only those
    lists that its range and theirs allow.
    """
    code = F.when(F.col("low") == F.col("high"), F.xxhash64("low")).otherwise(F.xxhash64("group", F.lit(1)))
    known = span.select("group", code.alias("comp"))
    known = known.join(known.groupBy("comp").agg(F.count("*").alias("size")), "comp")
    rest = post.join(known, "group").select("token", "g", "n", "top", "size", "comp")
    tops = rest.groupBy("token").agg(F.max(F.struct("size", "comp")).alias("most"), F.min(F.struct("size", "comp")).alias("low"))
    rest = rest.join(tops.filter("most <> low").select("token", F.col("most.comp").alias("most")), "token")
    # a token's strangers to its largest component look for all others
    scale = F.floor(F.log(F.col("n").cast("double")) / math.log(STEP)).cast("int")
    sizes = rest.groupBy("token", scale.alias("scale")).agg(F.count("*").alias("many"))
    cell = F.struct(F.col("g").alias("y"), F.col("n").alias("m"), F.col("top").alias("top_y"), F.col("size").alias("size_y"), F.col("comp").alias("comp_y"))
    chunk = F.pmod(F.xxhash64("g", F.lit(9)), F.ceil(F.col("many") / CHUNK))
    lists = rest.withColumn("scale", scale).join(sizes, ["token", "scale"]).groupBy("token", "scale", chunk.alias("chunk"))
    lists = lists.agg(F.collect_list(cell).alias("cells"), F.min("n").alias("least"), F.max("n").alias("largest"), F.max("top").alias("farthest"))
    seekers = rest.filter("comp <> most").select("token", "g", "n", "top", "size", "comp")
    spread = 4 * shuffle_partitions(post.sparkSession)
    met = seekers.join(lists, "token").filter((F.col("least") <= F.col("top")) & (F.col("n") <= F.col("farthest")) & (100 * F.col("largest") >= percent * F.col("n")))
    met = met.select(F.pmod(F.xxhash64("g"), F.lit(spread)).cast("int").alias("deal"), "g", "n", "top", "size", "comp", "cells")

    def pair(rows: pa.Table) -> pa.Table:
        cells = rows.column("cells").combine_chunks()
        many = np.asarray(cells.value_lengths())
        flat = cells.flatten()
        y, m, top_y, size_y, comp_y = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(5))
        x, n, top, size, comp = (np.repeat(rows.column(c).to_numpy(), many) for c in ("g", "n", "top", "size", "comp"))
        # of equal components' sizes the larger code is looked at
        fit = ((size < size_y) | ((size == size_y) & (comp < comp_y))) & (m <= top) & (n <= top_y)
        x, y = x[fit], y[fit]
        order = np.lexsort((y, x))
        at = order[runs(x[order], y[order])]
        return pa.table([pa.array(x[at]), pa.array(y[at])], names=["g", "g2"])

    found = stored(met.groupBy("deal").applyInArrow(pair, "g long, g2 long"), "group-pairs")
    # a token common to both lies in both prefixes, or behind the prefix that ends first
    names = one.dropDuplicates(["group"]).select(F.xxhash64("group").alias("g"), "group", "n", "prefix")
    names2 = names.select(F.col("g").alias("g2"), F.col("group").alias("group2"), F.col("n").alias("m"), F.col("prefix").alias("prefix2"))
    need = F.floor((percent * (F.col("n") + F.col("m")) + 99 + percent) / F.lit(100 + percent))
    behind = F.floor((percent * F.greatest("n", "m") + 99) / 100) - 1
    common = F.size(F.array_intersect("prefix", "prefix2"))
    return found.join(names, "g").join(names2, "g2").filter(common >= need - behind).select("group", "group2")


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (least id reachable by links).

    Words are lower-cased in A-Z only. Texts of fewer words than a shingle have
    their whole word sequence as one; null texts and texts without words have
    none, link with nothing and are their own component. Equal texts are linked.
    Null ids are never the least id unless alone. An empty table gives no rows;
    other columns are ignored.
    """
    made = shingle_classes(docs, shingle, percent, id_col, text_col)
    one = stored(prefixes(made), "prefixes")
    sets = made.filter("tokens is not null").select("digest", "n", "tokens").dropDuplicates(["digest"])
    member = one.select("digest", "group")
    heads = one.groupBy("group").agg(F.min("digest").alias("head"))
    post = stored(in_range(postings(one, percent)), "postings")

    # every group against the leader it shares most prefix tokens with, every class against its group's head.
    # A token's leader is the set with the least of its own: of a family of copies, the one nearest to all others
    lead = post.groupBy("token").agg(F.min(F.struct("lone", "group", "n", "top")).alias("lead"))
    near = (F.col("n") <= F.col("lead.top")) & (F.col("lead.n") <= F.col("top"))
    star = (
        post.join(lead, "token").filter((F.col("group") != F.col("lead.group")) & near)
        .groupBy("group", F.col("lead.group").alias("leader")).count()
        .groupBy("group").agg(F.max_by("leader", F.struct("count", "leader")).alias("leader"))
    )
    by_head = heads.select(F.col("group").alias("leader"), F.col("head").alias("a"))
    tries = star.join(by_head, "leader").join(heads, "group").select("a", F.col("head").alias("b"))
    tries = tries.union(member.join(heads, "group").filter("digest <> head").select(F.col("head").alias("a"), F.col("digest").alias("b")))
    found = verified(stored(tries, "tries"), sets, percent)
    comp = components(found)

    # what is left: pairs of groups in different components, and groups that are not one component
    placed = stored(member.join(comp, member.digest == comp.node, "left").select("digest", "group", F.coalesce("comp", "digest").alias("comp")), "placed")
    span = placed.groupBy("group").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    pairs = _across(post, span, one, percent)
    inner = span.filter("low <> high").select("group", F.col("group").alias("group2"))
    a = placed.select("group", F.col("digest").alias("a"), F.col("comp").alias("comp_a"))
    b = placed.select(F.col("group").alias("group2"), F.col("digest").alias("b"), F.col("comp").alias("comp_b"))
    full = pairs.union(inner).join(a, "group").join(b, "group2").filter("comp_a <> comp_b and (group <> group2 or a < b)").select("a", "b")
    found = found.union(verified(stored(full, "pairs"), sets, percent))
    comp = components(found)

    known = made.select("doc_id", "n", "digest")
    own = known.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"))
    own = own.join(comp, own.digest == comp.node, "left").select("digest", "first", F.coalesce("comp", "digest").alias("comp"))
    ids = own.join(own.groupBy("comp").agg(F.min("first").alias("component_id")), "comp").select("digest", "component_id")
    return known.join(ids, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the least of their component, with their columns.

    Rows without an id can't be told apart by it: each stays that is a component
    of its own or has no id that is less, and none stands for others.
    """
    (key,) = fresh(docs, "__kept_id")
    found = jaccard_components(docs, id_col=id_col, text_col=text_col)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(kept, docs[id_col].cast("long").eqNullSafe(kept[key]), "left_semi")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
h AS (SELECT doc_id, s, len(s) AS n, CASE WHEN len(s) = 0 THEN NULL ELSE sha256(array_to_string(list_sort(s), chr(10))) END AS h FROM s),
c AS (SELECT h, any_value(s) AS s, any_value(n) AS n, min(doc_id) AS low FROM h WHERE h IS NOT NULL GROUP BY h),
p AS (SELECT h, n, unnest(s) AS g FROM c),
x AS (SELECT a.h AS a, b.h AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM p a JOIN p b ON a.g = b.g AND a.h < b.h GROUP BY a.h, b.h),
e AS (SELECT a, b FROM x WHERE 100 * k >= 75 * (na + nb - k)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT h AS a, h AS b FROM c UNION SELECT r.a, both_ways.b FROM r JOIN both_ways ON r.b = both_ways.a),
k AS (SELECT r.a AS h, min(c.low) AS low FROM r JOIN c ON c.h = r.b GROUP BY r.a)
SELECT doc_id, n AS n_shingles, coalesce(k.low, doc_id) AS component_id FROM h LEFT JOIN k USING (h)
"""
