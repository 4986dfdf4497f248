"""What each of five filters removes, in every order of the filters, by decision diagrams.

Documents become failure masks, and masks are counted per part in Spark. A
part's counts then form a diagram: one level a filter, each node with a child
for documents that pass and one for those that fail, each leaf a count, equal
subdiagrams shared, and every node weighted by the counts below it. All orders
follow from one another by swaps of two adjacent levels. Along an order's
all-pass path a node's failing child weighs what that step removes, and its
passing child what stays.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairframe.llm.common import stored

FILTERS = "ABCDE"
SYMBOL = re.compile(rb"[#$%&*|]")
CAPITALS = bytes(range(65, 91))
COUNTS = ("n", "good", "toxic")
#: Bytes that continue a code point.
FOLLOWING = bytes(range(0x80, 0xC0))

Weight = tuple[int, ...]


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text in UTF-8 fails. split() parts words at space and 0x09 to 0x0D only."""
    words = text.split()
    n = len(words)
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.translate(None, FOLLOWING))
    return (n < 200) | (100 * len(set(words)) < 50 * n) << 1 | (100 * capitals > 2 * points) << 2 | (SYMBOL.search(text) is not None) << 3


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, mask of every row of docs; bit 4 (E): a row with a smaller id has the same text.

    Texts are compared by SHA-256. Of the texts only their digests are shuffled;
    a text's rows are combined before the shuffle, and the join that hands the
    least id back to repeated texts splits hot ones.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = [pa.array(map(failures, texts), pa.int32()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), *found], names=["doc_id", "part", "mask", "digest"])

    empty = F.lit("")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), empty).alias("part"), F.coalesce(F.col(f"`{text_col}`").cast("string"), empty).alias("text"))
    rows = stored(rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, part string, mask int, digest binary"), "masks")
    repeated = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).filter("copies > 1 AND least IS NOT NULL")
    found = rows.join(stored(repeated, "repeated"), "digest", "left")
    later = F.col("least").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("least")))
    return found.select("doc_id", "part", (F.col("mask") + F.when(later, 16).otherwise(0)).cast("int").alias("mask"))


def mask_counts(found: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """part, mask, n, good, toxic: documents, those labelled quality 1 and those labelled toxic 1.

    Of several labels of one id any one counts; a null id has none.
    """
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    known = labels.filter(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("doc_id")).agg(flag("quality"), flag("toxic"))
    rows = found.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n")).join(known, "doc_id", "left")
    of = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("quality")("good"), of("toxic")("toxic"))


class Diagram:
    """A weighted decision diagram of one part; every path has a node of each level."""

    def __init__(self, counts: dict[int, Weight], filters: str = FILTERS):
        self.order = list(filters)
        self.weight: list[Weight] = []
        #: (passing child, failing child) by node; leaves have none
        self.children: dict[int, tuple[int, int]] = {}
        #: by level the nodes by their children; the last one holds the leaves by their counts
        self.levels: list[dict] = [{} for _ in range(len(filters) + 1)]
        self.nothing = (0,) * len(next(iter(counts.values())))
        self.root = self._build(counts, 0, 0)

    def _build(self, counts: dict[int, Weight], level: int, mask: int) -> int:
        if level == len(self.order):
            return self._leaf(counts.get(mask, self.nothing))
        return self._node(level, self._build(counts, level + 1, mask), self._build(counts, level + 1, mask | 1 << level))

    def _leaf(self, counts: Weight) -> int:
        if counts not in self.levels[-1]:
            self.levels[-1][counts] = len(self.weight)
            self.weight.append(counts)
        return self.levels[-1][counts]

    def _node(self, level: int, passing: int, failing: int) -> int:
        key = (passing, failing)
        if key not in self.levels[level]:
            self.levels[level][key] = node = len(self.weight)
            self.children[node] = key
            self.weight.append(tuple(a + b for a, b in zip(self.weight[passing], self.weight[failing], strict=True)))
        return self.levels[level][key]

    def swap(self, level: int) -> None:
        """Exchange the filters of this level and the next.

        A node of the upper level stands for the same counts as before, so it
        keeps its number and its parents; only its children are made anew.
        """
        upper, self.levels[level + 1] = self.levels[level], {}
        self.levels[level] = {}
        for (passing, failing), node in upper.items():
            (pp, pf), (fp, ff) = self.children[passing], self.children[failing]
            key = (self._node(level + 1, pp, fp), self._node(level + 1, pf, ff))
            self.children[node] = key
            self.levels[level][key] = node
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[str, Weight, Weight]]:
        """(filter, counts kept, counts removed) along the all-pass path."""
        node = self.root
        for name in self.order:
            passing, failing = self.children[node]
            yield name, self.weight[passing], self.weight[failing]
            node = passing


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels to swap so that all orders of n appear, each once: the last item sweeps through every order of the others."""
    if n < 2:
        return
    inner, down = adjacent_swaps(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        # the sweeping item rests at the front after a sweep down
        yield step + down
        down = not down


def audit(counts: dict[int, Weight], filters: str = FILTERS) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders and steps."""
    diagram = Diagram(counts, filters)
    found = [("".join(diagram.order), list(diagram.steps()))]
    for level in adjacent_swaps(len(filters)):
        diagram.swap(level)
        found.append(("".join(diagram.order), list(diagram.steps())))
    fails, alone, total = {}, {}, dict.fromkeys(filters, 0)
    for order, steps in found:
        fails[order[0]] = steps[0][2][0]  # nothing went before it
        alone[order[-1]] = steps[-1][2][0]  # all others were passed
        for name, _, removed in steps:
            total[name] += removed[0]
    return [
        (order, k, kept[0], removed[0], fails[name] - removed[0], alone[name], removed[1], removed[2], total[name])
        for order, steps in found
        for k, (name, kept, removed) in enumerate(steps, 1)
    ]


OUT = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows a part.

    Null texts count as empty and null parts as the empty string. A null id is
    larger than any other; rows repeated with the same id and text are not
    copies of one another, for neither id is smaller. An empty table gives no
    rows; other columns are ignored. What a task holds of a part is its counts
    by mask, 32 rows at most.
    """
    counts = mask_counts(masks(docs, id_col, text_col, part_col), labels, id_col)
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("counts"))

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                steps = list(zip(*audit({r["mask"]: tuple(r[c] for c in COUNTS) for r in rows}), strict=True))
                kinds = [pa.string(), pa.int32(), *[pa.int64()] * len(OUT)]
                columns = [pa.array([part] * len(steps[0])), *[pa.array(c, k) for c, k in zip(steps, kinds, strict=True)]]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *OUT])

    return parts.mapInArrow(walk, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in OUT))


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT doc_id, part,
        (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS mask FROM w),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM m LEFT JOIN labels USING (doc_id) GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step::INT AS step, 1 << (ascii(filter_order[step]) - 65) AS bit,
        list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))) AS earlier FROM o, range(1, 6) AS t(step)),
r AS (SELECT part, filter_order, step, bit,
        coalesce(sum(n) FILTER ((mask & (bit | earlier::INT)) = 0), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER ((mask & bit) > 0 AND (mask & earlier::INT) = 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER ((mask & bit) > 0 AND (mask & earlier::INT) > 0), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER ((mask & bit) > 0 AND (mask & earlier::INT) = 0), 0)::BIGINT AS good_lost,
        coalesce(sum(c.toxic) FILTER ((mask & bit) > 0 AND (mask & earlier::INT) = 0), 0)::BIGINT AS toxic_lost
    FROM c, (SELECT filter_order, step, bit, coalesce(earlier, 0) AS earlier FROM s) GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
