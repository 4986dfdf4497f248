"""Operators that look across the corpus, against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from pairframe.llm import components, jaccard_join, katz, packing, substring_dedup

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FILE = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    base = [f"w{i}" for i in range(80)]
    rows = [(9000, None, "s"), (9001, "", None), (9002, " \n", "s"), (9003, "one two", "s"), (9004, "One  TWO", "s"), (9005, "a  b \n c\n\nd <|endoftext|> z  ", "s"), (9006, "ab" * 4000, "big")]
    # near copies: some far from their base, some near; a chain that links only step by step
    rows += [(9100 + k, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :]), "s") for k in range(0, 60, 4)]
    rows += [(9200 + k, " ".join(base[2 * k :] + [f"y{j}" for j in range(2 * k)]), "s") for k in range(12)]
    rows += [(9300 + k, " ".join([f"z{k}_{j}" for j in range(20)] + base[:20]), "s") for k in range(20)]
    rows += [(9400, "same words twice here and now " * 5, "s"), (9400, "same words twice here and now " * 5, "s")]
    extra = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return table.unionByName(extra).withColumn("n", F.lit(1)).withColumn("src", F.lit("clash")).repartition(5).persist()


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 201), (200, 201)]
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({got[i] for i in range(41)}) == 1 and len({got[i] for i in (100, 101, 102)}) == 1 and len(set(got.values())) == 3
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("percent", [75, 50])
def test_jaccard_components(docs, percent):
    sets = {}
    for i, t in texts(docs):
        w = WORD.findall(t.translate(UPPER))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        shared = Counter(j for x in s for j in holders[x])
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                up[b] = a
        for x in s:
            holders[x].append(i)
    got = {r.doc_id: r for r in jaccard_join.jaccard_components(docs, percent=percent).collect()}
    assert set(got) == set(sets)
    for i in sets:
        assert (got[i].n_shingles, got[i].component_id) == (len(sets[i]), find(i)), i


def test_jaccard_edges(docs):
    left = jaccard_join.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert {9000, 9001, 9002, 9003} <= {r.doc_id for r in left.collect()} and left.filter("doc_id = 9004").count() == 0
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("shared_by", [1, 2])
def test_jaccard_of_a_template_family_is_linear(spark, shared_by):
    """Pages of one template share 82 of 100 shingles, similarity 0.69: no pair may be made of them."""
    kept = []
    for size in (1000, 4000):
        # the template comes last, so that 82 shingles are shared; the rest is a page's own or one of two pages'
        rows = [(i, " ".join([f"p{i // shared_by}_{k}" for k in range(18)] + [f"t{k}" for k in range(86)])) for i in range(size)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        one = jaccard_join.prefixes(jaccard_join.shingle_classes(df, 5, 75, "doc_id", "text")).persist()
        posted = jaccard_join.postings(one, 75)
        assert posted.groupBy("token").count().filter(f"count >= {size // shared_by}").count() > 0
        kept.append(jaccard_join.in_range(posted).count())
        got = jaccard_join.jaccard_components(df)
        assert got.groupBy("component_id").count().filter(f"count <> {shared_by}").count() == 0
    assert kept[1] <= 5 * kept[0] and kept[1] <= 4000 * 20


@pytest.mark.parametrize("first", [3, 4, 7, 13])
def test_repeated_passages(docs, first):
    words = [(i, WORD.findall(t)) for i, t in texts(docs)]
    begin = {}
    for i, w in words:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            begin[key] = min(begin.get(key, i), i)
    got = defaultdict(list)
    for r in substring_dedup.repeated_passages(docs, first=first).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(words)
    for i, w in words:
        gone = {j for k in range(len(w) - 12) if begin[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        for r in got[i]:
            assert (r.n_words, r.n_removed, bytes(r.kept).decode()) == (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))


def test_doubling_levels():
    assert substring_dedup.levels(4, 13) == [4, 8, 13] and substring_dedup.levels(7, 13) == [7, 13] and substring_dedup.levels(3, 13) == [3, 6, 12, 13] and substring_dedup.levels(20, 13) == [13]


def test_katz(docs):
    tokens = [(i, [*WORD.findall(t.translate(UPPER)), 0]) for i, t in texts(docs)]
    count, after = Counter(), defaultdict(Counter)
    for i, w in tokens:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(w)
            for a, b in zip([0, *w], w, strict=False):
                after[a][b] += 1
    total = sum(count.values())
    of = lambda values: [0] + [Counter(values)[r] for r in range(1, katz.K + 2)]
    d1, d2 = katz.discounts(of(count.values())), katz.discounts(of([c for x in after.values() for c in x.values()]))
    cut = lambda d, c: (d[c] if c <= katz.K else 1) * c
    uni = {w: cut(d1, c) / total for w, c in count.items()}
    unknown = 1 - sum(uni.values())
    back = {}
    for h, x in after.items():
        seen = sum(cut(d2, c) for c in x.values()) / count[h]
        scale = count[h] / (count[h] + 1) if seen > 1 - 1e-12 else 1.0
        back[h] = scale, (1 - scale * seen) / (1 - sum(uni[w] for w in x))

    def p(h, w):
        if w in after.get(h, ()):
            return back[h][0] * cut(d2, after[h][w]) / count[h]
        return (back[h][1] if h in back else 1.0) * uni.get(w, unknown)

    for h in list(after)[:50]:
        assert abs(sum(p(h, w) for w in count) + back[h][1] * unknown - 1) < 1e-9
    got = defaultdict(list)
    for r in katz.katz_scores(docs).collect():
        got[r.doc_id].append(r)
    base_sum = score_sum = 0.0
    for i, w in tokens:
        base = sum(math.log10((count[x] + 1) / (total + len(count) + 1)) for x in w)
        score = sum(math.log10(p(a, b)) for a, b in zip([0, *w], w, strict=False))
        for r in got[i]:
            assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(count[x] > 0 for x in w), total, zlib.crc32(str(i).encode()) % 7 == 2)
            assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9, abs_tol=1e-9)
            base_sum, score_sum = base_sum + base * r.held_out, score_sum + score * r.held_out
    assert score_sum > base_sum


def test_katz_discounts_stay_good_turing():
    # n[r] = 3600 / r^2: r* / r = r / (r + 1), so d[r] = (r / (r + 1) - 1 / 6) / (5 / 6)
    exact = [0, 3600, 900, 400, 225, 144, 100]
    assert np.allclose(katz.discounts(exact)[1:], [2 / 5, 3 / 5, 7 / 10, 19 / 25, 4 / 5], atol=1e-12)
    # counts of counts of words and bigrams in the given tables, whose raw factors d[4] lie above 1
    for n, slope in (
        ([0, 49663, 12919, 5197, 2729, 2383, 1067], -2.014), ([0, 193655, 25105, 6496, 2179, 2497, 618], -2.987),
        ([0, 207344, 59772, 25017, 14274, 13493, 7080], -1.839), ([0, 1579638, 246704, 51653, 21705, 18939, 7580], -2.873),
    ):
        # slopes are those of numpy.polyfit with weights sqrt(n); smoothed counts then go into the textbook formula
        smooth = [1e9 * r**slope for r in range(1, 7)]
        tail = 6 * smooth[5] / smooth[0]
        want = [((r + 1) * smooth[r] / (r * smooth[r - 1]) - tail) / (1 - tail) for r in range(1, 6)]
        got = katz.discounts(n)[1:]
        assert np.allclose(got, want, atol=5e-4) and (np.diff(got) > 0).all()
    for n in ([0] * 7, [0, 0, 0, 7, 0, 0, 0], [0, 1, 1, 1, 1, 1, 1], [0, 60, 30, 20, 15, 12, 10], [0, 1, 2, 4, 8, 16, 32], [0, 9, 0, 0, 0, 0, 1]):
        d = katz.discounts(n)[1:]
        assert ((d > 0) & (d < 1)).all() and (np.diff(d) > 0).all(), n


def test_katz_edges(spark, docs):
    assert katz.katz_scores(docs.limit(0)).count() == 0
    # nothing to learn from: crc32("2") % 7 is looked up rather than assumed
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = katz.katz_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r.train_tokens, r.n_known, r.n_tokens, r.base_score, r.score) == (0, 0, 3, 0.0, 0.0)


def pieces_of(df, **more):
    return packing.pack(df, FILE, P.PATTERN, 1, **more).collect()


def test_packing_is_lossless_and_full(docs):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(FILE)
    want = Counter()
    for i, t in texts(docs):
        want[i, np.array([*made.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()] += 1
    rows = pieces_of(docs)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert len(r.ids) == 4 * r.length
    for (i, ids), n in want.items():
        assert sum(r.length for r in by_doc[i]) == n * (len(ids) // 4) or len([k for k in want if k[0] == i]) > 1
        if n == 1:
            at = sorted(by_doc[i], key=lambda r: r.start)
            assert b"".join(bytes(r.ids) for r in at) == ids and [r.start for r in at] == list(np.cumsum([0] + [r.length for r in at])[:-1])
    sizes = []
    for s in range(len(by_seq)):
        at = 0
        for r in sorted(by_seq[s], key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        sizes.append(at)
    assert all(x == 2048 or x & (x - 1) == 0 for x in sizes) and all(x == 2048 for x in sizes[:-11])


def test_packing_keeps_the_mixture(docs):
    rows = sorted(pieces_of(docs, quantum=4096), key=lambda r: (r.sequence_id, r.offset))
    total, share = sum(r.length for r in rows), Counter()
    for r in rows:
        share[r.source] += r.length
    sent, so_far = Counter(), 0
    for r in rows:
        sent[r.source] += r.length
        so_far += r.length
        for s in share:
            # deficits carry: never further from the target than a round's credit and a token of each source
            assert abs(sent[s] - so_far * share[s] / total) <= 4096 * share[s] / total + len(share) + 1
    assert packing.pack(docs.limit(0), FILE, P.PATTERN, 1).count() == 0


def test_packing_fills_each_window_to_the_mixture(spark):
    shares = {"hot": 35, "a": 20, "b": 15, "c": 10, "d": 10, "e": 5, "f": 5}
    rows = [(k, " ".join(f"word{(k * 7 + j) % 50}" for j in range(30 + k % 700)), s) for k, s in enumerate(s for i in range(8) for s, n in shares.items() for _ in range(n))]
    by_seq = defaultdict(Counter)
    for r in pieces_of(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)):
        by_seq[r.sequence_id][r.source] += r.length
    total = sum((c for c in by_seq.values()), Counter())
    share = {s: n / sum(total.values()) for s, n in total.items()}
    full = [c for c in by_seq.values() if sum(c.values()) == 2048]
    assert len(full) > 100
    distances = sorted(sum(abs(c[s] / 2048 - share[s]) for s in share) / 2 for c in full)
    assert all(c["hot"] > 0 for c in full)
    # a window is one round but for a token of each source
    assert distances[-1] <= 7 * 2 / 2048


def test_packing_weights_lead(spark, docs):
    weights = spark.createDataFrame([("big", 1e9)], "source string, weight double")
    rows = pieces_of(docs, weights=weights)
    big = max(r.sequence_id for r in rows if r.source == "big")
    assert big <= sum(r.length for r in rows if r.source == "big") // 2048 + 1 < max(r.sequence_id for r in rows) / 4


def test_pipeline(spark, sf):
    import corpus_pipeline as pipe

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in pipe.STAGES] == ["quality rules", "exact dedup", "n-gram Jaccard join", "secret scans", "packing"]
    table, left = docs, []
    for k, (_, stage) in enumerate(pipe.STAGES[:-1]):
        table = stage(spark, table, sf)
        assert table.dtypes == docs.dtypes, k
        table = table.persist()
        left.append({r.doc_id: r.text for r in table.collect()})
    assert len(left[0]) < docs.count() and set(left[1]) <= set(left[0]) and set(left[2]) <= set(left[1]) and set(left[3]) == set(left[2])
    lower = [t.translate(UPPER) for t in left[1].values()]
    assert len(lower) == len(set(lower)) == len({t.translate(UPPER) for t in left[0].values()})
    assert any(left[3][i] != left[2][i] for i in left[2]) == any("[SECRET]" in t for t in left[3].values())
    packed = pipe.packed(spark, table, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(left[3])
    tokens = lambda df: df.agg(F.sum("length")).first()[0]
    assert tokens(pipe.run(spark, sf)) == tokens(packed)
