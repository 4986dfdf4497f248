"""Vector codes, the filter audit and byte-exact dedup against brute force, with odd tables."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairframe.llm import filter_audit, queries, suffix_dedup, vector_codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lloyd(vectors, parts, entries, rounds, scale=256):
    """Every part compared with every entry in every round."""
    x = np.floor(scale * np.array(vectors, float)).astype(np.int64).astype(object).reshape(len(vectors), parts, -1)
    books = [[list(v[p]) for v in x[:entries]] for p in range(parts)]
    distance = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b, strict=True))
    assign = lambda: [[min((distance(v[p], c), e) for e, c in enumerate(books[p])) for p in range(parts)] for v in x]
    for _ in range(rounds):
        held = defaultdict(list)
        for v, found in zip(x, assign(), strict=True):
            for p, (_, e) in enumerate(found):
                held[p, e].append(v[p])
        for (p, e), own in held.items():
            books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return [([e for _, e in f], sum(d for d, _ in f)) for f in assign()], books


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, -0.25, 0.0, 0.25, 0.5, rng.uniform(-1, 1)]) for _ in range(8)], rng.choice([1, 1, 1, 2, None])) for i in range(400)]
    rows += [(400 + i, rows[7][1], 1) for i in range(60)] + [(7, rows[7][1], 1)]
    odd = [(900, None, 1), (901, [0.1] * 7 + [None], 2), (902, [float("nan")] + [0.0] * 7, 1), (903, [float("-inf")] + [0.0] * 7, None), (None, [0.3] * 8, None)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("clash") for c in ("vector", "code", "error")}).repartition(5)


@pytest.mark.parametrize(("entries", "rounds"), [(16, 2), (16, 0), (3, 5), (256, 1)])
def test_vector_codes(vectors, entries, rounds):
    rows = [r for r in vectors.collect() if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)]
    rows.sort(key=lambda r: (r.vec_id is None, r.vec_id or 0, r.embedding))
    want, books = lloyd([r.embedding for r in rows], 4, entries, rounds)
    codes, found = vector_codes.vector_codes(vectors, parts=4, entries=entries, rounds=rounds)
    assert found.tolist() == books
    label = Counter()
    for r, (_, error) in zip(rows, want, strict=True):
        label[r.label] += error
    got = Counter((r.vec_id, r.label, tuple(r.code), r.error, r.label_error) for r in vector_codes.with_label_error(codes).collect())
    assert got == Counter((r.vec_id, r.label, tuple(code), error, label[r.label]) for r, (code, error) in zip(rows, want, strict=True))


def test_active_entries_give_what_a_full_scan_gives():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, before = rng.integers(-4, 5, (200, 2)), rng.integers(-4, 5, (12, 2))
        moved = rng.random(12) < rng.choice([0.0, 0.2, 1.0])
        after = np.where(moved[:, None], rng.integers(-4, 5, (12, 2)), before)
        got = vector_codes.reassigned(x, *vector_codes.nearest(x, before), after, moved)
        want = vector_codes.nearest(x, after)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_vectors_that_are_errors(spark):
    make = lambda *rows: spark.createDataFrame([(i, v, 0) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.vector_codes(make([1.0, 2.0, 3.0]), parts=2)
    with pytest.raises(OverflowError):
        vector_codes.vector_codes(make([1e9, 2.0]), parts=2)
    with pytest.raises(Exception, match="components like the first"):
        vector_codes.vector_codes(make([1.0, 2.0], [1.0, 2.0, 3.0, 4.0]), parts=2, entries=1)


def test_op11_codebooks_sha256(spark, sf):
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    _, books = lloyd([v for _, v in rows], 16, 64, 2)
    want = hashlib.sha256(",".join(str(c) for part in books for entry in part for c in entry).encode()).hexdigest()
    assert {r.codebooks_sha256 for r in queries.op11_vector_codes(spark, sf).collect()} == {want}


def test_adjacent_swaps_reach_every_order_once():
    for n in range(1, 6):
        order, seen = list(range(n)), [tuple(range(n))]
        for k in filter_audit.adjacent_swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.append(tuple(order))
        assert sorted(seen) == sorted(permutations(range(n)))


def plain_audit(rows, filters="ABCDE"):
    """rows: (set of failed filters, good, toxic). All orders, applied one by one."""
    out, total = {}, Counter()
    for order in permutations(filters):
        left = list(rows)
        for k, f in enumerate(order, 1):
            gone = [r for r in left if f in r[0]]
            left = [r for r in left if f not in r[0]]
            total[f] += len(gone)
            out["".join(order), k] = (len(left), len(gone), sum(f in r[0] for r in rows) - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone))
    return {key: (*v, total[key[0][key[1] - 1]]) for key, v in out.items()}


@pytest.fixture(scope="module")
def audited(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    long = " ".join(f"w{k % 300}" for k in range(20000))
    extra = [(5001, None, None), (5002, "", ""), (5003, "", "s"), (5004, long, "s"), (5005, long, "t"), (5004, long, "s"), (None, long, None), (None, "only here", "s"), (5006, "A" * 300, "s"), (5007, "é" * 99 + "AB", "s"), (5008, "é" * 98 + "AB", "s"), (5009, "a|b", "s")]
    rows = docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumns({c: F.lit("clash") for c in ("mask", "part", "n", "digest", "least")})
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic")
    more = spark.createDataFrame([(5004, 1, 0), (5004, 0, 1), (5005, None, 1), (None, 1, 1), (5006, 1, None)], labels.schema)
    return rows.repartition(5), labels.unionByName(more)


def test_filter_audit(audited):
    docs, labels = audited
    rows = [(r.doc_id, r.text or "", r.source or "") for r in docs.collect()]
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.doc_id is not None}
    toxic = {r.doc_id for r in labels.collect() if r.toxic == 1 and r.doc_id is not None}
    order = lambda i: (i is None, i or 0)
    least = {}
    for i, t, _ in rows:
        least[t] = min(least.get(t, order(i)), order(i))
    parts = defaultdict(list)
    for i, t, source in rows:
        w = WORD.findall(t)
        checks = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": order(i) > least[t]}
        parts[source].append(({f for f, failed in checks.items() if failed}, i in good, i in toxic))
    want = {(part, *key): v for part, found in parts.items() for key, v in plain_audit(found).items()}
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in filter_audit.OUT) for r in filter_audit.filter_audit(docs, labels).collect()}
    assert len(got) == 600 * len(parts) and got == want


def test_swapped_diagrams_keep_their_counts():
    rng = random.Random(5)
    counts = {m: (rng.randrange(4), rng.randrange(2), 0) for m in range(32) if rng.random() < 0.7}
    diagram = filter_audit.Diagram(counts)
    total = diagram.weight[diagram.root]
    for level in filter_audit.adjacent_swaps(5):
        diagram.swap(level)
        fresh = filter_audit.Diagram({sum(1 << diagram.order.index(f) for k, f in enumerate("ABCDE") if m >> k & 1): c for m, c in counts.items()})
        assert diagram.weight[diagram.root] == total
        # as many nodes a level as the reduced diagram of that order
        assert [len(x) for x in diagram.levels[:-1]] == [len(x) for x in fresh.levels[:-1]]
        assert [s[1:] for s in diagram.steps()] == [s[1:] for s in fresh.steps()]


def brute(rows, length):
    seen = Counter(t[p : p + length] for _, t in rows for p in range(len(t) - length + 1))
    for i, t in rows:
        gone, last = bytearray(len(t)), -1
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                at = max(p, last)
                gone[at : p + length] = b"\1" * (p + length - at)
                last = p + length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        yield i, len(t), sum(gone), len(re.findall(b"\1+", gone)), kept


@pytest.fixture(scope="module")
def passages(spark, sf):
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    shared = [letters(n) for n in (199, 200, 201, 230, 1500)]
    rows = [(7000 + k, letters(rng.randrange(400)) + rng.choice(shared) + letters(rng.randrange(300)) + rng.choice(shared)) for k in range(80)]
    # overlapping parts of one passage, a changed byte here and there
    for k in range(60):
        at = rng.randrange(1300)
        part = list(shared[-1][at : at + rng.randrange(150, 420)])
        if k % 3:
            part[rng.randrange(len(part))] = "Z"
        rows.append((7200 + k, letters(rng.randrange(30)) + "".join(part) + letters(5)))
    rows += [(7300, None), (7301, ""), (7302, "a" * 199), (7303, "a" * 200), (7304, "b" * 200), (7305, "b" * 201), (7306, "xy" * 700), (7307, letters(3000)), (7307, letters(10)), (None, shared[3]), (7308, shared[3])]
    rows += [(7309, letters(260))] * 2
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").filter("doc_id % 3 = 0")
    clash = {c: F.lit("clash") for c in ("body", "th", "s", "m", "a", "bucket", "full", "n", "hits", "todo", "id_")}
    return docs.unionByName(spark.createDataFrame(rows, docs.schema)).withColumns(clash).repartition(6)


@pytest.mark.parametrize("length", [200, 160])
def test_repeated_bytes(passages, length):
    want = Counter(brute([(r.doc_id, (r.text or "").encode()) for r in passages.collect()], length))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.repeated_bytes(passages, length).collect())
    assert got == want


def test_repeated_bytes_within_blocks(spark, monkeypatch):
    """Texts longer than a block, and a run of equal bytes: blocks bear on no result, and such a run is one row."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 500)
    rng = random.Random(2)
    letters = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    passage = letters(1700)
    rows = [(1, letters(901) + passage + letters(77)), (2, passage[200:]), (3, letters(2000) + passage[:333]), (4, "q" * 3000 + letters(50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter(brute([(i, t.encode()) for i, t in rows], 200))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.repeated_bytes(docs).collect()) == want


def test_equal_bytes_send_few_cells():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "th": [5], "body": [b"q" * 1_000_000]})
    tracemalloc.start()
    out = list(suffix_dedup.first_cells(200)([batch]))
    assert sum(b.num_rows for b in out) <= 10 and tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()
