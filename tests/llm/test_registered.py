"""The registered queries, as registered and over whole tables, against plain Python or SQL."""

import hashlib
import re
import zlib
from collections import Counter
from math import log2

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from pairframe.llm import queries, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    """The given tables with nulls, empty and long texts, repeated rows and clashing columns added to documents."""
    home = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id % 4 = 0")
    key = "aZ3xQ9/kLm2Pv7Rt0BwYc5Nd8Hj4Gs6Fu1"
    long = " ".join(f"word{k % 700} token=abcdef{k:05d}" if k % 9 == 0 else f"word{k % 700}" for k in range(9000))
    extra = [(70001, None), (70002, ""), (70003, " \n\t"), (70004, long), (70005, "x" * 9000 + key * 200), (70006, f"example_key={key} examples/{key}"), (70007, docs.first().text), (70007, docs.first().text), (None, "a null id")]
    rows = spark.createDataFrame([(i, t, "en", "hot", 0) for i, t in extra], "doc_id long, text string, lang string, source string, n_chars long")
    clash = ["n_words", "kept", "secret_spans", "n_tokens", "score", "src", "__text", "__w", "part", "row"]
    docs.unionByName(rows).withColumns({c: F.lit("clash") for c in clash}).repartition(5).write.parquet(f"{home}/documents.parquet")
    for name in ("labels", "conversations", "embeddings"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{home}/{name}.parquet")
    return str(home)


@pytest.fixture(scope="module")
def bare(spark, sf, tmp_path_factory):
    """Empty tables."""
    home = tmp_path_factory.mktemp("bare")
    for name in ("documents", "labels", "conversations", "embeddings"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{home}/{name}.parquet")
    return str(home)


def texts(spark, sf):
    return Counter((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())


def answers(spark, name, sf, *columns):
    return Counter(tuple(r) for r in queries.QUERIES[name](spark, sf).select("doc_id", *columns).collect())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, bare, name):
    assert queries.QUERIES[name](spark, bare).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, sf), con.sql(queries.ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert Counter(tuple(r) for r in got.select(order).collect()) == Counter(want.select(*order).fetchall())


def entropy_spans(text):
    def peak(run):
        n = Counter(run[:20])
        best = now = -sum(c / 20 * log2(c / 20) for c in n.values())
        for k in range(20, len(run)):
            n[run[k - 20]] -= 1
            n[run[k]] += 1
            now = -sum(c / 20 * log2(c / 20) for c in n.values() if c)
            best = max(best, now)
        return best

    for run in re.finditer(r"[A-Za-z0-9+/_-]{20,}={0,2}", text):
        parts = [(run.start(), run[0])]
        if re.search(secrets.PLACEHOLDER, run[0]):
            parts = [(run.start() + m.start(), m[0]) for m in re.finditer("[^/]{20,}", run[0]) if not re.search(secrets.PLACEHOLDER, m[0])]
        for at, part in parts:
            kind = next(k for k, p in secrets.CLASSES.items() if re.search(p, part))
            if re.search("[0-9]", part) and not re.search(secrets.SHAPES, part) and peak(part) >= secrets.BITS[kind]:
                yield at, kind, at + len(part)


def base_spans(text):
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def test_op5_secret_scans(spark, odd):
    want = Counter()
    shown = lambda spans: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    for (i, t), n in texts(spark, odd).items():
        base = sorted(base_spans(t))
        every = sorted(base + [(a, secrets.KINDS.index(k), b) for a, k, b in entropy_spans(t)])
        count = Counter(k for _, k, _ in base)
        want[i, count[0], count[1], count[2], sha(shown(base)), shown(every)] += n
    assert answers(spark, "op5_secret_scans", odd, "n_assign", "n_access", "n_hex", "base_sha256", "spans") == want
    table = spark.read.parquet(f"{odd}/documents.parquet")
    found = secrets.find_secrets(table)
    assert found.columns[:-1] == table.columns and found.filter("secret_spans <> 'clash'").count() == 0
    spans = {r.doc_id: r[-1] for r in found.select("doc_id", found.columns[-1]).collect()}
    # the allow-listed word clears its own part and no other
    assert [(s.start, s.end) for s in spans[70006] if s.kind > 2] == [(12, 46), (63, 90)]


def test_entropy_scan_is_linear(spark):
    import random
    import time

    rnd = random.Random(3)
    seconds = []
    for size in (250_000, 1_000_000):
        run = "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWabcdefghijklmnopqrstuvw0123456789") for _ in range(size))
        df = spark.createDataFrame([(1, run)], "doc_id int, text string")
        for _ in range(2):
            began = time.perf_counter()
            (r,) = secrets.find_secrets(df).collect()
        seconds.append(time.perf_counter() - began)
        assert [(s.start, s.end) for s in r.secret_spans] == [(0, size)]
    assert seconds[1] < 60 and seconds[1] < 8 * max(seconds[0], 0.5)


def test_op3_byte_bpe(spark, odd):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for (i, t), n in texts(spark, odd).items():
        ids = enc.encode_ordinary(t)
        want[i, len(ids), sha(",".join(map(str, ids))), sha(t)] += n
    assert max(len(t) for _, t in texts(spark, odd)) > 1 << 16
    assert answers(spark, "op3_byte_bpe", odd, "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_op1_mixture_packing(spark, odd):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = Counter()
    for (i, t), n in texts(spark, odd).items():
        ids[i, np.array([*made.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()] += n
    known = {i: data for i, data in ids}
    rows = queries.op1_mixture_packing(spark, odd).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()
    covered, windows = Counter(), {}
    for r in rows:
        data = known[r.doc_id]
        assert (r.ids_crc32, r.doc_tokens) == (zlib.crc32(data[4 * r.start : 4 * (r.start + r.length)]), len(data) // 4)
        covered.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert covered == Counter({(i, k): n for (i, data), n in ids.items() for k in range(len(data) // 4)})
    sizes = {w: sum(n for _, n in parts) for w, parts in windows.items()}
    assert all(sorted(parts)[k][0] == sum(n for _, n in sorted(parts)[:k]) for parts in windows.values() for k in range(len(parts)))
    assert sorted(windows) == list(range(len(windows))) and sum(n != 2048 for n in sizes.values()) <= 11 and all(n & (n - 1) == 0 for n in sizes.values())


@pytest.mark.parametrize("weights", [{"a": 5.0, "b": 1.0, "c": 2.0}, {"a": 512.0, "b": 0.125, "c": 383.875}])
def test_packing_is_deficit_round_robin(spark, weights):
    """The packed stream against a round robin that is walked round by round, with default settings; one source may earn less than a token a round."""
    from collections import deque
    from fractions import Fraction

    from pairframe.llm import packing

    rows = [(k, " ".join(f"word{(k * 7 + j) % 50}" for j in range(k * 37 % 400)), "abc"[k % 3]) for k in range(120)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    got = packing.pack(table, P.path("byte_bpe_50k.json"), P.PATTERN, 1, weights=spark.createDataFrame(list(weights.items()), "source string, weight double")).collect()
    stream = [(r.doc_id, r.start + k) for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)) for k in range(r.length)]
    enc = packing.encoder(P.path("byte_bpe_50k.json"), P.PATTERN)
    queue = {s: deque((i, k) for i, t, source in rows if source == s for k in range(len(enc.encode_ordinary(t)) + 1)) for s in weights}
    deficit, want = dict.fromkeys(weights, Fraction(0)), []
    while any(queue.values()):
        for s in sorted(weights):
            deficit[s] += Fraction(int(weights[s] * 1024), int(sum(weights.values()) * 1024)) * 2048
            while queue[s] and deficit[s] >= 1:
                want.append(queue[s].popleft())
                deficit[s] -= 1
    assert stream == want
    # as long as all queues last, every window has each source's share but for a token of each source at either end
    source = {i: s for i, _, s in rows}
    for w in range(3):
        mix = Counter(source[i] for i, _ in stream[2048 * w : 2048 * (w + 1)])
        assert all(abs(mix[s] - 2048 * weights[s] / sum(weights.values())) <= 4 for s in weights)


def test_op4_quality_classifier(spark, odd, monkeypatch):
    """Scores against the fitted rules, evaluated one by one in Python."""
    import math

    from pairframe.llm import quality_model
    from pairframe.llm.stats import text_stats

    fitted, fit = [], quality_model.fit_rules
    monkeypatch.setattr(quality_model, "fit_rules", lambda sample: fitted.append(fit(sample)) or fitted[-1])
    got = queries.op4_quality_classifier(spark, odd)
    ((intercept, weights),) = fitted
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 3 == 1
    want = Counter()
    for r in text_stats(spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "text"), "text", ["doc_id"]).collect():
        margin = intercept + sum(w for rule, w in weights if all(r[f] > cut if above else r[f] <= cut for f, above, cut in rule))
        p = 1 / (1 + math.exp(-margin))
        want[r.doc_id, held(r.doc_id), round(p, 9), int(p >= 0.5)] += 1
    assert weights and Counter((r.doc_id, r.held_out, round(r.score, 9), r.predicted) for r in got.collect()) == want


def test_op6_quality_rules(spark, odd):
    want = Counter()
    for (i, t), n in texts(spark, odd).items():
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        seen, cover = Counter(zip(w, w[1:], w[2:])), set()
        for k in range(len(w) - 2):
            if seen[tuple(w[k : k + 3])] > 1:
                cover |= {k, k + 1, k + 2}
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover), failed] += n
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert answers(spark, "op6_quality_rules", odd, *columns) == want
    assert queries.op6_quality_rules(spark, odd).filter("kept and base_failed").count() == 0


def test_op9_chat_formatting(spark, sf):
    from pairframe.llm import chat

    turns = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, (r.role or "").strip().lower(), r.text or ""))
    got = {r.conv_id: r for r in queries.op9_chat_formatting(spark, sf).collect()}
    assert set(got) == set(turns)
    follows = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    for i, given in turns.items():
        # least cost by relaxing over (turns used, last role) until nothing changes
        roles = [r for _, r, _ in sorted(given)]
        best = {(0, None): 0}
        changed = True
        while changed:
            changed = False
            for (k, last), cost in list(best.items()):
                moves = [((k, e), cost + 2) for e in follows[last] if e != "system"]
                if k < len(roles):
                    for role in chat.ROLES:
                        label = 1 if roles[k] not in chat.ROLES else 0 if roles[k] == role else 3
                        moves += [((k + 1, role), cost + label + (1 if role == last else 0))] if role == last or role in follows[last] else []
                for state, c in moves:
                    if c < best.get(state, 10**9):
                        best[state], changed = c, True
        want = min(best.get((len(roles), end), 10**9) for end in ("assistant", None))
        r = got[i]
        made = r.roles.split(",") if r.roles else []
        assert r.cost == want and r.n_turns == len(given), i
        assert all(b in follows[a] for a, b in zip([None, *made], made)) and (not made or made[-1] == "assistant")
        assert all(t in r.rendered for _, _, t in given)


def test_op10_katz_scoring(spark, odd):
    from math import isclose, log10

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    tokens = [((i, t), n, [*WORD.findall(t.translate(lower)), ""]) for (i, t), n in texts(spark, odd).items()]
    count = Counter()
    for (i, _), n, w in tokens:
        if not held(i):
            count.update({x: n * k for x, k in Counter(w).items()})
    total = sum(count.values())
    got = {}
    for r in queries.op10_katz_scoring(spark, odd).collect():
        got.setdefault(r.doc_id, []).append(r)
    for (i, _), n, w in tokens:
        base = sum(log10((count[x] + 1) / (total + len(count) + 1)) for x in w)
        mine = [r for r in got[i] if isclose(r.base_score, base, rel_tol=1e-9)]
        assert len(mine) == n and all((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w), sum(count[x] > 0 for x in w), total) and r.score < 0 for r in mine), i


def test_pipeline_stages_on_odd_tables(spark, odd):
    """Each stage on nulls, repeats, long texts and clashing columns: what stays is right, columns and other rows are as they were."""
    import corpus_pipeline as pipe

    fold = lambda t: (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    rows = lambda df: Counter((r.doc_id, r.text, r.source, r.score) for r in df.select("doc_id", "text", "source", "score").collect())
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    made = {name: stage(spark, docs, odd) for name, stage in pipe.STAGES}
    whole = rows(docs)
    for name in list(made)[:-1]:
        assert made[name].dtypes == docs.dtypes, name
    good, unlike, near = (rows(made[n]) for n in ("quality rules", "exact dedup", "n-gram Jaccard join"))
    assert not good - whole and all(len(WORD.findall(t or "")) >= 50 for _, t, _, _ in good)
    # one row of equal texts, the one with the largest id
    top = {}
    for i, t, _, _ in whole:
        top[fold(t)] = max(top.get(fold(t), -1), -1 if i is None else i)
    assert not unlike - whole and {fold(t): -1 if i is None else i for i, t, _, _ in unlike} == top and sum(unlike.values()) == len(top)
    # the least id of every component, and no other
    least = {r.component_id for r in queries.op7_jaccard_join(spark, odd).collect()}
    assert not near - whole and {i for i, *_ in near} == least
    # every row stays, secrets are gone, and only rows with secrets differ
    masked = rows(made["secret scans"])
    bad = {r.doc_id for r in queries.op5_secret_scans(spark, odd).filter("spans <> ''").collect()}
    assert sum(masked.values()) == sum(whole.values()) and {i for i, *_ in (masked - whole)} <= bad
    assert all(not base_spans(t or "") or "[SECRET]" in t for _, t, _, _ in masked) and any("[SECRET]" in (t or "") for _, t, _, _ in masked)
    pieces = made["packing"].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id for r in pieces} == {i for i, *_ in whole}


def test_pipeline_of_empty_tables(spark, bare):
    import corpus_pipeline as pipe

    docs = spark.read.parquet(f"{bare}/documents.parquet")
    for name, stage in pipe.STAGES:
        assert stage(spark, docs, bare).count() == 0, name
    assert pipe.run(spark, bare).count() == 0
