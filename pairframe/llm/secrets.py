"""Secret scans with built-in functions only.

Three fixed kinds come from patterns. The method adds spans for strings of high
entropy: every run of token characters is classed (hex, alphanumeric, base64),
a window slides over it, and the counts of the window's characters are carried
from step to step: one goes down, one goes up, and the window's Shannon entropy
follows from these two. Strings on the allow-list are never reported.

Work and memory are linear in a text's length: runs are scanned in pieces that
overlap by a window, and spans are laid out block by block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairframe.llm.common import fresh, let

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_base64")
CLASSES = {"entropy_hex": r"^[0-9a-fA-F]+$", "entropy_alnum": r"^[A-Za-z0-9]+$", "entropy_base64": r"."}
WINDOW = 20
#: Bits a window must reach, by class. 20 characters hold log2(20) = 4.32 bits at most.
BITS = {"entropy_hex": 3.2, "entropy_alnum": 3.75, "entropy_base64": 3.9}
#: Allow-list. Whole strings that are no secrets: numbers, UUIDs, rulers. Strings without a digit never count either.
SHAPES = r"^[0-9]+=*$|^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|^(.)\1+$"
#: Words that mark a placeholder; they clear the part between slashes that holds them, not its neighbours.
PLACEHOLDER = r"(?i)example|placeholder|changeme|xxxx"

MATCH = "array<struct<start:bigint,end:bigint,hit:string>>"
#: Matches laid out at a time: appending to a list copies it, so lists are kept this short.
BLOCK = 256
#: Characters of a run that are counted at a time.
PIECE = 4096
#: Counts are kept for the codes from "+" to "z", as bytes from ZERO up.
FIRST_CODE, CODES, ZERO = ord("+"), ord("z") - ord("+") + 1, 40
#: Sums of n log2 n are whole numbers of 2**-32 bits, so that no step drifts.
SCALE = 1 << 32


def _blocks(items: Column) -> Column:
    many = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))
    return F.transform(many, lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))


def _before(sizes: Column, step) -> Column:
    """What step makes of all sizes before each one, from 0; sizes are few, one a block."""
    seed = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(sizes, seed, lambda acc, n: F.struct(step(acc["at"], n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])


def _matches(text: Column, pattern: str, accept) -> Column:
    """Leftmost matches of pattern that accept takes: start, end, hit; offsets are code points."""
    none = F.array().cast(MATCH)

    def laid(hits: Column, begin: Column) -> Column:
        def step(acc: Column, h: Column) -> Column:
            start = acc["at"] + h["gap"]
            found = F.struct(start.alias("start"), (start + h["n"]).alias("end"), h["hit"].alias("hit"))
            return F.struct((start + h["n"]).alias("at"), F.when(h["ok"], F.array_append(acc["out"], found)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(hits, F.struct(begin.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def in_blocks(hits: Column) -> Column:
        lengths = lambda bs: F.transform(bs, lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda acc, h: acc + h["gap"] + h["n"]))
        return let(_blocks(hits), lambda bs: F.flatten(F.zip_with(bs, _before(lengths(bs), lambda at, n: at + n), laid)))

    def walk(parts: Column) -> Column:
        hits = F.zip_with(
            F.slice(parts["gaps"], 1, F.greatest(F.size(parts["hits"]), F.lit(0))),
            parts["hits"],
            lambda gap, hit: F.struct(F.length(gap).cast("long").alias("gap"), F.length(hit).cast("long").alias("n"), accept(hit).alias("ok"), hit.alias("hit")),
        )
        return let(hits, lambda h: F.when(F.size(h) <= BLOCK, laid(h, F.lit(0).cast("long"))).otherwise(in_blocks(h)))

    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.when(text.rlike(pattern), let(parts, walk)).otherwise(none)


def _spans(text: Column, pattern: str, kind: int, accept) -> Column:
    return F.transform(_matches(text, pattern, accept), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def _lowest_sum(piece: Column, window: int) -> Column:
    """The least sum of n log2 n over the character counts of any window of a piece, by one fold that carries all counts along, a byte each."""
    size = F.length(piece)
    nlogn = [round(n * math.log2(n) * SCALE) if n else 0 for n in range(window + 1)]
    rise = F.array(*[F.lit(b - a).cast("long") for a, b in zip(nlogn, nlogn[1:], strict=False)])
    as_byte = F.array(*[F.lit(bytes([n + ZERO])) for n in range(window + 1)])

    def steps(codes: Column) -> Column:
        gone = F.concat(F.array_repeat(F.lit(None).cast("int"), window), codes)
        pairs = F.zip_with(codes, F.slice(gone, F.lit(1), size), lambda enters, leaves: F.struct(enters.alias("enters"), leaves.alias("leaves")))
        return F.transform(pairs, lambda x, i: F.struct(x["enters"].alias("enters"), x["leaves"].alias("leaves"), (i >= window - 1).alias("full")))

    def step(acc: Column, x: Column) -> Column:
        enters, leaves, counts = x["enters"], x["leaves"], acc["counts"]
        count = lambda slot: F.ascii(F.substring(counts, slot, F.lit(1)).cast("string")) - ZERO
        put = lambda to, slot, n: F.overlay(to, F.get(as_byte, n), slot, F.lit(1))
        without = F.when(leaves.isNull(), counts).otherwise(put(counts, leaves, count(leaves) - 1))
        s = acc["s"] - F.coalesce(F.get(rise, count(leaves) - 1), F.lit(0)) + F.get(rise, count(enters))
        moved = F.struct(put(without, enters, count(enters) + 1).alias("counts"), s.alias("s"), F.when(x["full"], F.least(acc["low"], s)).otherwise(acc["low"]).alias("low"))
        return F.when(enters == leaves, acc).otherwise(moved)

    seed = F.struct(F.lit(bytes([ZERO]) * CODES).alias("counts"), F.lit(0).cast("long").alias("s"), F.lit(nlogn[window]).cast("long").alias("low"))
    codes = F.transform(F.slice(F.split(piece, ""), F.lit(1), size), lambda char: F.ascii(char) - FIRST_CODE + 1)
    return F.aggregate(let(codes, steps), seed, step, lambda acc: acc["low"])


def peak_entropy(run: Column, window: int = WINDOW) -> Column:
    """The largest entropy in bits of any window of a run of at least ``window`` (at most 80) token characters.

    S = sum of n log2 n over the window's character counts; H = log2 W - S / W.
    """

    def scan(r: Column) -> Column:
        last = F.floor((F.length(r) - window) / PIECE).cast("int")
        lows = F.transform(F.sequence(F.lit(0), last), lambda k: let(F.substring(r, k * PIECE + 1, F.lit(PIECE + window - 1)), lambda piece: _lowest_sum(piece, window)))
        return F.lit(math.log2(window)) - F.array_min(lows) / (SCALE * window)

    return let(run, scan)


def _entropy_spans(text: Column) -> Column:
    def kind_of(run: Column) -> Column:
        kind = F.lit(None).cast("int")
        for name, pattern in reversed(CLASSES.items()):
            kind = F.when(run.rlike(pattern), F.lit(KINDS.index(name))).otherwise(kind)
        return kind

    def least_bits(kind: Column) -> Column:
        return F.element_at(F.array(*[F.lit(BITS[name]) for name in CLASSES]), kind - KINDS.index("entropy_hex") + 1)

    def between_slashes(run: Column) -> Column:
        parts = _matches(run["hit"], rf"[^/]{{{WINDOW},}}", lambda part: ~part.rlike(PLACEHOLDER))
        return F.transform(parts, lambda p: F.struct((p["start"] + run["start"]).alias("start"), (p["end"] + run["start"]).alias("end"), p["hit"].alias("hit")))

    def judged(run: Column) -> Column:
        hit = run["hit"]
        hot = lambda kind: ~hit.rlike(SHAPES) & hit.rlike("[0-9]") & (peak_entropy(hit) >= least_bits(kind))
        return let(kind_of(hit), lambda kind: F.when(hot(kind), F.struct(run["start"].alias("start"), run["end"].alias("end"), kind.alias("kind"))))

    runs = F.transform(_matches(text, RUN, lambda _: F.lit(True)), lambda run: F.when(run["hit"].rlike(PLACEHOLDER), between_slashes(run)).otherwise(F.array(run)))
    return F.filter(F.transform(F.flatten(runs), judged), lambda s: s.isNotNull())


def find_secrets(docs: DataFrame, text_col: str = "text", out: str | None = None) -> DataFrame:
    """docs with one more column, the last: spans (start, end, kind), by start and then kind.

    Offsets are code points, ends exclusive; kind indexes KINDS. The column is
    called ``out``, or secret_spans with underscores added until docs has no
    such column. A null or empty text has no spans; an empty table gives no
    rows. Kinds are searched apart, so their spans may overlap. Repeated rows,
    ties of ids and all other columns stay as they are.
    """
    (text,) = fresh(docs, "scan_text")
    out = out or fresh(docs, "secret_spans")[0]
    t = F.col(text)
    base = F.concat(
        _spans(t, ASSIGN, 0, lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 6),
        _spans(t, ACCESS, 1, lambda hit: F.length(hit) >= 20),
        _spans(t, HEX, 2, lambda _: F.lit(True)),
        _entropy_spans(t),
    )
    order = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    spans = F.array_sort(F.transform(base, order))
    return docs.withColumn(text, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).withColumn(out, spans).drop(text)


def span_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every run of overlapping spans replaced by one mark; null stays null. Spans go by start."""

    def block(spans_here: Column, begin: Column) -> Column:
        stop = F.greatest(begin, F.array_max(F.transform(spans_here, lambda s: s["end"])))
        region = F.substring(text, (begin + 1).cast("int"), (stop - begin).cast("int"))

        def pieces(part: Column) -> Column:
            def step(acc: Column, s: Column) -> Column:
                gap = F.substring(part, (acc["at"] - begin + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
                apart = F.struct(s["end"].alias("at"), F.array_append(acc["out"], F.concat(gap, F.lit(mark))).alias("out"))
                longer = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
                return F.when(s["start"] >= acc["at"], apart).otherwise(longer)

            return F.array_join(F.aggregate(spans_here, F.struct(begin.alias("at"), F.array().cast("array<string>").alias("out")), step, lambda acc: acc["out"]), "")

        return let(region, pieces)

    ends = lambda bs: F.transform(bs, lambda b: F.array_max(F.transform(b, lambda s: s["end"])))
    rest = F.substring(text, (F.array_max(F.transform(spans, lambda s: s["end"])) + 1).cast("int"), F.length(text))
    cut = let(_blocks(spans), lambda bs: F.zip_with(bs, _before(ends(bs), lambda at, n: F.greatest(at, n)), block))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(F.array_append(cut, rest), ""))
