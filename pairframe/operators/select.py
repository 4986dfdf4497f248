"""Exact order statistics without gathering a column: brackets of ranks, narrowed by counting.

A bracket comes from approximate quantiles, whose summaries merge and stay
small. One pass then counts what lies below it and what inside, so that it is
known to hold the wanted ranks. Brackets are narrowed until few distinct values
are left in them; only those are counted one by one.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows inside a bracket that are counted value by value.
INSIDE = 1_000_000
#: Half the width of a bracket, as a share of its rows, and the accuracy of its quantiles.
WIDTH, ACCURACY = 5e-4, 10_000


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def ranked(df: DataFrame, columns: Sequence[str], ranks: Mapping[str, Sequence[int]] | None = None, inside: int = INSIDE, width: float = WIDTH) -> dict[str, list]:
    """The values of given ranks (from 0, by column, nulls not counted), or of the one or two middle ranks.

    Columns are numbers; NaN is larger than any other. A rank beyond the values
    gives None; a column without values an empty list of middle ones.
    """
    names = list(dict.fromkeys(columns))
    n = df.selectExpr(*[f"count({_quoted(c)}) AS {_quoted(c)}" for c in names]).first().asDict() if names else {}
    wanted = {c: (list(ranks[c]) if ranks else sorted({(n[c] - 1) // 2, n[c] // 2}) if n[c] else []) for c in names}
    found: dict[str, dict[int, object]] = {c: {} for c in names}
    # brackets: (column, ranks, low, high, rows up to low, rows between); their ends are outside, and None is no end
    work = [(c, [r for r in sorted(set(wanted[c])) if 0 <= r < n[c]], None, None, 0, n[c]) for c in names]
    work = [w for w in work if w[1]]
    while work:
        few = [w for w in work if w[5] <= inside]
        if few:
            for (c, rs, *_), values in zip(few, _counted(df, few), strict=True):
                found[c] |= dict(zip(rs, values, strict=True))
        work = _narrowed(df, [w for w in work if w[5] > inside], width, found)
    return {c: [found[c].get(r) for r in wanted[c]] for c in names}


def _in(c: str, low, high) -> Column:
    x = F.col(_quoted(c))
    holds = x.isNotNull()
    if low is not None:
        holds = holds & (x > F.lit(low))
    return holds & (x < F.lit(high)) if high is not None else holds


def _narrowed(df: DataFrame, work: list[tuple], width: float, found: dict) -> list[tuple]:
    """Each bracket cut to one around every rank's quantile. Where counting shows that a rank lies outside, its side of the old bracket is kept."""
    if not work:
        return []
    asks = [(c, r, low, high, below, rows) for c, rs, low, high, below, rows in work for r in rs]

    def ends(c, r, low, high, below, rows):
        share = (r - below + 0.5) / rows
        pair = [max(0.0, share - width), min(1.0, share + width)]
        return F.percentile_approx(F.when(_in(c, low, high), F.col(_quoted(c))), pair, ACCURACY)

    cuts = df.agg(*[ends(*a).alias(f"q{i}") for i, a in enumerate(asks)]).first()
    counts = []
    for i, (c, _, low, high, _, _) in enumerate(asks):
        x, inside = F.col(_quoted(c)), _in(c, low, high)
        for end, cut in zip("lh", cuts[f"q{i}"], strict=True):
            counts += [F.count_if(inside & (x < F.lit(cut))).alias(f"{end}{i}"), F.count_if(inside & (x == F.lit(cut))).alias(f"same_{end}{i}")]
    seen, out = df.agg(*counts).first(), []
    for i, (c, r, low, high, below, rows) in enumerate(asks):
        (a, b), place = cuts[f"q{i}"], r - below
        at_a, at_b = seen[f"l{i}"], seen[f"h{i}"]
        past_a, past_b = at_a + seen[f"same_l{i}"], at_b + seen[f"same_h{i}"]
        if at_a <= place < past_a:
            found[c][r] = a
        elif at_b <= place < past_b:
            found[c][r] = b
        elif place < at_a:
            out.append((c, [r], low, a, below, at_a))
        elif place >= past_b:
            out.append((c, [r], b, high, below + past_b, rows - past_b))
        else:
            out.append((c, [r], a, b, below + past_a, at_b - past_a))
    return out


def _counted(df: DataFrame, work: list[tuple]) -> list[list]:
    """The values of the ranks of each bracket, from counts of its distinct values."""
    kinds = dict(df.dtypes)
    per_kind: dict[str, list[int]] = {}
    for i, w in enumerate(work):
        per_kind.setdefault(kinds[w[0]], []).append(i)
    values: list[list] = [[None] * len(w[1]) for w in work]
    for places in per_kind.values():
        held = F.array(*[F.when(_in(work[i][0], work[i][2], work[i][3]), F.struct(F.lit(i).alias("i"), F.col(_quoted(work[i][0])).alias("v"))) for i in places])
        counts = df.select(F.inline(F.filter(held, lambda x: x.isNotNull()))).groupBy("i", "v").agg(F.count("*").alias("n"))
        last = F.sum("n").over(Window.partitionBy("i").orderBy("v")) - 1
        place = F.array(*[F.array(*[F.lit(r - work[i][4]).cast("long") for r in work[i][1]]) if i in places else F.array().cast("array<bigint>") for i in range(len(work))])
        hits = counts.withColumn("last", last).withColumn("k", F.explode(F.get(place, F.col("i")))).filter("k <= last and k > last - n")
        for row in hits.collect():
            w = work[row.i]
            for j, r in enumerate(w[1]):
                if r - w[4] == row.k:
                    values[row.i][j] = row.v
    return values


#: Bits of a double that each pass of ``lower_middles`` settles, from the highest.
BITS = (11, 11, 11, 11, 11, 9)
#: Different values of a column that a task hands on, and columns that are read together.
FEW, SOME = 256, 90


def _ordered_bits(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles; -0.0 is 0.0, and NaN is larger than any other."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view("<u8")
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def _double(ordered: int) -> float:
    bits = ordered ^ (1 << 63) if ordered >> 63 else ordered ^ ((1 << 64) - 1)
    return float(np.array([bits], "<u8").view("<f8")[0])


def lower_middles(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """The lower one of the middle values of every column, as a double, exact; None without values.

    Each pass counts, for all columns at once, the next bits of the values that
    share the bits found so far. A task hands on its counts, at most 2^11 small
    rows a column, however many rows it reads, and from the second pass on the
    values themselves where it has few different ones. Columns of which all
    tasks do are done with that pass; at most one pass is made for each of
    ``BITS``. Each reads the columns left, so df should be a table and no plan.
    """
    names = list(dict.fromkeys(columns))
    found, done, ranks, exact = dict.fromkeys(range(len(names)), 0), 0, None, {}
    for bits in BITS:
        if not found:
            break
        bins = _next_bits(df, names, found, done, bits).groupBy("i", "whole", "at").agg(F.sum("n").alias("n"))
        each = Window.partitionBy("i", "whole")
        placed = bins.select("*", (F.sum("n").over(each.orderBy("at")) - F.col("n")).alias("before"), F.sum("n").over(each).alias("total"))
        rank = F.floor((F.col("total") - 1) / 2) if ranks is None else F.create_map(*[F.lit(x) for i, r in ranks.items() for x in (i, r)])[F.col("i")]
        hits = placed.withColumn("rank", rank.cast("long")).filter("before <= rank and rank < before + n").collect()
        binned, values = ({h.i: h for h in hits if h.whole == whole} for whole in (False, True))
        # values of some tasks only are fewer than the bins count
        exact |= {i: found[i] << 64 - done | h.at for i, h in values.items() if h.total == binned[i].total}
        found = {i: found[i] << bits | h.at for i, h in binned.items() if i not in exact}
        ranks, done = {i: binned[i].rank - binned[i].before for i in found}, done + bits
    exact |= found
    return {c: _double(exact[i]) if i in exact else None for i, c in enumerate(names)}


def _next_bits(df: DataFrame, names: Sequence[str], found: Mapping[int, int], done: int, bits: int) -> DataFrame:
    """A pass over the columns left, some at a time, as reading very many together takes longer."""
    parts, left = [], sorted(found)
    for at in range(0, len(left), SOME):
        own = left[at : at + SOME]
        doubles = df.select(*[F.col(_quoted(names[i])).cast("double").alias(f"c{i}") for i in own])
        parts.append(doubles.mapInArrow(partial(_bins, found={i: found[i] for i in own}, done=done, bits=bits), "i int, whole boolean, at long, n long"))
    return reduce(DataFrame.unionAll, parts)


def _bins(batches: Iterator[pa.RecordBatch], found: Mapping[int, int], done: int, bits: int) -> Iterator[pa.RecordBatch]:
    """How many of a task's values have which next bits, by column, and the values where it has at most FEW."""
    counts = {i: np.zeros(1 << bits, np.int64) for i in found}
    values = {i: (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for i in found if done}
    for batch in batches:
        for place, (i, prefix) in enumerate(found.items()):
            key = _ordered_bits(batch.column(place).drop_null().to_numpy(zero_copy_only=False))
            if done:
                key = key[key >> np.uint64(64 - done) == np.uint64(prefix)]
            counts[i] += np.bincount((key >> np.uint64(64 - done - bits) & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
            if i in values:
                there, n = np.unique(key, return_counts=True)
                known, back = np.unique(np.concatenate([values[i][0], there]), return_inverse=True)
                values[i] = known, np.bincount(back, np.concatenate([values[i][1], n]), len(known)).astype(np.int64)
                if len(known) > FEW:
                    del values[i]
    for i, n in counts.items():
        at = np.flatnonzero(n)
        yield _counts(i, False, at, n[at])
    for i, (key, n) in values.items():
        yield _counts(i, True, (key & np.uint64((1 << 64 - done) - 1)).astype(np.int64), n)


def _counts(i: int, whole: bool, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.full(len(at), i, np.int32)), pa.array(np.full(len(at), whole)), pa.array(at.astype(np.int64)), pa.array(n)], names=["i", "whole", "at", "n"])


def middle(values: Sequence) -> float | None:
    """The median from the one or two middle values."""
    if not values:
        return None
    return float(values[0]) if len(values) == 1 else 0.5 * float(values[0]) + 0.5 * float(values[1])


def _digits(df: DataFrame, column: str, kind: str, place: int) -> Column:
    """A number that orders values as the column does, up to ties; ``place`` counts the steps that tell those apart."""
    x = F.col(_quoted(column))
    if kind == "string":
        part = F.rpad(F.hex(F.substring(F.encode(x, "UTF-8"), 7 * place + 1, 7)), 14, "0")
        return F.coalesce(F.conv(part, 16, 10).cast("long"), F.lit(-1))
    if kind == "timestamp":
        x = F.unix_micros(x)
    elif kind == "timestamp_ntz":
        # by its parts, as no time zone may bear on it
        seconds = F.unix_date(F.to_date(x)).cast("long") * 86_400 + F.hour(x) * 3600 + F.minute(x) * 60
        x = seconds * 1_000_000 + (F.date_part(F.lit("SECONDS"), x) * 1_000_000).cast("long")
    elif kind == "date":
        x = F.unix_date(x)
    return F.coalesce(x.cast("long") if kind not in ("float", "double") else x, F.lit(float("-inf") if kind in ("float", "double") else -(1 << 62)))


def row_at(df: DataFrame, order: Sequence[str], rank: int) -> Column:
    """Whether a row comes before the one of this rank (from 0) in the order, nulls first: an expression over df's columns.

    The order's columns are whole numbers or doubles, times or strings (told
    apart by their bytes, trailing zero bytes aside). Rows that are equal in all
    of them are on one side, so that as many rows as ``rank`` lie before if the
    order tells all rows apart.
    """
    kinds = dict(df.dtypes)
    before, equal = F.lit(False), F.lit(True)
    for column in order:
        place, longest = 0, 0
        if kinds[column] == "string":
            longest = df.agg(F.max(F.octet_length(F.col(_quoted(column))))).first()[0] or 0
        while place == 0 or 7 * place < longest:
            digit = _digits(df, column, kinds[column], place)
            (value,) = ranked(df.filter(equal).select(digit.alias("digit")), ["digit"], {"digit": [rank]})["digit"]
            if value is None:
                return before | equal  # the rank lies beyond all rows
            below, same = df.filter(equal).agg(F.count_if(digit < F.lit(value)), F.count_if(digit == F.lit(value))).first()
            before, equal, rank = before | (equal & (digit < F.lit(value))), equal & (digit == F.lit(value)), rank - below
            if same == 1:
                return before
            place += 1
    return before
