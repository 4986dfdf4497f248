"""Statistics of an entity's earlier rows. No frame ever holds the current row.

All columns of a call share one window specification, so one exchange and one
sort serve them all. Order by a time and a tie-break: rows with equal times are
otherwise in no order.

Few entities with many rows each would leave most tasks without work. So every
function takes ``block``, a whole number that never falls along the order (see
``time_block``), or ``Blocks``: an entity's rows are then dealt out block by block, and what a
block needs of the ones before it is worked out from small rows, one or a few
a block. Results are the same; null entities and null blocks (which come first)
count as values.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: The block of rows whose block is null.
FIRST = -(1 << 62)
KEY = ["__entity", "__block"]


def time_block(time: Column | str, days: int = 90) -> Column:
    """Number of the span of ``days`` that a date or timestamp falls into."""
    return F.floor(F.unix_date(F.to_date(time)) / days)


@dataclass(frozen=True)
class Blocks:
    """Blocks of rows, and in how many parts the (entity, block)s are dealt out: with parts and blocks that follow the table's size, a task's rows stay the same."""

    number: Column
    parts: int | None = None

    def deal(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.parts, *KEY) if self.parts else df


def _spec(entity: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*entity).orderBy(*order)


def _blocks(block: Column | Blocks) -> Blocks:
    return block if isinstance(block, Blocks) else Blocks(block)


def _keyed(df: DataFrame, entity: Sequence[str], block: Column | Blocks) -> DataFrame:
    """df with KEY: the entity as one value that is never null, and the block."""
    return df.select("*", F.struct(*entity).alias("__entity"), F.coalesce(_blocks(block).number.cast("long"), F.lit(FIRST)).alias("__block"))


def _dealt(df: DataFrame, entity: Sequence[str], block: Column | Blocks) -> DataFrame:
    return _blocks(block).deal(_keyed(df, entity, block))


def with_halo(df: DataFrame, entity: Sequence[str], order: Sequence[str], block: Column | Blocks, rows: int) -> DataFrame:
    """df with KEY and __halo: each block of an entity, and as halo the entity's ``rows`` rows before it.

    Those lie among the last ``rows`` rows of the earlier blocks. Only such rows
    (cut down before the shuffle) meet by entity: one of them goes to every
    block that begins within the next ``rows`` of them.
    """
    own = _keyed(df, entity, block).withColumn("__halo", F.lit(False))
    latest = Window.partitionBy(*KEY).orderBy(*[F.col(o).desc_nulls_last() for o in order])
    tail = own.withColumn("__back", F.row_number().over(latest)).filter(F.col("__back") <= rows).drop("__back")
    along = Window.partitionBy("__entity").orderBy("__block", *order)
    tail = tail.withColumn("__begins", F.coalesce(F.lag("__block").over(along) != F.col("__block"), F.lit(True)))
    tail = tail.withColumn("__to", F.collect_list(F.when(F.col("__begins"), F.col("__block"))).over(along.rowsBetween(1, rows)))
    halo = tail.select(*df.columns, "__entity", F.explode("__to").alias("__block"), F.lit(True).alias("__halo"))
    return _blocks(block).deal(own.unionByName(halo))


def _within(df: DataFrame, entity: Sequence[str], order: Sequence[str], block: Column | Blocks | None, rows: int, columns: Callable[[WindowSpec], list[Column]]) -> DataFrame:
    """df with columns over frames that reach ``rows`` rows back."""
    if block is None:
        return df.select("*", *columns(_spec(entity, order)))
    return with_halo(df, entity, order, block, rows).select("*", *columns(_spec(KEY, order))).filter(~F.col("__halo")).drop(*KEY, "__halo")


def rolling_mean(df: DataFrame, entity: Sequence[str], order: Sequence[str], columns: Sequence[str], windows: Sequence[int] = (1, 3, 5, 10), block: Column | Blocks | None = None) -> DataFrame:
    """{column}_r{k}: mean of the k rows before, nulls skipped, null if none has a value."""
    return _within(df, entity, order, block, max(windows), lambda w: [F.avg(c).over(w.rowsBetween(-k, -1)).alias(f"{c}_r{k}") for c in columns for k in windows])


def expanding_mean(df: DataFrame, entity: Sequence[str], order: Sequence[str], columns: Sequence[str], reset_by: Sequence[str] = (), suffix: str = "_avg", block: Column | Blocks | None = None) -> DataFrame:
    """Mean of all rows before, from the start or from the start of each reset_by group.

    In blocks: the sums of the block so far and those of the blocks before,
    which are summed first.
    """
    key = [*entity, *reset_by]
    if block is None:
        w = _spec(key, order).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *[F.avg(c).over(w).alias(c + suffix) for c in columns])
    own, n = _dealt(df, key, block), range(len(columns))
    totals = own.groupBy(*KEY).agg(*[f(c).alias(f"__{name}{i}") for i, c in enumerate(columns) for name, f in (("s", F.sum), ("n", F.count))])
    earlier = _spec(["__entity"], ["__block"]).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*KEY, *[F.sum(f"__{name}{i}").over(earlier).alias(f"__{name}{i}") for i in n for name in "sn"])
    w = _spec(KEY, order).rowsBetween(Window.unboundedPreceding, -1)
    plus = lambda f, c, carried: F.coalesce(carried, F.lit(0)) + F.coalesce(f(c).over(w), F.lit(0))
    means = [F.try_divide(plus(F.sum, c, F.col(f"__s{i}")).cast("double"), plus(F.count, c, F.col(f"__n{i}")).cast("double")).alias(c + suffix) for i, c in enumerate(columns)]
    return own.join(before, KEY).select(*df.columns, *means)


def previous(df: DataFrame, entity: Sequence[str], order: Sequence[str], columns: Sequence[str], block: Column | Blocks | None = None) -> DataFrame:
    return _within(df, entity, order, block, 1, lambda w: [F.lag(c).over(w).alias(f"{c}_prev") for c in columns])


def gap_days(df: DataFrame, entity: Sequence[str], order: Sequence[str], time: str, default: int = 7, name: str = "rest_days", block: Column | Blocks | None = None) -> DataFrame:
    """Whole spans of 24 hours since the row before; default for the first."""
    gap = lambda w: F.timestamp_diff("DAY", F.lag(time).over(w), F.col(time))
    return _within(df, entity, order, block, 1, lambda w: [F.coalesce(gap(w), F.lit(default)).cast("long").alias(name)])


def _reach(alpha: float) -> int:
    """Rows after which a value weighs less than 1e-17, whatever the gaps between values."""
    weight = lambda g: (1 - alpha) ** g / ((1 - alpha) ** g + alpha)
    slowest = max(weight(g) ** (1 / g) for g in range(1, math.ceil(8 / alpha)))
    return max(1, math.ceil(math.log(1e-17) / math.log(slowest)))


def ewma(df: DataFrame, entity: Sequence[str], order: Sequence[str], columns: Sequence[str], alpha: float = 1 / 3, suffix: str = "_ewma", block: Column | Blocks | None = None) -> DataFrame:
    """Exponentially weighted mean of the rows before: y = (1 - alpha) y + alpha x, with alpha of 0.03 to 1.

    The first value seeds it. Nulls leave y as it is but age it: after g rows its
    weight is (1 - alpha)^g. So y = keep * y + gain * x with k = (1 - alpha)^g,
    keep = k / (k + alpha) and gain = alpha / (k + alpha), and y is the product of
    all keeps so far times a running sum of gain * x over that product. Sums and
    products start anew every ``_reach`` rows, which keeps them in range of a
    double: what is left of an older value than the last part's weighs less
    than 1e-17. No row holds a list, and all columns share the sorts. alpha = 1
    is the last value.

    In blocks: a block alone is an affine map of the mean that comes into it
    (``_block_maps``); the few maps of an entity are composed in their order
    (``_carried``), and what came in is added to each row by its weight there.
    """
    if not 0.03 <= alpha <= 1:
        raise ValueError("alpha must lie between 0.03 and 1")
    if block is None:
        w = _spec(entity, order).rowsBetween(Window.unboundedPreceding, -1)
        out = _means(df, entity, order, columns, alpha)
        return out.select(*df.columns, *[F.last(f"__{i}_y", ignorenulls=True).over(w).alias(c + suffix) for i, c in enumerate(columns)])
    own = _means(_dealt(df, entity, block), KEY, order, columns, alpha)
    carried = _carried(_block_maps(own, columns), len(columns), alpha)
    w = _spec(KEY, order).rowsBetween(Window.unboundedPreceding, -1)
    whole = lambda i: F.col(f"__{i}_y") + F.exp(f"__{i}_kept") * F.coalesce(f"__{i}_delta", F.lit(0.0))
    means = [F.coalesce(F.last(whole(i), ignorenulls=True).over(w), F.col(f"__{i}_in")).alias(c + suffix) for i, c in enumerate(columns)]
    return own.join(carried, KEY).select(*df.columns, *means)


def _means(df: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str], alpha: float) -> DataFrame:
    """df with __rn and, for column i, __i_y (the mean with the row's own value, null where it has none) and __i_kept (log of the weight that a mean coming in before the key's first value still has, less that value's own keep)."""
    w = _spec(key, order)
    before, all_so_far = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    each = lambda make: {name: col for i, c in enumerate(columns) for name, col in make(f"__{i}", F.col(c).cast("double")).items()}
    out = df.withColumn("__rn", F.row_number().over(w))
    if alpha == 1:
        return out.select("*", *[col.alias(name) for name, col in each(lambda n, x: {f"{n}_y": x, f"{n}_kept": F.lit(0.0)}).items()])
    part = _reach(alpha)
    out = out.withColumn("__part", F.floor((F.col("__rn") - 1) / part))
    so_far = _spec([*key, "__part"], order).rowsBetween(Window.unboundedPreceding, 0)
    # a keep of e^-80 is as good as none, and its inverse is in range
    keep = lambda n: F.when(F.col(f"{n}_k").isNotNull(), F.greatest(F.ln(F.col(f"{n}_k") / (F.col(f"{n}_k") + alpha)), F.lit(-80.0))).otherwise(0.0)

    def gaps(n: str, x: Column) -> dict[str, Column]:
        return {f"{n}_k": F.when(x.isNotNull(), F.pow(F.lit(1 - alpha), F.col("__rn") - F.last(F.when(x.isNotNull(), F.col("__rn")), ignorenulls=True).over(before)))}

    def logs(n: str, x: Column) -> dict[str, Column]:
        return {f"{n}_log": F.sum(keep(n)).over(so_far), f"{n}_kept": F.sum(keep(n)).over(all_so_far)}

    def own(n: str, x: Column) -> dict[str, Column]:
        gain = F.coalesce(alpha / (F.col(f"{n}_k") + alpha), F.lit(1.0))
        return {f"{n}_own": F.exp(f"{n}_log") * F.sum(gain * x * F.exp(-F.col(f"{n}_log"))).over(so_far)}

    def ends(n: str, x: Column) -> dict[str, Column]:
        return {f"{n}_end": F.when((F.col("__rn") - 1) % part == 0, F.coalesce(F.lag(f"{n}_own").over(w), F.lit(0.0)))}

    def means(n: str, x: Column) -> dict[str, Column]:
        return {f"{n}_y": F.when(x.isNotNull(), F.coalesce(f"{n}_own", F.lit(0.0)) + F.exp(f"{n}_log") * F.first(f"{n}_end").over(so_far))}

    for step in (gaps, logs, own, ends, means):
        out = out.select("*", *[col.alias(name) for name, col in each(step).items()])
    kept = [f"__{i}_{name}" for i in range(len(columns)) for name in ("y", "kept")]
    return out.select(*df.columns, "__rn", *kept)


def _block_maps(own: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per block and column i: rows, place of the first value, rows after the last, first value, mean at the last value if the first seeds it, and the weight of what came in there."""

    def of(i: int, c: str) -> Column:
        x = F.col(c).cast("double")
        at = F.when(x.isNotNull(), F.col("__rn"))
        return F.struct(
            F.lit(i).alias("i"), F.max("__rn").alias("rows"), F.min(at).alias("first"), (F.max("__rn") - F.max(at)).alias("after"),
            F.min_by(x, at).alias("x"), F.max_by(F.col(f"__{i}_y"), at).alias("y"), F.exp(F.max_by(F.col(f"__{i}_kept"), at)).alias("weight"),
        )

    return own.groupBy(*KEY).agg(F.array(*[of(i, c) for i, c in enumerate(columns)]).alias("maps")).select(*KEY, F.inline("maps"))


def _carried(maps: DataFrame, n: int, alpha: float) -> DataFrame:
    """KEY and, for column i, __i_in (the mean that comes into the block) and __i_delta (by how much it changes the mean at the block's first value). A list has one item a block."""
    lists = maps.groupBy("__entity", "i").agg(F.sort_array(F.collect_list(F.struct("__block", "rows", "first", "after", "x", "y", "weight"))).alias("blocks"))
    out = "array<struct<__block:bigint,come:double,delta:double>>"
    start = F.struct(F.lit(None).cast("double").alias("y"), F.lit(0).cast("long").alias("age"), F.array().cast(out).alias("out"))

    def step(acc: Column, b: Column) -> Column:
        some, k = b["first"].isNotNull(), F.pow(F.lit(1 - alpha), acc["age"] + b["first"])
        delta = F.when(acc["y"].isNotNull(), (k * acc["y"] + alpha * b["x"]) / (k + alpha) - b["x"]).otherwise(0.0)
        return F.struct(
            F.when(some, b["y"] + b["weight"] * delta).otherwise(acc["y"]).alias("y"),
            F.when(some, b["after"]).otherwise(acc["age"] + b["rows"]).cast("long").alias("age"),
            F.concat(acc["out"], F.array(F.struct(b["__block"].alias("__block"), acc["y"].alias("come"), F.when(some, delta).alias("delta")))).cast(out).alias("out"),
        )

    found = lists.select("__entity", "i", F.inline(F.aggregate("blocks", start, step)["out"]))
    return found.groupBy(*KEY).agg(*[F.max(F.when(F.col("i") == i, F.col(c))).alias(f"__{i}_{name}") for i in range(n) for name, c in (("in", "come"), ("delta", "delta"))])


def span_alpha(halflife: float) -> float:
    """The weight that takes ``halflife`` as a span of 2h - 1 rows: 1/h."""
    return 1 / halflife
