"""Profiles, imputation and audits. All figures of a call but exact medians come from one aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairframe.operators.select import lower_middles, middle, ranked

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC or t.startswith("decimal")]


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def medians(df: DataFrame, columns: Sequence[str], lower: bool = False) -> dict[str, float | None]:
    """The exact median of every column, by counting within brackets, or the lower one of its middle values, by counting bits (see ``select``); None without values."""
    return lower_middles(df, columns) if lower else {c: middle(values) for c, values in ranked(df, columns).items()}


def impute(df: DataFrame, columns: Sequence[str], fit_on: Column | None = None, flags: bool = True, lower: bool = False, learn: DataFrame | None = None) -> DataFrame:
    """Numbers get their median (0 if there is none), strings 'missing'; every listed column gets a {c}_missing flag.

    fit_on restricts the rows the medians come from, so that later rows don't leak;
    ``learn`` has just these rows where that is cheaper than to pick them out of df.
    Expressions are text, as building some hundred columns call by call takes
    longer than filling them.
    """
    numeric, listed = set(numeric_columns(df)), set(columns)
    numbers = [c for c in columns if c in numeric]
    rows = learn if learn is not None else df if fit_on is None else df.filter(fit_on)
    typical = medians(rows, numbers, lower) if numbers else {}
    fill = {c: f"double('{float(typical[c] if typical[c] is not None else 0.0)!r}')" for c in numbers} | {c: "'missing'" for c, t in df.dtypes if t == "string" and c in listed}
    own = {c: f"double({_quoted(c)})" if c in numeric else _quoted(c) for c in fill}
    out = [f"coalesce({own[c]}, {fill[c]}) AS {_quoted(c)}" if c in fill else _quoted(c) for c in df.columns]
    marks = [f"int({_quoted(c)} IS NULL) AS {_quoted(c + '_missing')}" for c in columns] if flags else []
    return df.selectExpr(*out, *marks)


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: dtype, missing count and share, and min, max, mean, median of numbers."""
    kinds, numbers = dict(df.dtypes), set(numeric_columns(df))
    typical = medians(df, [c for c in columns if c in numbers])

    def one(c: str) -> Column:
        x = F.col(c)
        value = lambda f: f(x).cast("double") if c in numbers else F.lit(None).cast("double")
        return F.struct(
            F.lit(c).alias("feature"), F.lit(kinds[c]).alias("dtype"), F.count_if(x.isNull()).alias("missing"),
            F.try_divide(F.count_if(x.isNull()).cast("double"), F.count("*").cast("double")).alias("missing_share"),
            value(F.min).alias("min"), value(F.max).alias("max"), value(F.avg).alias("mean"), F.lit(typical.get(c)).cast("double").alias("median"),
        )

    return df.agg(F.array(*[one(c) for c in columns]).alias("rows")).select(F.inline("rows"))


def missing_report(df: DataFrame, columns: Sequence[str], top: int = 10) -> DataFrame:
    """The columns with most nulls."""
    counts = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = counts.select("rows", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("missing")) for c in columns])))
    return long.filter("missing > 0").select("feature", "missing", F.try_divide(F.col("missing").cast("double"), F.col("rows").cast("double")).alias("missing_share")).orderBy(F.desc("missing"), "feature").limit(top)


def missing_summary(df: DataFrame, columns: Sequence[str], patterns: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row: rows, n_features, the share of all cells that is null, and n_{name}: how many of the columns have a part of the pattern in their name."""
    nulls = F.count_if(F.col(columns[0]).isNull())
    for c in columns[1:]:
        nulls = nulls + F.count_if(F.col(c).isNull())
    share = F.try_divide(nulls.cast("double"), (F.count("*") * len(columns)).cast("double"))
    named = [F.lit(sum(any(part in c for part in parts) for c in columns)).alias(f"n_{name}") for name, parts in patterns.items()]
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(columns)).alias("n_features"), share.alias("missing_share"), *named)


def key_coverage(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: distinct keys on each side, in both, and on one side only."""
    a = left.select(*keys).distinct().withColumn("l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("r", F.lit(1))
    both = a.join(b, list(keys), "full_outer")
    has = lambda x, y: F.count_if((F.col("l").isNotNull() == x) & (F.col("r").isNotNull() == y))
    return both.agg((has(True, True) + has(True, False)).alias("left_keys"), (has(True, True) + has(False, True)).alias("right_keys"), has(True, True).alias("in_both"), has(True, False).alias("left_only"), has(False, True).alias("right_only"))


def leak_audit(sides: DataFrame, entity: str, order: Sequence[str], column: str, feature: str, rows: int) -> DataFrame:
    """Per entity: rows, rows without any earlier row, and rows whose feature is not the mean of the ``rows`` strictly earlier ones.

    The second opinion is worked out from positions, not from a window frame.
    """
    from pyspark.sql.window import Window

    place = sides.withColumn("__n", F.row_number().over(Window.partitionBy(entity).orderBy(*order)))
    later = place.select(entity, F.explode(F.sequence(F.col("__n") + 1, F.col("__n") + rows)).alias("__n"), F.col(column).alias("__x"))
    means = later.groupBy(entity, "__n").agg(F.avg("__x").alias("__again"))
    seen = place.join(means, [entity, "__n"], "left")
    off = ~((F.abs(F.col(feature) - F.col("__again")) < 1e-9) | (F.col(feature).isNull() & F.col("__again").isNull()))
    return seen.groupBy(entity).agg(F.count("*").alias("n_rows"), F.count_if(F.col("__n") == 1).alias("n_first"), F.count_if(F.coalesce(off, F.lit(True))).alias("n_leaks"))


def standardised(df: DataFrame, columns: Sequence[str], fit_on: Column | None = None) -> DataFrame:
    """Columns less their mean over their population deviation, both of the rows of fit_on; a column without spread becomes 0."""
    figures = (df if fit_on is None else df.filter(fit_on)).agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = {}
    for c in columns:
        mean, spread = figures[f"m_{c}"] or 0.0, figures[f"s_{c}"] or 0.0
        scaled[c] = (F.col(c) - mean) / spread if spread > 0 else F.when(F.col(c).isNotNull(), F.lit(0.0))
    return df.withColumns(scaled)


def drop_same_event(df: DataFrame, measures: Sequence[str], prefixes: Sequence[str] = ("home_", "away_")) -> DataFrame:
    """Without the measures of the event itself; their lagged forms stay."""
    return df.drop(*[p + m for p in prefixes for m in measures])
