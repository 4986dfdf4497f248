"""Column expressions. Every one is built-in and null-safe in the way its docstring says."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clip(c: Column, low: float, high: float) -> Column:
    """c held within bounds; null stays null, though least() and greatest() would skip it."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def total(*parts: Column) -> Column:
    """Sum of the parts, each null counting as 0."""
    return reduce(lambda a, b: a + b, [zero(p) for p in parts])


def number(c: Column) -> Column:
    """Text as double, null where it is no number."""
    return c.try_cast("double")


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0, also where it is null."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def contains_flag(c: Column, keyword: str) -> Column:
    return flag(c.ilike(f"%{keyword}%"))


def member_flag(c: Column, values: Sequence) -> Column:
    return flag(c.isin(list(values)))


def lookup(c: Column, table: Mapping, default) -> Column:
    """The value of c in a small fixed table."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(default))


def outcome(home: Column, away: Column) -> dict[str, Column]:
    """Win of the home side (a null compares as no win), margin and total."""
    return {"home_win": flag(home > away), "point_diff": home - away, "total_points": home + away}


def time_bands(hour: Column) -> dict[str, Column]:
    return {
        "prime_time": flag((hour >= 20) | (hour < 12)),
        "afternoon": flag((hour >= 13) & (hour < 17)),
        "evening": flag(hour >= 17),
    }


def weather_flags(temp: Column, wind: Column, dome: Column) -> dict[str, Column]:
    return {
        "cold_weather": flag(temp < 32),
        "hot_weather": flag(temp > 80),
        "windy": flag(wind > 15),
        "very_windy": flag(wind > 20),
        "precip_flag": flag((dome == 0) & (temp < 40)),
    }


def first_label(choices: Sequence[tuple[Column, str]], default: str) -> Column:
    """The label of the first condition that holds."""
    out = F.lit(default)
    for condition, label in reversed(choices):
        out = F.when(condition, F.lit(label)).otherwise(out)
    return out


def one_hot(c: Column, values: Sequence[str], prefix: str) -> dict[str, Column]:
    """A boolean per listed value, so the schema does not depend on the data."""
    return {f"{prefix}_{v}": F.coalesce(c == v, F.lit(False)) for v in values}


def line_probability(spread: Column, points: float = 28.0) -> Column:
    """Probability implied by a point spread, linear and held within [0, 1]."""
    return clip(0.5 + spread / points, 0.0, 1.0)


def moneyline_probability(odds: Column) -> Column:
    """Probability implied by American odds; 0.5 for none or 0."""
    return F.when(odds > 0, 100 / (odds + 100)).when(odds < 0, -odds / (100 - odds)).otherwise(F.lit(0.5))


def pair_differences(df: DataFrame, home: str = "home_", away: str = "away_", exclude: Sequence[str] = ()) -> DataFrame:
    """diff_X and abs_diff_X for every numeric home_X with a numeric away_X. Only the prefix counts."""
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "byte") or f.dataType.typeName().startswith("decimal")}
    names = [c.removeprefix(home) for c in df.columns if c.startswith(home) and c in numeric and away + c.removeprefix(home) in numeric]
    diffs = [(n, F.col(home + n) - F.col(away + n)) for n in names if n not in exclude]
    return df.select("*", *[d.alias(f"diff_{n}") for n, d in diffs], *[F.abs(d).alias(f"abs_diff_{n}") for n, d in diffs])


def interactions(df: DataFrame, products: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Products (a, b, name) of columns, each only where df has both."""
    return df.select("*", *[(F.col(a) * F.col(b)).alias(name) for a, b, name in products if a in df.columns and b in df.columns])


def derived(df: DataFrame, columns: Mapping[str, tuple[tuple[str, ...], Column]]) -> DataFrame:
    """name -> (inputs, expression), each only where df has all inputs."""
    return df.select("*", *[c.alias(name) for name, (needs, c) in columns.items() if set(needs) <= set(df.columns)])


def proxy_efficiency(yards_per_play: Column, success_rate: Column) -> Column:
    """Stand-in for a missing efficiency measure."""
    return (yards_per_play - 4) / 10 + 0.1 * success_rate
