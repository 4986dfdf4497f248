"""Splits by time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairframe.operators.select import row_at
from pairframe.sources import written


def split_by_season(df: DataFrame, season: str = "season", time: str = "date", key: str = "game_id") -> DataFrame:
    """Adds split, by the number of seasons: the parts never overlap.

    Four and more: the last two are test, the one before val, the rest train.
    Three: one each. Two: the last is test, and the first is cut by place in
    (time, key) order into 70 % train and the rest val. One or none: all rows
    are cut 70/15/15 by place. Rows without a season are train.
    """
    seasons = sorted(r[0] for r in df.select(season).distinct().filter(F.col(season).isNotNull()).collect())
    if len(seasons) < 2:
        return split_by_position(df, time, key)
    if len(seasons) == 2:
        last = F.col(season).eqNullSafe(F.lit(seasons[1]))
        (early,) = _before(df.filter(~last), time, key, [0.70])
        return df.withColumn("split", F.when(last, "test").when(early, "train").otherwise("val"))
    tests = 1 if len(seasons) == 3 else 2
    name = F.when(F.col(season).isin(seasons[-tests:]), "test").when(F.col(season) == seasons[-tests - 1], "val")
    return df.withColumn("split", name.otherwise("train"))


def split_by_position(df: DataFrame, time: str, key: str, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """Adds split by place in (time, key) order: train up to int(train * n), val up to int((train + val) * n), then test.

    The rows at the two places are found by counting within brackets, and every
    other row is compared with them: nothing is sorted or numbered. Null times
    come first; rows equal in time and key are in one part.
    """
    early, later = _before(df, time, key, [train, train + val])
    return df.withColumn("split", F.when(early, "train").when(later, "val").otherwise("test"))


def _before(df: DataFrame, time: str, key: str, shares: Sequence[float]) -> list[Column]:
    """Whether a row lies before the place that is this share of all rows. The passes that find the places read two columns, written once: df itself is worked out for these, and not again."""
    narrow = written(df.select(time, key), "order")
    n = narrow.count()
    return [row_at(narrow, [time, key], int(share * n)) for share in shares]
