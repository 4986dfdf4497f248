"""One row per event (two sides) and one row per participant."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_sides(events: DataFrame, keep: Sequence[str], sided: Mapping[str, tuple[str, str]], is_home: str = "is_home") -> DataFrame:
    """Two rows per event from one scan. sided: name -> (home column, away column)."""

    def side(k: int) -> Column:
        return F.struct(F.lit(1 - k).alias(is_home), *[F.col(pair[k]).alias(name) for name, pair in sided.items()])

    rows = events.select(*keep, F.explode(F.array(side(0), side(1))).alias("side"))
    return rows.select(*keep, f"side.{is_home}", *[f"side.{name}" for name in sided])


def match_sides(matches: DataFrame, keep: Sequence[str] = ("game_id", "date")) -> DataFrame:
    """team, opponent, points for and against, by side."""
    return to_sides(
        matches,
        keep,
        {"team": ("home_team", "away_team"), "opponent": ("away_team", "home_team"), "points_for": ("home_score", "away_score"), "points_against": ("away_score", "home_score")},
    )


def widen(sides: DataFrame, key: str, columns: Sequence[str], is_home: str = "is_home") -> DataFrame:
    """One row per event with home_ and away_ columns: one aggregation, no join."""
    pick = [F.max(F.when(F.col(is_home) == flag, F.col(c))).alias(f"{side}_{c}") for c in columns for side, flag in (("home", 1), ("away", 0))]
    return sides.groupBy(key).agg(*pick)


def prefixed(df: DataFrame, prefix: str, keys: Mapping[str, str], columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(k).alias(v) for k, v in keys.items()], *[F.col(c).alias(prefix + c) for c in columns])


def attach_both_sides(events: DataFrame, features: DataFrame, keys: Sequence[str], columns: Sequence[str], team: str = "team", home: str = "home_team", away: str = "away_team") -> DataFrame:
    """Features of both sides on each event, by keys and team; names get their prefix before the join."""
    for prefix, column in (("home_", home), ("away_", away)):
        side = prefixed(features, prefix, {**{k: k for k in keys}, team: column}, columns)
        events = events.join(side, [*keys, column], "left")
    return events


def teams(events: DataFrame, home: str = "home_team", away: str = "away_team") -> DataFrame:
    return events.select(F.explode(F.array(home, away)).alias("team")).distinct()


def events_of(events: DataFrame, chosen: DataFrame, side: str, team: str = "team") -> DataFrame:
    """The events whose participant on one side (a column such as home_team) is among the chosen teams."""
    return events.join(chosen.select(F.col(team).alias(side)).distinct(), side, "left_semi")


def points_by_side(stats: DataFrame, events: DataFrame, key: str = "game_id", team: str = "team") -> DataFrame:
    """Points for and against of each (event, team) row, from the event table."""
    scores = events.select(key, "home_team", "home_score", "away_score")
    at_home = F.col(team) == F.col("home_team")
    joined = stats.join(scores, key, "left")
    return joined.select(
        *stats.columns,
        F.when(at_home, F.col("home_score")).otherwise(F.col("away_score")).alias("points_for"),
        F.when(at_home, F.col("away_score")).otherwise(F.col("home_score")).alias("points_against"),
    )
