"""Conditional and mirrored aggregation of detail rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairframe.functions import clip, safe_ratio, total, zero

SCRIMMAGE = ("run", "pass")


def play_stats(plays: DataFrame) -> DataFrame:
    """One row per (game_id, team) with offence: its own plays and, mirrored, those run against it.

    Each play becomes one offensive and one defensive row in the same scan, and
    one aggregation does both sides. A play without a known offence still counts
    against the defence; measures of a side without rows are 0.
    """
    real = F.col("play_type").isin(*SCRIMMAGE)
    sides = F.array(
        F.struct(F.col("posteam").alias("team"), F.lit(True).alias("off"), F.col("defteam").alias("other")),
        F.struct(F.when(~F.col("posteam").eqNullSafe(F.col("defteam")), F.col("defteam")).alias("team"), F.lit(False).alias("off"), F.col("posteam").alias("other")),
    )
    rows = plays.filter(real).withColumn("side", F.explode(sides)).select("*", "side.team", "side.off", "side.other").filter("team is not null and game_id is not null")
    off, dee = F.col("off"), ~F.col("off")
    passing, rushing = F.col("play_type") == "pass", F.col("play_type") == "run"

    def n(*conditions: Column) -> Column:
        both = conditions[0]
        for c in conditions[1:]:
            both = both & c
        return F.count_if(F.coalesce(both, F.lit(False)))

    def add(c: str, *conditions: Column) -> Column:
        return zero(F.sum(F.when(_all(conditions), F.col(c))))

    def mean(c: Column, *conditions: Column) -> Column:
        return F.avg(F.when(_all(conditions), c))

    success = F.coalesce(F.col("success") == 1, F.lit(False)).cast("double")
    is_one = lambda c: F.col(c) == 1
    third, red = F.col("down") == 3, F.col("yardline_100") <= 20
    measures = {
        "season": F.min(F.when(off, F.col("season"))), "week": F.min(F.when(off, F.col("week"))), "opponent": F.min(F.when(off, F.col("other"))),
        "is_home": F.min(F.when(off, (F.col("team") == F.col("home_team")).cast("int"))),
        "plays": n(off), "epa_per_play": mean(F.col("epa"), off), "total_epa": add("epa", off), "success_rate": mean(success, off),
        "pass_attempts": n(off, passing), "rush_attempts": n(off, rushing), "pass_yards": add("yards_gained", off, passing), "rush_yards": add("yards_gained", off, rushing),
        "pass_epa": F.when(n(off, passing) > 0, mean(F.col("epa"), off, passing)).otherwise(0.0), "rush_epa": F.when(n(off, rushing) > 0, mean(F.col("epa"), off, rushing)).otherwise(0.0),
        "interceptions": n(off, is_one("interception")), "sacks": n(off, is_one("sack")), "fumbles": n(off, is_one("fumble")), "fumbles_lost": n(off, is_one("fumble_lost")), "first_downs": n(off, is_one("first_down")),
        "third_down_attempts": n(off, third), "third_down_conversions": n(off, third, is_one("first_down")), "red_zone_plays": n(off, red), "red_zone_tds": n(off, red, is_one("touchdown")),
        "total_yards": add("yards_gained", off),
        "def_rows": n(dee), "def_total_yards": add("yards_gained", dee), "def_pass_yards": add("yards_gained", dee, passing), "def_rush_yards": add("yards_gained", dee, rushing),
        "def_yards_per_play": F.when(n(dee) > 0, mean(F.col("yards_gained"), dee)).otherwise(0.0), "def_epa_per_play": F.when(n(dee) > 0, -mean(F.col("epa"), dee)).otherwise(0.0),
        "def_success_rate": F.when(n(dee) > 0, 1 - mean(success, dee)).otherwise(0.0), "def_interceptions": n(dee, is_one("interception")), "def_sacks": n(dee, is_one("sack")),
        "def_fumbles_lost": n(dee, is_one("fumble_lost")),
    }
    stats = rows.groupBy("game_id", "team").agg(*[c.alias(name) for name, c in measures.items()]).filter("plays > 0")
    rate = lambda a, b: F.coalesce(safe_ratio(F.col(a), F.col(b)), F.lit(0.0))
    return stats.select(
        "*",
        (F.col("interceptions") + F.col("fumbles_lost")).alias("turnovers"), (F.col("def_interceptions") + F.col("def_fumbles_lost")).alias("def_turnovers"),
        rate("total_yards", "plays").alias("yards_per_play"), rate("third_down_conversions", "third_down_attempts").alias("third_down_rate"),
        rate("red_zone_tds", "red_zone_plays").alias("redzone_td_rate"), rate("sacks", "pass_attempts").alias("sack_rate"), F.lit(0).alias("time_of_possession_sec"),
    ).drop("def_rows", "def_fumbles_lost")


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


OFFENCE = (
    "passing_epa", "rushing_epa", "receiving_epa", "passing_yards", "rushing_yards", "receiving_yards", "attempts", "completions", "carries", "sacks", "interceptions",
    "passing_first_downs", "rushing_first_downs", "receiving_first_downs", "rushing_fumbles_lost", "receiving_fumbles_lost", "sack_fumbles_lost", "passing_tds", "rushing_tds", "receiving_tds",
)
DEFENCE = (
    "passing_epa", "rushing_epa", "receiving_epa", "passing_yards", "rushing_yards", "receiving_yards", "attempts", "carries", "sacks", "interceptions",
    "rushing_fumbles_lost", "receiving_fumbles_lost", "sack_fumbles_lost",
)


def team_weeks(player_weeks: DataFrame, season_type: str | None = "REG") -> DataFrame:
    """Sums of player rows by (team, season, week): what the team did, and as def_* what its opponents' players did to it.

    Both groupings come from one pass: every player row stands once under its
    team and once under its opponent. Teams without own rows are left out; sums
    of nothing are 0 on the offensive side and null on the defensive one.
    """
    rows = player_weeks if season_type is None else player_weeks.filter(F.col("season_type") == season_type)
    sides = F.array(F.struct(F.col("recent_team").alias("team"), F.lit(True).alias("own")), F.struct(F.col("opponent_team").alias("team"), F.lit(False).alias("own")))
    rows = rows.withColumn("side", F.explode(sides)).select("*", "side.team", "side.own").dropna(subset=["team", "season", "week"])
    own = F.col("own")
    sums = rows.groupBy("team", "season", "week").agg(
        F.count_if(own).alias("__own"), F.count_if(~own).alias("__def"),
        *[zero(F.sum(F.when(own, F.col(c)))).alias(c) for c in OFFENCE],
        *[F.sum(F.when(~own, zero(F.col(c)))).alias(f"def_{c}") for c in DEFENCE],
    )
    return sums.filter("__own > 0").drop("__own", "__def")


def team_week_features(sums: DataFrame) -> DataFrame:
    """Totals, rates, proxies and the turnover differential from team_weeks. A rate with divisor 0 is null and so is what is made from it."""
    c = F.col
    totals = sums.select(
        "*",
        total(c("passing_epa"), c("rushing_epa"), c("receiving_epa")).alias("total_epa"), total(c("passing_yards"), c("rushing_yards"), c("receiving_yards")).alias("total_yards"),
        total(c("attempts"), c("carries")).alias("total_plays"), total(c("passing_first_downs"), c("rushing_first_downs"), c("receiving_first_downs")).alias("total_first_downs"),
        total(c("interceptions"), c("rushing_fumbles_lost"), c("receiving_fumbles_lost"), c("sack_fumbles_lost")).alias("total_turnovers"),
        total(c("passing_tds"), c("rushing_tds"), c("receiving_tds")).alias("total_tds"), zero(c("sacks")).alias("sacks_allowed"),
        total(c("def_passing_epa"), c("def_rushing_epa"), c("def_receiving_epa")).alias("epa_allowed"), total(c("def_passing_yards"), c("def_rushing_yards"), c("def_receiving_yards")).alias("yards_allowed"),
        total(c("def_attempts"), c("def_carries")).alias("plays_faced"), total(c("def_interceptions"), c("def_rushing_fumbles_lost"), c("def_receiving_fumbles_lost"), c("def_sack_fumbles_lost")).alias("turnovers_forced"),
        zero(c("def_sacks")).alias("sacks_made"),
    )
    rates = totals.select(
        "*", safe_ratio(c("total_epa"), c("total_plays")).alias("epa_per_play"), safe_ratio(c("total_yards"), c("total_plays")).alias("yards_per_play"),
        safe_ratio(c("epa_allowed"), c("plays_faced")).alias("def_epa_per_play"), safe_ratio(c("yards_allowed"), c("plays_faced")).alias("def_yards_per_play"),
        (c("turnovers_forced") - c("total_turnovers")).alias("turnover_diff"),
    )
    return rates.select(
        "*", clip((c("epa_per_play") + 0.1) * 10, 0.0, 1.0).alias("success_proxy"), clip(safe_ratio(c("total_first_downs"), c("total_plays") * 0.3), 0.0, 1.0).alias("third_down_proxy"),
        clip(c("total_tds") / 2.5, 0.0, 1.0).alias("red_zone_proxy"),
    )


def player_rates(player_weeks: DataFrame) -> DataFrame:
    """Efficiency, completion share and sack rate of each player row."""
    c = F.col
    return player_weeks.select(
        "*", safe_ratio(c("passing_epa"), c("attempts")).alias("epa_rate"), safe_ratio(c("completions"), c("attempts")).alias("completion_pct"),
        safe_ratio(c("sacks"), c("attempts") + c("sacks")).alias("player_sack_rate"),
    )
