"""Pairwise ratings folded over events in time order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SCALE, STEP = 1500.0, 400.0, 20.0


def elo(events: DataFrame, pool: str, time: str = "date", key: str = "game_id", home: str = "home_team", away: str = "away_team", home_score: str = "home_score", away_score: str = "away_score") -> DataFrame:
    """(pool, key, home_elo, away_elo): both ratings before each event.

    Expected score 1 / (1 + 10^(-(home - away) / 400)); a win moves 20 times the
    surprise from one side to the other; an event without scores moves nothing.
    Ratings of a pool depend on each other, so a pool is one task's work and pools
    run side by side. Spark sorts the rows and spills them; the task holds one
    batch of them and the ratings of one pool.
    """
    small = events.select(F.col(pool).alias("pool"), F.col(key).alias("key"), F.col(time).alias("time"), F.col(home).alias("home"), F.col(away).alias("away"), F.col(home_score).cast("double").alias("hs"), F.col(away_score).cast("double").alias("as_"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool_now, rating = object(), {}
        for rows in batches:
            before = []
            for p, h, a, hs, as_ in zip(rows["pool"], rows["home"], rows["away"], rows["hs"], rows["as_"], strict=True):
                p = None if p is None or p != p else p
                if p != pool_now:
                    pool_now, rating = p, {}
                rh, ra = rating.get(h, START), rating.get(a, START)
                before.append((rh, ra))
                if hs == hs and as_ == as_ and hs is not None and as_ is not None:
                    won = 1.0 if hs > as_ else 0.0 if hs < as_ else 0.5
                    moved = STEP * (won - 1 / (1 + 10 ** (-(rh - ra) / SCALE)))
                    rating[h] = rh + moved
                    rating[a] = rating.get(a, START) - moved
            yield pd.DataFrame({"pool": rows["pool"].to_numpy(), "key": rows["key"].to_numpy(), "home_elo": [b[0] for b in before], "away_elo": [b[1] for b in before]})

    types = dict(events.dtypes)
    ordered = small.repartition("pool").sortWithinPartitions("pool", F.col("time").asc_nulls_last(), F.col("key").asc_nulls_last())
    folded = ordered.mapInPandas(fold, f"pool {types[pool]}, key {types[key]}, home_elo double, away_elo double")
    return folded.select(F.col("pool").alias(pool), F.col("key").alias(key), "home_elo", "away_elo")


def with_rating_features(df: DataFrame) -> DataFrame:
    return df.select("*", (F.col("home_elo") - F.col("away_elo")).alias("elo_diff"), F.try_divide("home_elo", "away_elo").alias("elo_ratio"))
