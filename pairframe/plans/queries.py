"""Registered queries: every operator applied to the driver's whole tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairframe import functions as fn
from pairframe import sources
from pairframe.operators import aggregates, asof, evaluate, form, lagged, latest, models, quality, ratings, reshape, score, split
from pairframe.plans import views as v

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ORDER = ["date", "game_id"]
M, S = v.MATCHES, v.SIDES


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            ORACLES[query.__name__] = sql
        return query

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of additions doesn't show."""
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def off_ties(df: DataFrame, digits: int = 6) -> DataFrame:
    """Rounded, a little off the ties on which means of short decimals fall and which engines round apart by their order of additions."""
    return rounded(df.select([(F.col(c) + 1e-9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]), digits)


def spans(spark: SparkSession, d: str) -> lagged.Blocks:
    """Blocks of lagged statistics: few teams with many rows each are dealt out by spans of 90 days, or of fewer where a span of all teams would have more rows than a task holds."""
    orders = v.table(spark, d, "orders")
    days, n = form.span(orders, "o_orderdate", sources.PIECE), orders.count()
    return lagged.Blocks(lagged.time_block("date", days), sources.pieces(spark, 2 * n))


def sides(spark: SparkSession, d: str) -> DataFrame:
    return reshape.match_sides(v.matches(spark, d), ("game_id", "date", "season", "week", "pool"))


# --- reshaping, keys, outcomes


@register(v.with_views(M, S) + "SELECT game_id, team, opponent, is_home, points_for, points_against FROM sides")
def q_sides(spark: SparkSession, d: str) -> DataFrame:
    return sides(spark, d).select("game_id", "team", "opponent", "is_home", "points_for", "points_against")


@register(v.with_views(M, S) + "SELECT DISTINCT team FROM sides")
def q_teams(spark: SparkSession, d: str) -> DataFrame:
    return reshape.teams(v.matches(spark, d))


@register(v.with_views(M) + "SELECT game_id, season || '_' || lpad(week::VARCHAR, 2, '0') || '_' || home_team || '_' || away_team AS event_key FROM matches")
def q_key(spark: SparkSession, d: str) -> DataFrame:
    return sources.with_event_key(v.matches(spark, d), "event_key").select("game_id", "event_key")


@register(v.with_views(M) + "SELECT game_id, coalesce(home_score > away_score, false)::INT AS home_win, home_score - away_score AS point_diff, home_score + away_score AS total_points FROM matches")
def q_outcomes(spark: SparkSession, d: str) -> DataFrame:
    m = v.matches(spark, d)
    return m.select("game_id", *[c.alias(n) for n, c in fn.outcome(F.col("home_score"), F.col("away_score")).items()])


@register(v.with_views(M) + "SELECT game_id, season, week, price, 1 AS home_flag, 500 AS away_travel_distance, 0 AS home_travel_distance, 0.85 AS special_teams_rate FROM matches WHERE season IN (1996, 1997)")
def q_seasons_defaults(spark: SparkSession, d: str) -> DataFrame:
    m = sources.of_seasons(v.matches(spark, d), (1996, 1997)).select("game_id", "season", "week", "price")
    return sources.ensure_columns(m, {"price": 0.0, "home_flag": 1, "away_travel_distance": 500, "home_travel_distance": 0, "special_teams_rate": 0.85})


@register(v.with_views(M) + "SELECT game_id, home_team, away_team FROM matches WHERE home_score IS NULL AND season = 1997 AND week = 10")
def q_upcoming(spark: SparkSession, d: str) -> DataFrame:
    return sources.upcoming(v.matches(spark, d), 1997, 10, "home_score").select("game_id", "home_team", "away_team")


# --- lagged statistics


@register(
    v.with_views(M, S) + """, g AS (SELECT *, coalesce(date_diff('hour', lag(date) OVER (PARTITION BY team ORDER BY date, game_id), date) // 24, 7) AS rest FROM sides),
    wide AS (SELECT game_id, max(rest) FILTER (WHERE is_home = 1) AS home_rest_days, max(rest) FILTER (WHERE is_home = 0) AS away_rest_days FROM g GROUP BY game_id)
    SELECT *, home_rest_days - away_rest_days AS rest_days_diff, (home_rest_days > away_rest_days)::INT AS rest_advantage_home,
           (home_rest_days < 7)::INT AS short_week_home, (away_rest_days < 7)::INT AS short_week_away FROM wide"""
)
def q_gap_days(spark: SparkSession, d: str) -> DataFrame:
    gaps = lagged.gap_days(sides(spark, d), ["team"], ORDER, "date", block=spans(spark, d))
    wide = reshape.widen(gaps, "game_id", ["rest_days"])
    home, away = F.col("home_rest_days"), F.col("away_rest_days")
    return wide.select(
        "*", (home - away).alias("rest_days_diff"), fn.flag(home > away).alias("rest_advantage_home"), fn.flag(home < 7).alias("short_week_home"), fn.flag(away < 7).alias("short_week_away")
    )


def _frames(columns: list[str], windows: list[int], table: str, entity: str, order: str) -> str:
    one = "round(avg({c}) OVER (PARTITION BY {e} ORDER BY {o} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING), 6) AS {c}_r{k}"
    return ", ".join(one.format(c=c, k=k, e=entity, o=order) for c in columns for k in windows) + f" FROM {table}"


@register(v.with_views(M, S) + "SELECT game_id, team, " + _frames(["points_for", "points_against"], [1, 3, 5, 10], "sides", "team", "date, game_id"))
def q_rolling(spark: SparkSession, d: str) -> DataFrame:
    rolled = lagged.rolling_mean(sides(spark, d), ["team"], ORDER, ["points_for", "points_against"], block=spans(spark, d))
    return rounded(rolled.select("game_id", "team", *[c for c in rolled.columns if "_r" in c and c.startswith("points")]))


def _expanding(partition: str) -> str:
    over = f"OVER (PARTITION BY {partition} ORDER BY date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return v.with_views(M, S) + f"SELECT game_id, team, round(avg(points_for) {over} + 1e-9, 6) AS points_for_avg, round(avg(points_against) {over} + 1e-9, 6) AS points_against_avg FROM sides"


@register(_expanding("team"))
def q_expanding(spark: SparkSession, d: str) -> DataFrame:
    out = lagged.expanding_mean(sides(spark, d), ["team"], ORDER, ["points_for", "points_against"], block=spans(spark, d))
    return off_ties(out.select("game_id", "team", "points_for_avg", "points_against_avg"))


@register(_expanding("team, season"))
def q_expanding_reset(spark: SparkSession, d: str) -> DataFrame:
    out = lagged.expanding_mean(sides(spark, d), ["team"], ORDER, ["points_for", "points_against"], ["season"], block=spans(spark, d))
    return off_ties(out.select("game_id", "team", "points_for_avg", "points_against_avg"))


@register(v.with_views(M, S) + "SELECT game_id, team, lag(points_for) OVER (PARTITION BY team ORDER BY date, game_id) AS points_for_prev FROM sides")
def q_previous(spark: SparkSession, d: str) -> DataFrame:
    return lagged.previous(sides(spark, d), ["team"], ORDER, ["points_for"], block=spans(spark, d)).select("game_id", "team", "points_for_prev")


@register(
    v.with_views(M, S) + """, n AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY date, game_id) AS rn FROM sides),
    f AS (SELECT team, rn, game_id, NULL::DOUBLE AS before, points_for::DOUBLE AS y, CASE WHEN points_for IS NOT NULL THEN 1.0::DOUBLE END AS w FROM n WHERE rn = 1
          UNION ALL
          SELECT n.team, n.rn, n.game_id, f.y,
                 CASE WHEN n.points_for IS NULL THEN f.y WHEN f.y IS NULL THEN n.points_for ELSE (f.w * (2.0::DOUBLE / 3) * f.y + n.points_for * (1.0::DOUBLE / 3)) / (f.w * (2.0::DOUBLE / 3) + 1.0::DOUBLE / 3) END,
                 CASE WHEN n.points_for IS NOT NULL THEN 1.0::DOUBLE WHEN f.y IS NULL THEN NULL ELSE f.w * (2.0::DOUBLE / 3) END
          FROM f JOIN n ON n.team = f.team AND n.rn = f.rn + 1)
    SELECT game_id, team, round(before, 6) AS points_for_ewma FROM f"""
)
def q_ewma(spark: SparkSession, d: str) -> DataFrame:
    out = lagged.ewma(sides(spark, d), ["team"], ORDER, ["points_for"], lagged.span_alpha(3), block=spans(spark, d))
    return rounded(out.select("game_id", "team", "points_for_ewma"))


_FORM = ["points_for_r3", "points_for_r5", "points_against_r3", "points_against_r5"]


@register(
    v.with_views(M, S) + ", r AS (SELECT game_id, team, is_home, " + _frames(["points_for", "points_against"], [3, 5], "sides", "team", "date, game_id").replace("round(avg", "(avg").replace(", 6) AS", ") AS")
    + ") SELECT h.game_id, h.team AS home_team, a.team AS away_team, "
    + ", ".join(f"round(h.{c}, 6) AS home_{c}, round(a.{c}, 6) AS away_{c}, round(h.{c} - a.{c}, 6) AS diff_{c}, round(abs(h.{c} - a.{c}), 6) AS abs_diff_{c}" for c in _FORM)
    + " FROM r h JOIN r a USING (game_id) WHERE h.is_home = 1 AND a.is_home = 0"
)
def q_basic_form(spark: SparkSession, d: str) -> DataFrame:
    """Each side's recent form before every event, and the difference."""
    m = v.matches(spark, d)
    rolled = lagged.rolling_mean(reshape.match_sides(m), ["team"], ORDER, ["points_for", "points_against"], (3, 5), spans(spark, d))
    both = reshape.attach_both_sides(m.select("game_id", "home_team", "away_team"), rolled, ["game_id"], _FORM)
    return rounded(fn.pair_differences(both, exclude=["team"]).select("game_id", "home_team", "away_team", *[f"{p}_{c}" for p in ("home", "away", "diff", "abs_diff") for c in _FORM]))


# --- aggregation

_PLAY_SQL = v.with_views(v.PLAYS) + """, real AS (SELECT * FROM plays WHERE play_type IN ('run', 'pass')),
o AS (SELECT game_id, posteam AS team, min(season) AS season, min(week) AS week, min(defteam) AS opponent, min((posteam = home_team)::INT) AS is_home, count(*) AS plays, avg(epa) AS epa_per_play,
  coalesce(sum(epa), 0) AS total_epa, avg(coalesce(success = 1, false)::INT) AS success_rate, count(*) FILTER (WHERE play_type = 'pass') AS pass_attempts, count(*) FILTER (WHERE play_type = 'run') AS rush_attempts,
  coalesce(sum(yards_gained) FILTER (WHERE play_type = 'pass'), 0) AS pass_yards, coalesce(sum(yards_gained) FILTER (WHERE play_type = 'run'), 0) AS rush_yards,
  CASE WHEN count(*) FILTER (WHERE play_type = 'pass') > 0 THEN avg(epa) FILTER (WHERE play_type = 'pass') ELSE 0 END AS pass_epa,
  CASE WHEN count(*) FILTER (WHERE play_type = 'run') > 0 THEN avg(epa) FILTER (WHERE play_type = 'run') ELSE 0 END AS rush_epa,
  count(*) FILTER (WHERE interception = 1) AS interceptions, count(*) FILTER (WHERE sack = 1) AS sacks, count(*) FILTER (WHERE fumble = 1) AS fumbles, count(*) FILTER (WHERE fumble_lost = 1) AS fumbles_lost,
  count(*) FILTER (WHERE first_down = 1) AS first_downs, count(*) FILTER (WHERE down = 3) AS third_down_attempts, count(*) FILTER (WHERE down = 3 AND first_down = 1) AS third_down_conversions,
  count(*) FILTER (WHERE yardline_100 <= 20) AS red_zone_plays, count(*) FILTER (WHERE yardline_100 <= 20 AND touchdown = 1) AS red_zone_tds, coalesce(sum(yards_gained), 0) AS total_yards
  FROM real WHERE posteam IS NOT NULL GROUP BY game_id, posteam),
f AS (SELECT game_id, defteam AS team, coalesce(sum(yards_gained), 0) AS def_total_yards, coalesce(sum(yards_gained) FILTER (WHERE play_type = 'pass'), 0) AS def_pass_yards,
  coalesce(sum(yards_gained) FILTER (WHERE play_type = 'run'), 0) AS def_rush_yards, avg(yards_gained) AS def_yards_per_play, -avg(epa) AS def_epa_per_play, 1 - avg(coalesce(success = 1, false)::INT) AS def_success_rate,
  count(*) FILTER (WHERE interception = 1) AS def_interceptions, count(*) FILTER (WHERE sack = 1) AS def_sacks, count(*) FILTER (WHERE interception = 1) + count(*) FILTER (WHERE fumble_lost = 1) AS def_turnovers
  FROM real WHERE defteam IS NOT NULL AND posteam IS DISTINCT FROM defteam GROUP BY game_id, defteam),
stats AS (SELECT o.*, coalesce(def_total_yards, 0) AS def_total_yards, coalesce(def_pass_yards, 0) AS def_pass_yards, coalesce(def_rush_yards, 0) AS def_rush_yards,
  CASE WHEN f.team IS NULL THEN 0 ELSE def_yards_per_play END AS def_yards_per_play, CASE WHEN f.team IS NULL THEN 0 ELSE def_epa_per_play END AS def_epa_per_play,
  CASE WHEN f.team IS NULL THEN 0 ELSE def_success_rate END AS def_success_rate, coalesce(def_interceptions, 0) AS def_interceptions, coalesce(def_sacks, 0) AS def_sacks, coalesce(def_turnovers, 0) AS def_turnovers,
  interceptions + fumbles_lost AS turnovers, total_yards / plays AS yards_per_play, coalesce(third_down_conversions / nullif(third_down_attempts, 0), 0) AS third_down_rate,
  coalesce(red_zone_tds / nullif(red_zone_plays, 0), 0) AS redzone_td_rate, coalesce(sacks / nullif(pass_attempts, 0), 0) AS sack_rate, 0 AS time_of_possession_sec
  FROM o LEFT JOIN f ON o.game_id = f.game_id AND o.team = f.team)"""
_PLAY_COUNTS = ["game_id", "team", "season", "week", "opponent", "is_home", "plays", "pass_attempts", "rush_attempts", "interceptions", "sacks", "fumbles", "fumbles_lost", "first_downs", "third_down_attempts", "third_down_conversions", "red_zone_plays", "red_zone_tds", "def_interceptions", "def_sacks", "def_turnovers", "turnovers", "time_of_possession_sec"]
_PLAY_RATES = ["epa_per_play", "total_epa", "success_rate", "pass_yards", "rush_yards", "pass_epa", "rush_epa", "total_yards", "def_total_yards", "def_pass_yards", "def_rush_yards", "def_yards_per_play", "def_epa_per_play", "def_success_rate", "yards_per_play", "third_down_rate", "redzone_td_rate", "sack_rate"]


@register(_PLAY_SQL + f" SELECT {', '.join(_PLAY_COUNTS)}, {', '.join(f'round({c}::DOUBLE, 6) + 0.0 AS {c}' for c in _PLAY_RATES)} FROM stats")
def q_play_agg(spark: SparkSession, d: str) -> DataFrame:
    stats = aggregates.play_stats(v.plays(spark, d))
    return rounded(stats.select(*_PLAY_COUNTS, *[F.col(c).cast("double").alias(c) for c in _PLAY_RATES]))


@register(
    _PLAY_SQL.replace("WITH RECURSIVE ", "WITH RECURSIVE " + M + ",")
    + """ SELECT s.game_id, s.team, s.plays, CASE WHEN s.team = m.home_team THEN home_score ELSE away_score END AS points_for,
    CASE WHEN s.team = m.home_team THEN away_score ELSE home_score END AS points_against FROM stats s LEFT JOIN matches m ON s.game_id = m.game_id"""
)
def q_play_points(spark: SparkSession, d: str) -> DataFrame:
    stats = aggregates.play_stats(v.plays(spark, d)).select("game_id", "team", "plays")
    return reshape.points_by_side(stats, v.matches(spark, d))


_WEEK_SQL = (
    v.with_views(v.PLAYER_WEEKS) + ", reg AS (SELECT * FROM player_weeks WHERE season_type = 'REG'), o AS (SELECT recent_team AS team, season, week, "
    + ", ".join(f"coalesce(sum({c}), 0) AS {c}" for c in aggregates.OFFENCE) + " FROM reg WHERE recent_team IS NOT NULL GROUP BY ALL), f AS (SELECT opponent_team AS team, season, week, "
    + ", ".join(f"coalesce(sum({c}), 0) AS def_{c}" for c in aggregates.DEFENCE) + " FROM reg WHERE opponent_team IS NOT NULL GROUP BY ALL), w AS (SELECT * FROM o LEFT JOIN f USING (team, season, week))"
)
_WEEK = [*aggregates.OFFENCE, *[f"def_{c}" for c in aggregates.DEFENCE]]


@register(_WEEK_SQL + f" SELECT team, season, week, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _WEEK)} FROM w")
def q_team_week(spark: SparkSession, d: str) -> DataFrame:
    return rounded(aggregates.team_weeks(v.player_weeks(spark, d)).select("team", "season", "week", *_WEEK))


_Z = lambda *c: " + ".join(f"coalesce({x}, 0)" for x in c)
_TOTALS = {
    "total_epa": _Z("passing_epa", "rushing_epa", "receiving_epa"), "total_yards": _Z("passing_yards", "rushing_yards", "receiving_yards"), "total_plays": _Z("attempts", "carries"),
    "total_first_downs": _Z("passing_first_downs", "rushing_first_downs", "receiving_first_downs"), "total_turnovers": _Z("interceptions", "rushing_fumbles_lost", "receiving_fumbles_lost", "sack_fumbles_lost"),
    "total_tds": _Z("passing_tds", "rushing_tds", "receiving_tds"), "sacks_allowed": _Z("sacks"), "epa_allowed": _Z("def_passing_epa", "def_rushing_epa", "def_receiving_epa"),
    "yards_allowed": _Z("def_passing_yards", "def_rushing_yards", "def_receiving_yards"), "plays_faced": _Z("def_attempts", "def_carries"),
    "turnovers_forced": _Z("def_interceptions", "def_rushing_fumbles_lost", "def_receiving_fumbles_lost", "def_sack_fumbles_lost"), "sacks_made": _Z("def_sacks"),
}
_RATES = {
    "epa_per_play": "total_epa / nullif(total_plays, 0)", "yards_per_play": "total_yards / nullif(total_plays, 0)", "def_epa_per_play": "epa_allowed / nullif(plays_faced, 0)",
    "def_yards_per_play": "yards_allowed / nullif(plays_faced, 0)", "turnover_diff": "turnovers_forced - total_turnovers",
}
_PROXIES = {
    "success_proxy": "CASE WHEN epa_per_play IS NOT NULL THEN least(greatest((epa_per_play + 0.1) * 10, 0), 1) END",
    "third_down_proxy": "CASE WHEN total_plays <> 0 THEN least(greatest(total_first_downs / (total_plays * 0.3), 0), 1) END",
    "red_zone_proxy": "least(greatest(total_tds / 2.5, 0), 1)",
}
_FEATURES = [*_TOTALS, *_RATES, *_PROXIES]


@register(
    _WEEK_SQL + ", t AS (SELECT *, " + ", ".join(f"{sql} AS {n}" for n, sql in _TOTALS.items()) + " FROM w), r AS (SELECT *, " + ", ".join(f"{sql} AS {n}" for n, sql in _RATES.items())
    + " FROM t), p AS (SELECT *, " + ", ".join(f"{sql} AS {n}" for n, sql in _PROXIES.items()) + f" FROM r) SELECT team, season, week, {', '.join(f'round({c}::DOUBLE, 6) + 0.0 AS {c}' for c in _FEATURES)} FROM p"
)
def q_team_week_features(spark: SparkSession, d: str) -> DataFrame:
    made = aggregates.team_week_features(aggregates.team_weeks(v.player_weeks(spark, d)))
    return rounded(made.select("team", "season", "week", *[F.col(c).cast("double").alias(c) for c in _FEATURES]))


_PLAYER_ORDER = ["season", "week", "row_key", "row_line", "row_supp", "row_price", "passing_yards"]


@register(
    v.with_views(v.PLAYER_WEEKS) + ", e AS (SELECT *, passing_epa / nullif(attempts, 0) AS epa_rate, completions / nullif(attempts, 0) AS completion_pct, sacks / nullif(attempts + sacks, 0) AS player_sack_rate FROM player_weeks) SELECT player_id, row_key, row_line, "
    + _frames(["epa_rate", "completion_pct", "player_sack_rate"], [3, 5], "e", "player_id", ", ".join(_PLAYER_ORDER))
)
def q_player_trend(spark: SparkSession, d: str) -> DataFrame:
    rates = aggregates.player_rates(v.player_weeks(spark, d))
    trend = lagged.rolling_mean(rates, ["player_id"], _PLAYER_ORDER, ["epa_rate", "completion_pct", "player_sack_rate"], (3, 5))
    return rounded(trend.select("player_id", "row_key", "row_line", *[f"{c}_r{k}" for c in ("epa_rate", "completion_pct", "player_sack_rate") for k in (3, 5)]))


_STARTER = "(-attempts, row_key, row_line, row_supp, row_price, player_id, passing_yards)"
_STARTER_ORDER = "attempts DESC, row_key, row_line, row_supp, row_price, player_id, passing_yards"


def _starter_order() -> list[Column]:
    return [-F.col("attempts"), *[F.col(c) for c in ("row_key", "row_line", "row_supp", "row_price", "player_id", "passing_yards")]]


@register(
    v.with_views(v.PLAYER_WEEKS)
    + f" SELECT recent_team, season, week, first(player_id ORDER BY {_STARTER_ORDER}) AS player_id, first(receiving_epa ORDER BY {_STARTER_ORDER}) FILTER (WHERE receiving_epa IS NOT NULL) AS receiving_epa, first(sack_fumbles_lost ORDER BY {_STARTER_ORDER}) FILTER (WHERE sack_fumbles_lost IS NOT NULL) AS sack_fumbles_lost FROM player_weeks WHERE recent_team IS NOT NULL GROUP BY ALL"
)
def q_starter(spark: SparkSession, d: str) -> DataFrame:
    rows = v.player_weeks(spark, d).dropna(subset=["recent_team"])
    return latest.first_non_null_by(rows, ["recent_team", "season", "week"], _starter_order(), ["player_id", "receiving_epa", "sack_fumbles_lost"])


@register(
    v.with_views(v.PLAYER_WEEKS)
    + f" SELECT recent_team, season, week, player_id, receiving_epa, sack_fumbles_lost FROM player_weeks WHERE recent_team IS NOT NULL QUALIFY row_number() OVER (PARTITION BY recent_team, season, week ORDER BY {_STARTER_ORDER}) = 1"
)
def q_starter_strict(spark: SparkSession, d: str) -> DataFrame:
    rows = v.player_weeks(spark, d).dropna(subset=["recent_team"])
    return latest.first_row_by(rows, ["recent_team", "season", "week"], _starter_order(), ["player_id", "receiving_epa", "sack_fumbles_lost"])


# --- state as of an event

_LOSS = """CASE status WHEN 'probable' THEN 0.1 WHEN 'questionable' THEN 0.5 WHEN 'doubtful' THEN 0.8 WHEN 'out' THEN 1.0 ELSE 0.0 END"""


@register(
    v.with_views(M, v.STATUS_GAMES, S.replace("FROM matches", "FROM status_games"), v.STATUS_LOG, v.PLAYER_VALUES)
    + f""", days AS (SELECT DISTINCT team, date FROM sides),
    held AS (SELECT days.team, days.date, l.player_id, arg_max(status, (l.date, event_id)) FILTER (WHERE status IS NOT NULL) AS status
             FROM days JOIN status_log l ON l.team = days.team AND l.date <= days.date GROUP BY ALL),
    valued AS (SELECT held.*, coalesce(value, median(value) OVER (PARTITION BY team, date), 1.0) AS worth FROM held LEFT JOIN player_values USING (player_id)),
    lost AS (SELECT team, date, sum({_LOSS} * worth) AS impact FROM valued GROUP BY ALL)
    SELECT game_id, sides.team, round(coalesce(impact, 0)::DOUBLE, 6) AS impact FROM sides LEFT JOIN lost ON sides.team = lost.team AND sides.date = lost.date"""
)
def q_asof_score(spark: SparkSession, d: str) -> DataFrame:
    games = reshape.match_sides(v.status_games(spark, d)).select("game_id", "team", "date")
    return rounded(asof.loss_score(games, v.status_log(spark, d), v.player_values(spark, d)))


# --- ratings

_ELO = (
    M + """, eg AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY date, game_id) AS rn FROM matches),
ef AS (SELECT pool, 0::BIGINT AS rn, NULL::BIGINT AS game_id, NULL::DOUBLE AS home_elo, NULL::DOUBLE AS away_elo, list_transform(range(25), lambda x: 1500.0::DOUBLE) AS s FROM (SELECT DISTINCT pool FROM eg)
  UNION ALL
  SELECT pool, rn, game_id, h, a, CASE WHEN won IS NULL THEN s ELSE list_transform(s, lambda r, i: CASE WHEN i = home_team + 1 THEN r + 20 * (won - 1 / (1 + pow(10::DOUBLE, -(h - a) / 400))) WHEN i = away_team + 1 THEN r - 20 * (won - 1 / (1 + pow(10::DOUBLE, -(h - a) / 400))) ELSE r END) END
  FROM (SELECT g.pool, g.rn, g.game_id, g.home_team, g.away_team, s, s[home_team + 1] AS h, s[away_team + 1] AS a,
               CASE WHEN home_score > away_score THEN 1.0::DOUBLE WHEN home_score < away_score THEN 0.0 WHEN home_score = away_score THEN 0.5 END AS won
        FROM ef JOIN eg g ON g.pool = ef.pool AND g.rn = ef.rn + 1)),
elo AS (SELECT pool, game_id, home_elo, away_elo FROM ef WHERE rn > 0),
scored AS (SELECT m.*, home_elo, away_elo, home_elo - away_elo AS elo_diff, 1 / (1 + pow(10::DOUBLE, -(home_elo - away_elo) / 400)) AS probability,
  coalesce(home_score > away_score, false)::INT AS label, (1 / (1 + pow(10::DOUBLE, -(home_elo - away_elo) / 400)) > 0.5)::INT AS prediction FROM matches m JOIN elo USING (game_id))"""
)


def rated(spark: SparkSession, d: str) -> DataFrame:
    """Matches with ratings, outcome and the rating's own forecast."""
    m = v.matches(spark, d)
    r = ratings.with_rating_features(m.join(ratings.elo(m, "pool").drop("pool"), "game_id"))
    p = score.elo_probability(F.col("elo_diff"))
    return r.select("*", p.alias("probability"), fn.flag(F.col("home_score") > F.col("away_score")).alias("label"), (p > 0.5).cast("int").alias("prediction"))


@register("WITH RECURSIVE " + _ELO + " SELECT game_id, pool, round(home_elo, 6) AS home_elo, round(away_elo, 6) AS away_elo, round(elo_diff, 6) AS elo_diff, round(home_elo / away_elo, 6) AS elo_ratio FROM scored")
def q_elo(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rated(spark, d).select("game_id", "pool", "home_elo", "away_elo", "elo_diff", "elo_ratio"))


@register("WITH RECURSIVE " + _ELO + " SELECT avg((label = 1)::INT) AS home_accuracy, avg((label = (elo_diff > 0)::INT)::INT) AS rating_accuracy FROM scored")
def q_elo_baseline(spark: SparkSession, d: str) -> DataFrame:
    r = rated(spark, d).select("label", F.lit(1).alias("home"), (F.col("elo_diff") > 0).cast("int").alias("by_rating"))
    return r.agg(F.avg((F.col("label") == F.col("home")).cast("double")).alias("home_accuracy"), F.avg((F.col("label") == F.col("by_rating")).cast("double")).alias("rating_accuracy"))


# --- flags, bands, labels, probabilities


@register("""SELECT p_partkey, coalesce(p_type ILIKE '%brass%', false)::INT AS brass, coalesce(p_type ILIKE '%STEEL%', false)::INT AS steel, coalesce(p_brand IN ('Brand#11', 'Brand#12'), false)::INT AS is_dome, coalesce(p_brand = 'Brand#21', false)::INT AS is_outdoors FROM part""")
def q_flags(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "part").select(
        "p_partkey", fn.contains_flag(F.col("p_type"), "brass").alias("brass"), fn.contains_flag(F.col("p_type"), "STEEL").alias("steel"),
        fn.member_flag(F.col("p_brand"), ["Brand#11", "Brand#12"]).alias("is_dome"), fn.flag(F.col("p_brand") == "Brand#21").alias("is_outdoors"),
    )


@register("""SELECT event_id, hour(ts)::INT AS hour, (hour(ts) >= 20 OR hour(ts) < 12)::INT AS prime_time, (hour(ts) >= 13 AND hour(ts) < 17)::INT AS afternoon, (hour(ts) >= 17)::INT AS evening FROM events""")
def q_bands(spark: SparkSession, d: str) -> DataFrame:
    hour = F.hour("ts")
    return v.table(spark, d, "events").select("event_id", hour.alias("hour"), *[c.alias(n) for n, c in fn.time_bands(hour).items()])


_WEATHER = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity * 2 AS temp, CASE WHEN l_partkey % 11 <> 0 THEN l_suppkey % 25 END AS wind, (l_linestatus = 'F')::INT AS dome FROM lineitem"
_LABEL = "CASE WHEN wind > 15 THEN 'windy' WHEN temp > 80 THEN 'hot' WHEN temp < 32 THEN 'cold' ELSE 'normal' END"
_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _weather(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "lineitem").select(
        *_KEYS, (F.col("l_quantity") * 2).alias("temp"), F.when(F.col("l_partkey") % 11 != 0, F.col("l_suppkey") % 25).alias("wind"), (F.col("l_linestatus") == "F").cast("int").alias("dome")
    )


@register(
    f"WITH w AS ({_WEATHER}) SELECT {', '.join(_KEYS)}, (temp < 32)::INT AS cold_weather, (temp > 80)::INT AS hot_weather, coalesce(wind > 15, false)::INT AS windy, coalesce(wind > 20, false)::INT AS very_windy, (dome = 0 AND temp < 40)::INT AS precip_flag, (wind IS NULL)::INT AS wind_missing, {_LABEL} AS weather_desc FROM w"
)
def q_labels(spark: SparkSession, d: str) -> DataFrame:
    flags = fn.weather_flags(F.col("temp"), F.col("wind"), F.col("dome"))
    label = fn.first_label([(F.col("wind") > 15, "windy"), (F.col("temp") > 80, "hot"), (F.col("temp") < 32, "cold")], "normal")
    return _weather(spark, d).select(*_KEYS, *[c.alias(n) for n, c in flags.items()], F.col("wind").isNull().cast("int").alias("wind_missing"), label.alias("weather_desc"))


@register(f"WITH w AS (SELECT *, {_LABEL} AS label FROM ({_WEATHER})) SELECT {', '.join(_KEYS)}, " + ", ".join(f"label = '{k}' AS weather_{k}" for k in ("normal", "cold", "hot", "windy")) + " FROM w")
def q_one_hot(spark: SparkSession, d: str) -> DataFrame:
    label = fn.first_label([(F.col("wind") > 15, "windy"), (F.col("temp") > 80, "hot"), (F.col("temp") < 32, "cold")], "normal")
    return _weather(spark, d).select(*_KEYS, *[c.alias(n) for n, c in fn.one_hot(label, ["normal", "cold", "hot", "windy"], "weather").items()])


@register("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 5280 WHEN '2-HIGH' THEN 4500 ELSE 0 END AS altitude, (o_orderpriority IN ('1-URGENT', '2-HIGH'))::INT AS high_altitude FROM orders")
def q_map_lookup(spark: SparkSession, d: str) -> DataFrame:
    altitude = fn.lookup(F.col("o_orderpriority"), {"1-URGENT": 5280, "2-HIGH": 4500}, 0)
    return v.table(spark, d, "orders").select("o_orderkey", altitude.alias("altitude"), fn.flag(altitude > 4000).alias("high_altitude"))


@register("""WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_custkey % 29 - 14)::DOUBLE END AS spread, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_custkey % 601 - 300)::DOUBLE END AS odds FROM orders)
SELECT o_orderkey, coalesce(spread, 0) AS spread_line, (coalesce(spread, 0) < 0)::INT AS favourite, abs(coalesce(spread, 0)) AS abs_spread,
round(least(greatest(0.5 + coalesce(spread, 0) / 28, 0), 1), 6) AS implied, round(CASE WHEN odds > 0 THEN 100 / (odds + 100) WHEN odds < 0 THEN -odds / (100 - odds) ELSE 0.5 END, 6) AS moneyline_prob FROM x""")
def q_line_probs(spark: SparkSession, d: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    x = v.table(spark, d, "orders").select("o_orderkey", F.when(key % 7 != 0, cust % 29 - 14).cast("double").alias("spread"), F.when(key % 5 != 0, cust % 601 - 300).cast("double").alias("odds"))
    spread = F.coalesce("spread", F.lit(0.0))
    return rounded(x.select("o_orderkey", spread.alias("spread_line"), fn.flag(spread < 0).alias("favourite"), F.abs(spread).alias("abs_spread"), fn.line_probability(spread).alias("implied"), fn.moneyline_probability(F.col("odds")).alias("moneyline_prob")))


@register("""WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'abc' WHEN o_orderkey % 3 = 1 THEN o_custkey::VARCHAR END AS raw FROM orders)
SELECT o_orderkey, TRY_CAST(raw AS DOUBLE) AS value, (TRY_CAST(raw AS DOUBLE) IS NULL)::INT AS value_missing FROM x""")
def q_numeric_coerce(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    raw = F.when(key % 3 == 0, "abc").when(key % 3 == 1, F.col("o_custkey").cast("string"))
    x = v.table(spark, d, "orders").select("o_orderkey", fn.number(raw).alias("value"))
    return x.select("*", F.col("value").isNull().cast("int").alias("value_missing"))


@register("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(l_quantity * l_discount, 6) AS rest_x_epa, round(l_tax * l_discount, 6) AS wind_x_pass FROM lineitem")
def q_interactions(spark: SparkSession, d: str) -> DataFrame:
    li = v.table(spark, d, "lineitem").select(*_KEYS, "l_quantity", "l_discount", "l_tax")
    made = fn.interactions(li, [("l_quantity", "l_discount", "rest_x_epa"), ("l_tax", "l_discount", "wind_x_pass"), ("l_tax", "absent", "never")])
    return rounded(made.drop("l_quantity", "l_discount", "l_tax"))


@register("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity AS qb_epa, l_quantity / 2 AS wr_yards, l_quantity * 2 AS line_rate FROM lineitem")
def q_derived(spark: SparkSession, d: str) -> DataFrame:
    li, q = v.table(spark, d, "lineitem").select(*_KEYS, "l_quantity"), F.col("l_quantity")
    rules = {"qb_epa": (("l_quantity",), q), "wr_yards": (("l_quantity",), q / 2), "line_rate": (("l_quantity",), q * 2), "never": (("absent",), q)}
    return fn.derived(li, rules).drop("l_quantity")


@register(_PLAY_SQL + " SELECT game_id, team, round(coalesce(epa_per_play, (yards_per_play - 4) / 10 + 0.1 * success_rate)::DOUBLE, 6) + 0.0 AS epa_filled FROM stats")
def q_proxy_fill(spark: SparkSession, d: str) -> DataFrame:
    stats = aggregates.play_stats(v.plays(spark, d))
    return rounded(stats.select("game_id", "team", F.coalesce("epa_per_play", fn.proxy_efficiency(F.col("yards_per_play"), F.col("success_rate"))).alias("epa_filled")))


# --- data quality


@register(
    v.with_views(M) + """, md AS (SELECT median(home_score) AS h, median(away_score) AS a FROM matches)
    SELECT game_id, coalesce(home_score, h) AS home_score, coalesce(away_score, a) AS away_score, coalesce(nullif(status, 'P'), 'missing') AS status,
    (home_score IS NULL)::INT AS home_score_missing, (away_score IS NULL)::INT AS away_score_missing, (nullif(status, 'P') IS NULL)::INT AS status_missing FROM matches, md"""
)
def q_impute(spark: SparkSession, d: str) -> DataFrame:
    m = v.matches(spark, d).select("game_id", "home_score", "away_score", F.nullif("status", F.lit("P")).alias("status"))
    return quality.impute(m, ["home_score", "away_score", "status"])


@register(
    v.with_views(M) + """, tr AS (SELECT median(home_score) AS h FROM matches WHERE season <= 1997)
    SELECT game_id, coalesce(home_score, h) AS home_score FROM matches, tr"""
)
def q_impute_train(spark: SparkSession, d: str) -> DataFrame:
    m = v.matches(spark, d).select("game_id", "season", "home_score")
    return quality.impute(m, ["home_score"], fit_on=F.col("season") <= 1997, flags=False).drop("season")


_PROFILED = ["home_score", "away_score", "price", "week", "pool"]


@register(
    v.with_views(M) + " " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, '{t}' AS dtype, count(*) FILTER (WHERE {c} IS NULL) AS missing, round(count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) AS missing_share, "
        + (", ".join(f"round({f}({c})::DOUBLE, 4) AS {n}" for n, f in (("min", "min"), ("max", "max"), ("mean", "avg"), ("median", "median"))) if t != "string" else "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean, NULL::DOUBLE AS median")
        + " FROM matches"
        for c, t in (("home_score", "double"), ("away_score", "double"), ("price", "double"), ("week", "int"), ("pool", "string"))
    )
)
def q_profile(spark: SparkSession, d: str) -> DataFrame:
    p = quality.profile(v.matches(spark, d), _PROFILED)
    return p.select("feature", "dtype", "missing", F.round("missing_share", 6).alias("missing_share"), *[F.round(c, 4).alias(c) for c in ("min", "max", "mean", "median")])


@register(
    v.with_views(M) + ", c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL) AS missing, count(*) AS n FROM matches" for c in ("home_score", "away_score", "price"))
    + ") SELECT feature, missing, round(missing / n, 6) AS missing_share FROM c WHERE missing > 0 ORDER BY missing DESC, feature LIMIT 10"
)
def q_missing_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.missing_report(v.matches(spark, d), ["home_score", "away_score", "price"]))


@register(
    v.with_views(M, v.PLAYS) + """, a AS (SELECT DISTINCT game_id FROM matches), b AS (SELECT DISTINCT game_id FROM plays WHERE play_type <> 'other')
    SELECT (SELECT count(*) FROM a) AS left_keys, (SELECT count(*) FROM b) AS right_keys, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS in_both,
    (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS left_only, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS right_only"""
)
def q_key_coverage(spark: SparkSession, d: str) -> DataFrame:
    return quality.key_coverage(v.matches(spark, d), v.plays(spark, d).filter("play_type <> 'other'"), ["game_id"])


_AUDIT = v.with_views(M, S) + """, n AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY date, game_id) AS rn FROM sides),
    f AS (SELECT team, rn, avg(points_for) OVER (PARTITION BY team ORDER BY date, game_id ROWS BETWEEN {frame}) AS feature FROM n),
    again AS (SELECT a.team, a.rn, avg(b.points_for) AS mean FROM n a LEFT JOIN n b ON b.team = a.team AND b.rn < a.rn AND b.rn >= a.rn - 3 GROUP BY a.team, a.rn)
    SELECT team, count(*) AS n_rows, count(*) FILTER (WHERE rn = 1) AS n_first,
           count(*) FILTER (WHERE NOT coalesce(abs(feature - mean) < 1e-9, feature IS NULL AND mean IS NULL)) AS n_leaks FROM f JOIN again USING (team, rn) GROUP BY team"""


@register(_AUDIT.replace("{frame}", "3 PRECEDING AND 1 PRECEDING"))
def q_leak_audit(spark: SparkSession, d: str) -> DataFrame:
    rolled = lagged.rolling_mean(reshape.match_sides(v.matches(spark, d)), ["team"], ORDER, ["points_for"], (3,), spans(spark, d))
    return quality.leak_audit(rolled, "team", ORDER, "points_for", "points_for_r3", 3)


@register(_AUDIT.replace("{frame}", "2 PRECEDING AND CURRENT ROW"))
def q_leak_found(spark: SparkSession, d: str) -> DataFrame:
    """The audit over a feature whose frame takes in the event itself."""
    own = F.avg("points_for").over(Window.partitionBy("team").orderBy(*ORDER).rowsBetween(-2, 0))
    leaky = reshape.match_sides(v.matches(spark, d)).withColumn("leaky", own)
    return quality.leak_audit(leaky, "team", ORDER, "points_for", "leaky", 3)


_PATTERNS = {"score": ["score"], "team": ["team"], "time": ["season", "week", "date"]}
_CHECKED = ["home_score", "away_score", "home_team", "away_team", "season", "week", "price"]


@register(
    v.with_views(M) + "SELECT count(*) AS n_rows, 7 AS n_features, round((" + " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in _CHECKED)
    + ") / (count(*) * 7), 6) AS missing_share, 2 AS n_score, 2 AS n_team, 2 AS n_time FROM matches"
)
def q_missing_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.missing_summary(v.matches(spark, d), _CHECKED, _PATTERNS))


@register(v.with_views(M) + ", f AS (SELECT avg(price) AS mp, stddev_pop(price) AS sp, avg(home_score) AS mh, stddev_pop(home_score) AS sh FROM matches WHERE season <= 1998) SELECT game_id, round((price - mp) / sp, 6) AS price, round((home_score - mh) / sh, 6) AS home_score FROM matches, f")
def q_standardised(spark: SparkSession, d: str) -> DataFrame:
    m = v.matches(spark, d).select("game_id", "season", "price", "home_score")
    return rounded(quality.standardised(m, ["price", "home_score"], F.col("season") <= 1998).drop("season"))


@register(v.with_views(M) + "SELECT game_id, coalesce(try_cast(status AS DOUBLE), 0) AS status, coalesce(home_score::DOUBLE, 0) AS home_score, price::DOUBLE AS price FROM matches")
def q_matrix(spark: SparkSession, d: str) -> DataFrame:
    return models.as_numbers(v.matches(spark, d).select("game_id", "status", "home_score", "price"), ["status", "home_score", "price"])


@register(v.with_views(M) + "SELECT game_id, home_team, away_team, price, season, week FROM matches WHERE home_score IS NOT NULL AND away_score IS NOT NULL")
def q_labelled_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a target, without the excluded columns."""
    m = v.matches(spark, d).dropna(subset=["home_score", "away_score"])
    return m.select(*sources.feature_names(m, ["date", "pool", "status", "home_score", "away_score"]))


@register(v.with_views(M) + "SELECT game_id, home_team FROM matches WHERE home_team IN (SELECT c_nationkey FROM customer WHERE c_acctbal < -950)")
def q_one_side(spark: SparkSession, d: str) -> DataFrame:
    poor = v.table(spark, d, "customer").filter("c_acctbal < -950").select(F.col("c_nationkey").alias("team"))
    return reshape.events_of(v.matches(spark, d), poor, "home_team").select("game_id", "home_team")


# --- files


@register(v.with_views(M) + "SELECT game_id, season, week, home_team, away_team, home_score, away_score, pool FROM matches")
def q_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Chosen columns written as CSV and read again."""
    path = sources.scratch_path(spark, "matches.csv")
    columns = ["game_id", "season", "week", "home_team", "away_team", "home_score", "away_score", "pool"]
    m = v.matches(spark, d)
    sources.write_table(m, path, columns)
    return sources.read_table(spark, path, m.select(columns).schema)


@register(v.with_views(M) + "SELECT game_id, season, week, pool, price FROM matches WHERE season IN (1996, 1998)")
def q_season_partitions(spark: SparkSession, d: str) -> DataFrame:
    """A table written by season; only the files of the seasons asked for are read."""
    path = sources.scratch_path(spark, "matches.parquet")
    sources.write_table(v.matches(spark, d), path, ["game_id", "week", "pool", "price", "season"], partition_by=("season",))
    return sources.of_seasons(sources.read_table(spark, path), (1996, 1998)).select("game_id", "season", "week", "pool", "price")


@register(v.with_views(M) + "SELECT game_id, home_score, NULL::DOUBLE AS home_value FROM matches")
def q_optional_table(spark: SparkSession, d: str) -> DataFrame:
    """A left join with a table that may be absent, and is."""
    values = sources.read_optional(spark, sources.scratch_path(spark, "absent.parquet"), "team int, home_value double")
    return v.matches(spark, d).join(values, F.col("home_team") == F.col("team"), "left").select("game_id", "home_score", "home_value")


@register(ORACLES["q_profile"])
def q_profile_file(spark: SparkSession, d: str) -> DataFrame:
    """The profile written as JSON and read again."""
    path = sources.scratch_path(spark, "profile.json")
    profile = q_profile(spark, d)
    sources.write_profile(profile, path)
    return spark.read.schema(profile.schema).json(path)


# --- enrichment of both sides

PLAY_MEASURES = [
    "points_for", "points_against", "total_yards", "pass_yards", "rush_yards", "yards_per_play", "epa_per_play", "def_epa_per_play", "success_rate", "def_success_rate", "turnovers", "def_turnovers",
    "third_down_rate", "redzone_td_rate", "sacks", "def_sacks", "sack_rate", "interceptions", "def_interceptions",
]
_PLAY_WINDOWS = (1, 3, 5, 10)
_PLAY_FORM = [f"{c}_r{k}" for c in PLAY_MEASURES for k in _PLAY_WINDOWS]


def play_sides(spark: SparkSession, d: str, found: DataFrame | None = None) -> DataFrame:
    """One row per side of every match with its play statistics, null where no play was seen, and its points."""
    m = v.matches(spark, d) if found is None else found
    stats = aggregates.play_stats(v.plays(spark, d)).select("game_id", "team", *[F.col(c).cast("double").alias(c) for c in PLAY_MEASURES[2:]])
    return reshape.match_sides(m).join(stats, ["game_id", "team"], "left")


@register(
    _PLAY_SQL.replace("WITH RECURSIVE ", "WITH RECURSIVE " + M + "," + S + ",") + ", b AS (SELECT sides.game_id, date, sides.team, sides.is_home, points_for, points_against, "
    + ", ".join(f"stats.{c}::DOUBLE AS {c}" for c in PLAY_MEASURES[2:]) + " FROM sides LEFT JOIN stats ON sides.game_id = stats.game_id AND sides.team = stats.team), r AS (SELECT game_id, is_home, "
    + _frames(PLAY_MEASURES, list(_PLAY_WINDOWS), "b", "team", "date, game_id").replace("round(avg", "(avg").replace(", 6) AS", ") AS")
    + ") SELECT h.game_id, " + ", ".join(f"round(h.{c} + 1e-9, 5) + 0.0 AS home_{c}, round(a.{c} + 1e-9, 5) + 0.0 AS away_{c}" for c in _PLAY_FORM) + " FROM r h JOIN r a ON h.game_id = a.game_id WHERE h.is_home = 1 AND a.is_home = 0"
)
def q_play_form(spark: SparkSession, d: str) -> DataFrame:
    """Rolling means of all play measures, on both sides of every match; the wide rows are made where they are returned."""
    m = sources.written(v.matches(spark, d).select("game_id", "date", "home_team", "away_team", "home_score", "away_score"), "matches")
    both = reshape.widen(play_sides(spark, d, m), "game_id", PLAY_MEASURES)
    seen = sources.written(m.drop("home_score", "away_score").join(both, "game_id"), "seen")
    made = form.Form(tuple(ORDER), "date", tuple(PLAY_MEASURES), _PLAY_WINDOWS, alpha=None, days=form.span(seen, "date"))
    formed = made.attach(seen, made.states(seen))
    return off_ties(formed.select("game_id", *[f"{p}_{c}" for p in ("home", "away") for c in _PLAY_FORM]), 5)


WEEK_METRICS = ["epa_per_play", "yards_per_play", "success_proxy", "third_down_proxy", "red_zone_proxy", "turnover_diff", "def_epa_per_play", "def_yards_per_play", "total_epa", "sacks_allowed"]
STARTER_RATES = ["epa_rate", "completion_pct", "player_sack_rate"]
WEEK_FORM = [*[f"{c}_r{k}" for c in WEEK_METRICS for k in (3, 5)], *[f"{c}_avg" for c in WEEK_METRICS[:8]]]
STARTER_FORM = [f"{c}_r{k}" for c in STARTER_RATES for k in (3, 5)]


def week_form(spark: SparkSession, d: str) -> DataFrame:
    """(team, season, week) with trends and means of all earlier weeks."""
    weeks = aggregates.team_week_features(aggregates.team_weeks(v.player_weeks(spark, d)))
    trend = lagged.rolling_mean(weeks, ["team"], ["season", "week"], WEEK_METRICS, (3, 5), F.col("season"))
    return lagged.expanding_mean(trend, ["team"], ["season", "week"], WEEK_METRICS[:8], block=F.col("season"))


def starters(spark: SparkSession, d: str) -> DataFrame:
    """(team, season, week) with the trends of the player with most attempts."""
    own = lagged.rolling_mean(aggregates.player_rates(v.player_weeks(spark, d)), ["player_id"], _PLAYER_ORDER, STARTER_RATES, (3, 5)).dropna(subset=["recent_team"])
    return latest.first_non_null_by(own, ["recent_team", "season", "week"], _starter_order(), STARTER_FORM).withColumnRenamed("recent_team", "team")


def with_weeks(m: DataFrame, weeks: DataFrame, columns: Sequence[str]) -> DataFrame:
    """m with both sides' figures of its week, of which there is one row a team and week: written once for the two sides, and broadcast, so that the matches are not shuffled for them."""
    return reshape.attach_both_sides(m, F.broadcast(sources.written(weeks.select("team", "season", "week", *columns), "weeks")), ["season", "week"], columns)


_TREND_SQL = (
    _WEEK_SQL + ", t AS (SELECT *, " + ", ".join(f"{sql} AS {n}" for n, sql in _TOTALS.items()) + " FROM w), tr AS (SELECT *, " + ", ".join(f"{sql} AS {n}" for n, sql in _RATES.items())
    + " FROM t), tp AS (SELECT *, " + ", ".join(f"{sql} AS {n}" for n, sql in _PROXIES.items()) + " FROM tr), trend AS (SELECT team, season, week, "
    + ", ".join(f"avg({c}) OVER (PARTITION BY team ORDER BY season, week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS {c}_avg" for c in WEEK_METRICS[:8]) + ", "
    + _frames(WEEK_METRICS, [3, 5], "tp", "team", "season, week").replace("round(avg", "(avg").replace(", 6) AS", ") AS") + ")"
    + ", e AS (SELECT *, passing_epa / nullif(attempts, 0) AS epa_rate, completions / nullif(attempts, 0) AS completion_pct, sacks / nullif(attempts + sacks, 0) AS player_sack_rate FROM player_weeks), ef AS (SELECT *, "
    + _frames(STARTER_RATES, [3, 5], "e", "player_id", ", ".join(_PLAYER_ORDER)).replace("round(avg", "(avg").replace(", 6) AS", ") AS") + "), starter AS (SELECT recent_team AS team, season, week, "
    + ", ".join(f"first({c} ORDER BY {_STARTER_ORDER}) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in STARTER_FORM) + " FROM ef WHERE recent_team IS NOT NULL GROUP BY ALL)"
)


_WEEK_SIDES_SQL = _TREND_SQL.replace("WITH RECURSIVE ", "WITH RECURSIVE " + M + ",")
_WEEK_SIDES_FROM = " FROM matches m " + " ".join(f"LEFT JOIN {table} {t} ON {t}.team = m.{side} AND {t}.season = m.season AND {t}.week = m.week" for side, ts in (("home_team", ("ht", "hs")), ("away_team", ("at_", "as_"))) for t, table in zip(ts, ("trend", "starter"), strict=True))
_WEEK_SIDES = {f"{p}_{c}": f"{t}.{c}" for p, ts in (("home", ("ht", "hs")), ("away", ("at_", "as_"))) for t, cs in zip(ts, (WEEK_FORM, STARTER_FORM), strict=True) for c in cs}
#: Matches with team weeks and starters on both sides, gaps filled with exact medians.
TEAM_WEEK_TABLE = (
    _WEEK_SIDES_SQL + ", base AS (SELECT m.*, " + ", ".join(f"{x} AS {n}" for n, x in _WEEK_SIDES.items()) + _WEEK_SIDES_FROM
    + ") SELECT game_id, date, season, week, pool, home_team, away_team, status, " + ", ".join(f"round({c} + 1e-9, 5) AS {c}" for c in ("home_score", "away_score", "price")) + ", "
    + ", ".join(f"round(coalesce({n}, median({n}) OVER (), 0) + 1e-9, 5) + 0.0 AS {n}" for n in _WEEK_SIDES) + " FROM base"
)


@register(_WEEK_SIDES_SQL + " SELECT m.game_id, " + ", ".join(f"round({x} + 1e-9, 5) + 0.0 AS {n}" for n, x in _WEEK_SIDES.items()) + _WEEK_SIDES_FROM)
def q_week_sides(spark: SparkSession, d: str) -> DataFrame:
    """Team weeks and starters on both sides of every match of that season and week."""
    m = v.matches(spark, d).select("game_id", "season", "week", "home_team", "away_team")
    both = with_weeks(m, week_form(spark, d), WEEK_FORM)
    both = with_weeks(both, starters(spark, d), STARTER_FORM)
    return off_ties(both.drop("season", "week", "home_team", "away_team"), 5)


@register(v.with_views(M, S) + "SELECT game_id, team, " + _frames(["points_for", "points_against"], [3], "sides", "team", "date, game_id"))
def q_clean_features(spark: SparkSession, d: str) -> DataFrame:
    """Without what the event itself brought."""
    rolled = lagged.rolling_mean(sides(spark, d), ["team"], ORDER, ["points_for", "points_against"], (3,), spans(spark, d))
    clean = quality.drop_same_event(rolled, ["points_for", "points_against"], prefixes=("",))
    return rounded(clean.drop("date", "season", "week", "pool", "opponent", "is_home"))


# --- splits, metrics, scoring


@register(
    v.with_views(M) + """, s AS (SELECT season, dense_rank() OVER (ORDER BY season DESC) AS k FROM (SELECT DISTINCT season FROM matches))
    SELECT game_id, CASE WHEN k <= 2 THEN 'test' WHEN k = 3 THEN 'val' ELSE 'train' END AS split FROM matches JOIN s USING (season)"""
)
def q_split_season(spark: SparkSession, d: str) -> DataFrame:
    return split.split_by_season(v.matches(spark, d)).select("game_id", "split")


_FEW = v.with_views(M) + """, n AS (SELECT game_id, season, row_number() OVER (ORDER BY date, game_id) - 1 AS i, count(*) OVER () AS n, row_number() OVER (PARTITION BY season ORDER BY date, game_id) - 1 AS j, count(*) OVER (PARTITION BY season) AS m FROM matches WHERE season IN ({seasons}))
    SELECT game_id, {split} AS split FROM n"""


@register(_FEW.format(seasons="1996, 1997, 1998", split="CASE season WHEN 1996 THEN 'train' WHEN 1997 THEN 'val' ELSE 'test' END"))
def q_split_three(spark: SparkSession, d: str) -> DataFrame:
    return split.split_by_season(sources.of_seasons(v.matches(spark, d), (1996, 1997, 1998))).select("game_id", "split")


@register(_FEW.format(seasons="1996, 1997", split="CASE WHEN season = 1997 THEN 'test' WHEN j < CAST(floor(0.70::DOUBLE * m) AS BIGINT) THEN 'train' ELSE 'val' END"))
def q_split_two(spark: SparkSession, d: str) -> DataFrame:
    return split.split_by_season(sources.of_seasons(v.matches(spark, d), (1996, 1997))).select("game_id", "split")


@register(_FEW.format(seasons="1996", split="CASE WHEN i < CAST(floor(0.70::DOUBLE * n) AS BIGINT) THEN 'train' WHEN i < CAST(floor((0.70::DOUBLE + 0.15::DOUBLE) * n) AS BIGINT) THEN 'val' ELSE 'test' END"))
def q_split_one(spark: SparkSession, d: str) -> DataFrame:
    return split.split_by_season(sources.of_seasons(v.matches(spark, d), (1996,))).select("game_id", "split")


@register(
    v.with_views(M) + """, n AS (SELECT game_id, row_number() OVER (ORDER BY date, game_id) - 1 AS i, count(*) OVER () AS n FROM matches)
    SELECT game_id, CASE WHEN i < CAST(floor(0.70::DOUBLE * n) AS BIGINT) THEN 'train' WHEN i < CAST(floor((0.70::DOUBLE + 0.15::DOUBLE) * n) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM n"""
)
def q_split_position(spark: SparkSession, d: str) -> DataFrame:
    return split.split_by_position(v.matches(spark, d), "date", "game_id").select("game_id", "split")


_AUC = """(SELECT sum(CASE WHEN label = 1 THEN rk END) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2
  FROM (SELECT label, rank() OVER (ORDER BY probability) + (count(*) OVER (PARTITION BY probability) - 1) / 2 AS rk FROM r)) / ((SELECT count(*) FROM r WHERE label = 1) * (SELECT count(*) FROM r WHERE label = 0))"""
_R = "WITH RECURSIVE " + _ELO + ", r AS (SELECT game_id, label, prediction, round(probability, 6) AS probability FROM scored)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return rated(spark, d).select("game_id", "label", "prediction", F.round("probability", 6).alias("probability"))


@register(
    _R + f""" SELECT round(avg((label = prediction)::INT), 6) AS accuracy, round(avg(-ln(least(greatest(CASE WHEN label = 1 THEN probability ELSE 1 - probability END, 1e-15), 1 - 1e-15))), 6) AS log_loss, round({_AUC}, 6) AS auc FROM r"""
)
def q_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.metrics(_scored(spark, d)))


@register(_R + f" SELECT round({_AUC}, 6) AS auc")
def q_auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.auc(_scored(spark, d)))


@register(_R + " SELECT a AS actual, p AS predicted, (SELECT count(*) FROM r WHERE label = a AND prediction = p) AS n FROM (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(p)")
def q_confusion(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion(_scored(spark, d))


@register(
    _R + """, k AS (SELECT c, (SELECT count(*) FROM r WHERE label = c AND prediction = c) AS tp, (SELECT count(*) FROM r WHERE prediction = c) AS pp, (SELECT count(*) FROM r WHERE label = c) AS s FROM (VALUES (0), (1)) x(c)),
    q AS (SELECT c, s, coalesce(tp / nullif(pp, 0), 0) AS p, coalesce(tp / nullif(s, 0), 0) AS r FROM k), f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM q)
    SELECT c::VARCHAR AS class, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, s::BIGINT AS support FROM f
    UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), sum(s)::BIGINT FROM f
    UNION ALL SELECT 'weighted avg', round(sum(p * s) / sum(s), 6), round(sum(r * s) / sum(s), 6), round(sum(f1 * s) / sum(s), 6), sum(s)::BIGINT FROM f"""
)
def q_class_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.class_report(_scored(spark, d)))


@register(v.with_views(M, S) + "SELECT team, game_id, is_home, points_for FROM sides QUALIFY row_number() OVER (PARTITION BY team ORDER BY date DESC, game_id DESC, is_home DESC) = 1")
def q_latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return score.snapshot(sides(spark, d), "team", "date", "game_id").select("team", "game_id", "is_home", "points_for")


_FUTURE = (
    "WITH RECURSIVE " + _ELO + """, es AS (SELECT game_id, date, home_team AS team, 1 AS is_home, home_elo AS elo FROM scored WHERE season <= 2000 UNION ALL SELECT game_id, date, away_team, 0, away_elo FROM scored WHERE season <= 2000),
    st AS (SELECT team, elo FROM es QUALIFY row_number() OVER (PARTITION BY team ORDER BY date DESC, game_id DESC, is_home DESC) = 1),
    fu AS (SELECT m.game_id, m.home_team, m.away_team, 1 / (1 + pow(10::DOUBLE, -(coalesce(h.elo, 1500) - coalesce(a.elo, 1500)) / 400)) AS p
           FROM matches m LEFT JOIN st h ON h.team = m.home_team LEFT JOIN st a ON a.team = m.away_team WHERE season > 2000)"""
)


def _future(spark: SparkSession, d: str) -> DataFrame:
    """Events after 2000 scored from each side's last rating up to then."""
    r = rated(spark, d)
    past = r.filter("season <= 2000")
    long = reshape.to_sides(past, ["game_id", "date"], {"team": ("home_team", "away_team"), "elo": ("home_elo", "away_elo")})
    events = v.matches(spark, d).filter("season > 2000").select("game_id", "home_team", "away_team")
    ready = score.with_states(events, score.snapshot(long, "team", "date", "game_id"), ["elo"])
    p = score.elo_probability(F.col("home_elo") - F.col("away_elo"))
    return ready.select("*", *[c.alias(n) for n, c in score.score_columns(p, F.col("home_team"), F.col("away_team")).items()])


@register(_FUTURE + " SELECT game_id, home_team, away_team, round(p, 6) AS home_win_prob, round(1 - p, 6) AS away_win_prob, CASE WHEN p > 0.5 THEN home_team ELSE away_team END AS predicted_winner, round(greatest(p, 1 - p), 6) AS confidence FROM fu")
def q_score_upcoming(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_future(spark, d).drop("home_elo", "away_elo"))


@register(_FUTURE + " SELECT count(*) AS n, round(avg(greatest(p, 1 - p)), 6) AS mean_confidence, count(*) FILTER (WHERE p > 0.5) AS home_wins, count(*) FILTER (WHERE NOT p > 0.5) AS away_wins FROM fu")
def q_score_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(score.summary(_future(spark, d)))
