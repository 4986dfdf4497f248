"""The driver's tables seen as paired events, in Spark and, as CTEs, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairframe.sources import counts, looked_up, pieces

TEAMS = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(spark: SparkSession, d: str) -> dict[str, int]:
    return counts({t: table(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier")})


def _orders(spark: SparkSession, d: str, rows: dict[str, int]) -> DataFrame:
    """Orders with their customer's nation, dealt out by their key like the lines."""
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    found = looked_up(table(spark, d, "orders"), customers, "o_custkey", "c_custkey", rows["orders"], rows["customer"])
    return found.repartition(pieces(spark, rows["lineitem"]), "o_orderkey")


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", "s_nationkey")


def matches(spark: SparkSession, d: str) -> DataFrame:
    """Orders as events: customer's nation at home, nation of the first line's supplier away; scores are quantities of even and odd lines.

    Lines and orders are dealt out by the order in pieces of a fixed size, so
    what is worked out by event needs no other shuffle.
    """
    even, rows = F.col("l_linenumber") % 2 == 0, _rows(spark, d)
    lines = table(spark, d, "lineitem").repartition(pieces(spark, rows["lineitem"]), "l_orderkey").groupBy("l_orderkey").agg(
        F.min_by("l_suppkey", F.struct("l_linenumber", "l_suppkey")).alias("l_suppkey"),
        F.sum(F.when(even, F.col("l_quantity"))).alias("home_score"), F.sum(F.when(~even, F.col("l_quantity"))).alias("away_score"),
    )
    games = _orders(spark, d, rows).join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    games = looked_up(games, _suppliers(spark, d), "l_suppkey", "s_suppkey", rows["orders"], rows["supplier"])
    return games.select(
        F.col("o_orderkey").alias("game_id"), F.col("o_orderdate").alias("date"), F.year("o_orderdate").alias("season"),
        F.floor((F.dayofyear("o_orderdate") - 1) / 7).cast("int").alias("_w"), F.col("o_orderpriority").alias("pool"),
        F.col("c_nationkey").alias("home_team"), F.col("s_nationkey").alias("away_team"), "home_score", "away_score", F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"),
    ).withColumn("week", F.col("_w") + 1).drop("_w").filter("home_team <> away_team")


MATCHES = """
m_lines AS (
  SELECT l_orderkey, first(l_suppkey ORDER BY l_linenumber, l_suppkey) AS l_suppkey,
         sum(l_quantity) FILTER (WHERE l_linenumber % 2 = 0) AS home_score, sum(l_quantity) FILTER (WHERE l_linenumber % 2 <> 0) AS away_score
  FROM lineitem GROUP BY l_orderkey),
matches AS (
  SELECT o_orderkey AS game_id, o_orderdate AS date, CAST(year(o_orderdate) AS INT) AS season, CAST((dayofyear(o_orderdate) - 1) // 7 + 1 AS INT) AS week,
         o_orderpriority AS pool, c_nationkey AS home_team, s_nationkey AS away_team, home_score, away_score, o_totalprice AS price, o_orderstatus AS status
  FROM orders JOIN m_lines ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey)"""

#: Heights of the venues that lie high, by their name.
ALTITUDES = {"1-URGENT": 5280, "2-HIGH": 4500}


def match_context(spark: SparkSession, d: str, found: DataFrame | None = None) -> DataFrame:
    """matches (or those found before) with venue, surface, roof, kick-off, temperature, wind, spread and odds, all made of an order's own figures; some are missing."""
    c = F.col
    some = lambda k, value: F.when(c("game_id") % k != 0, value)
    return (matches(spark, d) if found is None else found).select(
        "*", c("pool").alias("venue"), F.when(c("status") == "O", "grass").when(c("status") == "F", "FieldTurf").alias("surface"), F.when(c("game_id") % 3 == 0, "dome").when(c("game_id") % 3 == 1, "outdoors").alias("roof"),
        (c("date") + F.make_dt_interval(hours=(c("game_id") % 24).cast("int"))).alias("kickoff"), some(13, (c("price") % 100)).cast("double").alias("temp"), some(11, (c("game_id") % 27)).cast("double").alias("wind"),
        some(7, c("game_id") % 29 - 14).cast("string").alias("spread_line"), some(5, c("game_id") % 601 - 300).cast("string").alias("odds"),
    )


SIDES = """
sides AS (
  SELECT game_id, date, season, week, pool, 1 AS is_home, home_team AS team, away_team AS opponent, home_score AS points_for, away_score AS points_against FROM matches
  UNION ALL
  SELECT game_id, date, season, week, pool, 0, away_team, home_team, away_score, home_score FROM matches)"""


def plays(spark: SparkSession, d: str) -> DataFrame:
    """Lines as plays between the nations of supplier (null for some) and customer, dealt out by their order as ``matches`` are."""
    rows = _rows(spark, d)
    lines = looked_up(table(spark, d, "lineitem"), _suppliers(spark, d), "l_suppkey", "s_suppkey", rows["lineitem"], rows["supplier"])
    lines = lines.repartition(pieces(spark, rows["lineitem"]), "l_orderkey").join(_orders(spark, d, rows), F.col("l_orderkey") == F.col("o_orderkey"))
    one = lambda sql: F.expr(f"cast({sql} as int)")
    return lines.select(
        F.col("l_orderkey").alias("game_id"), F.year("o_orderdate").alias("season"), one("floor((dayofyear(o_orderdate) - 1) / 7) + 1").alias("week"),
        F.expr("case l_returnflag when 'R' then 'run' when 'A' then 'pass' else 'other' end").alias("play_type"),
        F.when(F.col("l_suppkey") % 17 != 0, F.col("s_nationkey")).alias("posteam"), F.col("c_nationkey").alias("defteam"), F.col("c_nationkey").alias("home_team"), F.col("s_nationkey").alias("away_team"),
        F.when(F.col("l_partkey") % 19 != 0, F.col("l_quantity")).alias("yards_gained"), F.when(F.col("l_orderkey") % 23 != 0, F.col("l_discount") - F.col("l_tax")).alias("epa"),
        one("l_linestatus = 'F'").alias("success"), F.col("l_linenumber").alias("down"), one("l_orderkey % 11 = 0").alias("interception"), one("l_partkey % 7 = 0").alias("sack"),
        one("l_partkey % 13 = 0").alias("fumble"), one("l_partkey % 26 = 0").alias("fumble_lost"), one("l_quantity >= 10").alias("first_down"),
        one("l_partkey % 100").alias("yardline_100"), one("l_suppkey % 9 = 0").alias("touchdown"),
    )


PLAYS = """
plays AS (
  SELECT l_orderkey AS game_id, CAST(year(o_orderdate) AS INT) AS season, CAST((dayofyear(o_orderdate) - 1) // 7 + 1 AS INT) AS week,
         CASE l_returnflag WHEN 'R' THEN 'run' WHEN 'A' THEN 'pass' ELSE 'other' END AS play_type,
         CASE WHEN l_suppkey % 17 <> 0 THEN s_nationkey END AS posteam, c_nationkey AS defteam, c_nationkey AS home_team, s_nationkey AS away_team,
         CASE WHEN l_partkey % 19 <> 0 THEN l_quantity END AS yards_gained, CASE WHEN l_orderkey % 23 <> 0 THEN l_discount - l_tax END AS epa,
         (l_linestatus = 'F')::INT AS success, l_linenumber AS down, (l_orderkey % 11 = 0)::INT AS interception, (l_partkey % 7 = 0)::INT AS sack,
         (l_partkey % 13 = 0)::INT AS fumble, (l_partkey % 26 = 0)::INT AS fumble_lost, (l_quantity >= 10)::INT AS first_down,
         (l_partkey % 100)::INT AS yardline_100, (l_suppkey % 9 = 0)::INT AS touchdown
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

#: Measures of a player row: name -> an expression that both dialects read alike.
PLAYER_MEASURES = {
    "passing_epa": "l_discount", "rushing_epa": "l_tax", "receiving_epa": "CASE WHEN l_partkey % 5 <> 0 THEN l_discount - l_tax END",
    "passing_yards": "l_quantity", "rushing_yards": "CAST(l_linenumber AS DOUBLE)", "receiving_yards": "CASE WHEN l_partkey % 7 <> 0 THEN l_quantity END",
    "attempts": "CAST(l_partkey % 6 AS DOUBLE)", "completions": "CAST(l_partkey % 3 AS DOUBLE)", "carries": "CAST(l_suppkey % 4 AS DOUBLE)",
    "sacks": "CAST(l_suppkey % 3 AS DOUBLE)", "interceptions": "CAST(l_partkey % 2 AS DOUBLE)", "passing_first_downs": "CAST(l_linenumber % 3 AS DOUBLE)",
    "rushing_first_downs": "CAST(l_suppkey % 2 AS DOUBLE)", "receiving_first_downs": "CAST(l_partkey % 4 AS DOUBLE)", "rushing_fumbles_lost": "CAST(l_orderkey % 2 AS DOUBLE)",
    "receiving_fumbles_lost": "CAST(l_orderkey % 3 AS DOUBLE)", "sack_fumbles_lost": "CASE WHEN l_orderkey % 5 = 0 THEN 1.0 END", "passing_tds": "CAST(l_linenumber % 2 AS DOUBLE)",
    "rushing_tds": "CAST(l_suppkey % 5 AS DOUBLE)", "receiving_tds": "CAST(l_partkey % 8 AS DOUBLE)",
}


def player_weeks(spark: SparkSession, d: str) -> DataFrame:
    """Lines as player rows: part, its type as position, supplier's nation as team, customer's as opponent."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    lines = lines.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(
        F.col("l_partkey").alias("player_id"), F.col("p_type").alias("position"), F.when(F.col("l_suppkey") % 29 != 0, F.col("s_nationkey")).alias("recent_team"), F.col("c_nationkey").alias("opponent_team"),
        F.year("l_shipdate").alias("season"), F.expr("cast(floor((dayofyear(l_shipdate) - 1) / 7) + 1 as int)").alias("week"),
        F.when(F.col("l_linenumber") == 7, "POST").otherwise("REG").alias("season_type"), F.col("l_orderkey").alias("row_key"), F.col("l_linenumber").alias("row_line"), F.col("l_suppkey").alias("row_supp"), F.col("l_extendedprice").alias("row_price"),
        *[F.expr(sql).cast("double").alias(name) for name, sql in PLAYER_MEASURES.items()],
    )


PLAYER_WEEKS = f"""
player_weeks AS (
  SELECT l_partkey AS player_id, p_type AS position, CASE WHEN l_suppkey % 29 <> 0 THEN s_nationkey END AS recent_team, c_nationkey AS opponent_team,
         CAST(year(l_shipdate) AS INT) AS season, CAST((dayofyear(l_shipdate) - 1) // 7 + 1 AS INT) AS week,
         CASE WHEN l_linenumber = 7 THEN 'POST' ELSE 'REG' END AS season_type, l_orderkey AS row_key, l_linenumber AS row_line, l_suppkey AS row_supp, l_extendedprice AS row_price,
         {", ".join(f"CAST({sql} AS DOUBLE) AS {name}" for name, sql in PLAYER_MEASURES.items())}
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"""


def status_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as status reports of players; some are null."""
    status = "case event_type when 'purchase' then 'active' when 'view' then 'probable' when 'click' then 'questionable' when 'error' then 'doubtful' when 'signup' then 'out' end"
    return table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("player_id"), (F.col("user_id") % TEAMS).cast("int").alias("team"), F.col("ts").alias("date"),
        F.when(F.col("event_id") % 7 != 0, F.expr(status)).alias("status"),
    )


STATUS_LOG = """
status_log AS (
  SELECT event_id, user_id AS player_id, CAST(user_id % 25 AS INT) AS team, ts AS date,
         CASE WHEN event_id % 7 <> 0 THEN CASE event_type WHEN 'purchase' THEN 'active' WHEN 'view' THEN 'probable' WHEN 'click' THEN 'questionable' WHEN 'error' THEN 'doubtful' WHEN 'signup' THEN 'out' END END AS status
  FROM events)"""


def player_values(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").select(F.col("user_id").alias("player_id")).distinct()
    return users.filter("player_id % 5 <> 0").select("player_id", (1 + F.col("player_id") % 9).cast("double").alias("value"))


PLAYER_VALUES = """
player_values AS (SELECT DISTINCT user_id AS player_id, CAST(1 + user_id % 9 AS DOUBLE) AS value FROM events WHERE user_id % 5 <> 0)"""


def status_games(spark: SparkSession, d: str, found: DataFrame | None = None) -> DataFrame:
    """Matches (or those found before) moved to the days that the status log covers."""
    day = "cast(timestamp_ntz '2024-01-01 12:00:00' as timestamp_ntz) + make_dt_interval(cast(datediff(date, date '1995-01-01') % 30 as int))"
    return (matches(spark, d) if found is None else found).withColumn("date", F.expr(day))


STATUS_GAMES = """
status_games AS (
  SELECT * REPLACE (TIMESTAMP '2024-01-01 12:00:00' + to_days(CAST(date_diff('day', DATE '1995-01-01', CAST(date AS DATE)) % 30 AS INT)) AS date) FROM matches)"""


def with_views(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes)
