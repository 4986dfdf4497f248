"""Operators on hand-written rows and by their properties."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from pairframe import functions as fn
from pairframe import sources
from pairframe.operators import aggregates, asof, evaluate, lagged, latest, quality, ratings, reshape, score, split

DAY = lambda n, h=0: dt.datetime(2020, 1, 1) + dt.timedelta(days=n, hours=h)


def one(df):
    return df.first()[0]


@pytest.fixture(scope="module")
def games(spark):
    rows = [(1, DAY(0), "A", "B", 10.0, 7.0), (2, DAY(1), "A", "B", 3.0, 3.0), (3, DAY(8, 23), "B", "C", None, None), (4, DAY(9, 1), "C", "A", 1.0, 2.0), (5, DAY(9, 1), "A", "C", 5.0, 0.0)]
    return spark.createDataFrame(rows, "game_id long, date timestamp_ntz, home_team string, away_team string, home_score double, away_score double").withColumn("pool", F.lit("x"))


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (0.5,), (9.0,)], "x double")
    assert [r[0] for r in df.select(fn.clip(F.col("x"), 0.0, 1.0)).collect()] == [None, 0.0, 0.5, 1.0]


def test_expressions(spark):
    df = spark.createDataFrame([("FieldTurf", "closed", "abc", 150.0), (None, None, "7", -150.0), ("grass", "open", None, 0.0)], "surface string, roof string, temp string, odds double")
    got = df.select(fn.contains_flag(F.col("surface"), "turf"), fn.member_flag(F.col("roof"), ["dome", "closed"]), fn.number(F.col("temp")), F.round(fn.moneyline_probability(F.col("odds")), 4)).collect()
    assert [tuple(r) for r in got] == [(1, 1, None, 0.4), (0, 0, 7.0, 0.6), (0, 0, None, 0.5)]


def test_label_order(spark):
    df = spark.createDataFrame([(25.0, 20.0), (5.0, 20.0), (5.0, 90.0), (5.0, 50.0)], "wind double, temp double")
    label = fn.first_label([(F.col("wind") > 15, "windy"), (F.col("temp") > 80, "hot"), (F.col("temp") < 32, "cold")], "normal")
    assert [r[0] for r in df.select(label).collect()] == ["windy", "cold", "hot", "normal"]


def test_pair_differences_take_the_prefix_only(spark):
    df = spark.createDataFrame([(3.0, 1.0, "x", 5.0, 2.0)], "home_a_home_b double, away_a_home_b double, home_team string, home_only double, away_score double")
    assert {"diff_a_home_b", "abs_diff_a_home_b"} == set(fn.pair_differences(df).columns) - set(df.columns)


def test_gap_floors_spans_of_a_day(games):
    gaps = lagged.gap_days(reshape.match_sides(games), ["team"], ["date", "game_id"], "date")
    got = {(r.game_id, r.team): r.rest_days for r in gaps.collect()}
    assert got[1, "A"] == 7 and got[2, "A"] == 1 and got[4, "C"] == 0 and got[5, "C"] == 0


def test_rolling_of_one_is_the_previous_row(games):
    sides = reshape.match_sides(games)
    got = lagged.previous(lagged.rolling_mean(sides, ["team"], ["date", "game_id"], ["points_for"], (1,)), ["team"], ["date", "game_id"], ["points_for"])
    assert got.filter("not (points_for_r1 <=> points_for_prev)").count() == 0


def test_row_order_and_later_rows_change_nothing(games):
    def form(df):
        out = lagged.ewma(lagged.rolling_mean(reshape.match_sides(df), ["team"], ["date", "game_id"], ["points_for"], (3,)), ["team"], ["date", "game_id"], ["points_for"])
        return {(r.game_id, r.team): (r.points_for_r3, r.points_for_ewma) for r in out.collect()}

    whole = form(games)
    assert form(games.orderBy(F.desc("game_id")).repartition(3)) == whole
    early = form(games.filter("game_id < 5"))
    assert all(whole[k] == v for k, v in early.items())
    changed = form(games.withColumn("home_score", F.when(F.col("game_id") == 5, 99.0).otherwise(F.col("home_score"))))
    assert changed == whole


@pytest.mark.parametrize("alpha", [1 / 3, 0.9, 1.0])
def test_ewma_ages_over_nulls(spark, alpha):
    xs = [None, 4.0, None, None, 1.0, 2.0, None, 8.0]
    df = spark.createDataFrame([("t", i, x) for i, x in enumerate(xs)], "team string, i int, x double")
    got = [r.x_ewma for r in lagged.ewma(df, ["team"], ["i"], ["x"], alpha).orderBy("i").collect()]
    y, w, want = None, 1.0, []
    for x in xs:
        want.append(y)
        if x is not None:
            old = w * (1 - alpha)
            y = x if y is None else (old * y + alpha * x) / (old + alpha)
            w = 1.0
        elif y is not None:
            w *= 1 - alpha
    assert all((a is None and b is None) or math.isclose(a, b) for a, b in zip(got, want, strict=True))


def test_lagged_family_shares_one_exchange(games):
    wide = lagged.rolling_mean(reshape.match_sides(games), ["team"], ["date", "game_id"], ["points_for", "points_against"])
    assert wide._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_elo_folds_batch_by_batch(spark):
    sides = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "b")]
    rows = [(p, k, k // 2, *sides[(k + (p or 0)) % 5], k % 3, 1) for p in (1, 2, None) for k in range(40)]
    events = spark.createDataFrame(rows, "pool long, game_id long, date long, home_team string, away_team string, home_score long, away_score long")
    want, rating = {}, {}
    for p, k, _, h, a, hs, as_ in rows:
        rh, ra = rating.get((p, h), 1500.0), rating.get((p, a), 1500.0)
        want[p, k] = rh, ra
        moved = 20 * ((1.0 if hs > as_ else 0.0 if hs < as_ else 0.5) - 1 / (1 + 10 ** (-(rh - ra) / 400)))
        rating[p, h], rating[p, a] = rh + moved, ra - moved
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = ratings.elo(events.orderBy(F.rand(1)), "pool")
        assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
        found = {(r.pool, r.game_id): (r.home_elo, r.away_elo) for r in got.collect()}
        assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_elo(games):
    got = {r.game_id: (r.home_elo, r.away_elo) for r in ratings.elo(games, "pool").collect()}
    assert got[1] == (1500.0, 1500.0) and got[2] == (1510.0, 1490.0)
    assert math.isclose(got[5][0] + got[4][0] - got[4][0], got[5][0])
    a_after_2 = 1510 + 20 * (0.5 - 1 / (1 + 10 ** (-20 / 400)))
    assert math.isclose(got[4][1], a_after_2) and math.isclose(got[3][0], 3000 - a_after_2)


def test_first_non_null_and_first_row(spark):
    df = spark.createDataFrame([("t", 5, None, 1), ("t", 3, 2.0, 2)], "team string, attempts int, r double, pid int")
    order = [-F.col("attempts"), F.col("pid")]
    assert tuple(latest.first_non_null_by(df, ["team"], order, ["pid", "r"]).first()) == ("t", 1, 2.0)
    assert tuple(latest.first_row_by(df, ["team"], order, ["pid", "r"]).first()) == ("t", 1, None)


def test_asof_loss(spark):
    log = spark.createDataFrame(
        [(1, "A", "p", DAY(0), "questionable"), (2, "A", "p", DAY(1), "out"), (3, "A", "p", DAY(2), None), (4, "A", "q", DAY(3), "doubtful"), (5, "A", "r", DAY(1), "ir"), (6, "A", "p", DAY(9), "active"), (7, "A", None, DAY(0), "out")],
        "event_id int, team string, player_id string, date timestamp_ntz, status string",
    )
    values = spark.createDataFrame([("p", 4.0), ("r", 2.0)], "player_id string, value double")
    sides = spark.createDataFrame([(1, "A", DAY(0)), (2, "A", DAY(3)), (3, "B", DAY(3)), (4, "A", DAY(9))], "game_id int, team string, date timestamp_ntz")
    got = {r.game_id: r.impact for r in asof.loss_score(sides, log, values).collect()}
    # game 2: p out 4, q doubtful with the median value 3, r unknown status counts in full
    assert got[1] == 2.0 and math.isclose(got[2], 4 + 0.8 * 3) and got[3] == 0.0 and math.isclose(got[4], 0.8 * 3)


def test_play_stats_edges(spark):
    schema = "game_id int, posteam string, defteam string, home_team string, away_team string, season int, week int, play_type string, epa double, success int, yards_gained double, interception int, sack int, fumble int, fumble_lost int, down int, first_down int, yardline_100 int, touchdown int"
    base = ("H", "W", 2020, 1)
    plays = spark.createDataFrame([
        (1, "H", "W", *base, "run", 0.5, 1, 4.0, 0, 0, 1, 1, 1, 0, 50, 0), (1, "H", "W", *base, "run", None, None, None, 0, 0, 0, 0, 2, 1, 10, 1),
        (1, None, "W", *base, "pass", 1.0, 0, 10.0, 1, 0, 0, 0, 3, 0, 50, 0), (1, "H", "W", *base, "punt", 9.0, 1, 99.0, 0, 0, 0, 0, 4, 0, 50, 0), (1, "W", "H", *base, "pass", -1.0, 0, 2.0, 0, 1, 0, 0, 3, 1, 50, 0),
    ], schema)
    got = {r.team: r for r in aggregates.play_stats(plays).collect()}
    h, w = got["H"], got["W"]
    assert (h.plays, h.total_yards, h.yards_per_play, h.pass_epa, h.success_rate, h.turnovers, h.third_down_rate, h.redzone_td_rate, h.sack_rate) == (2, 4.0, 2.0, 0.0, 0.5, 1, 0.0, 1.0, 0.0)
    assert (w.def_total_yards, w.def_yards_per_play, w.def_interceptions, w.def_turnovers) == (14.0, 7.0, 1, 2)
    assert (h.def_yards_per_play, h.def_epa_per_play, h.is_home, w.is_home) == (2.0, 1.0, 1, 0)


def test_median_is_exact_and_flags_are_kept(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, None), (3.0, "b"), (4.0, "c"), (None, "d")], "x double, s string")
    got = quality.impute(df, ["x", "s"]).filter("x_missing = 1 or s_missing = 1").orderBy("x").collect()
    assert [tuple(r) for r in got] == [(2.0, "missing", 0, 1), (2.5, "d", 1, 0)]


def test_metrics_edges(spark):
    df = spark.createDataFrame([(1, 0.5, 0), (0, 0.5, 0), (1, 0.0, 0)], "label int, probability double, prediction int")
    assert one(evaluate.auc(df)) == 0.25
    assert math.isfinite(one(evaluate.log_loss(df)))
    report = {r["class"]: r for r in evaluate.class_report(df).collect()}
    assert report["1"].precision == 0.0 and report["1"].support == 2 and report["weighted avg"].support == 3
    assert [r.n for r in evaluate.confusion(df).orderBy("actual", "predicted").collect()] == [1, 0, 2, 0]


def test_metrics_by_group_are_those_of_each_group(spark):
    rows = [(m, s, (i * 7 + k) % 3 % 2, ((i * 31 + k * 17) % 23) / 22) for k, (m, s) in enumerate([("a", "val"), ("a", "test"), ("b", "val")]) for i in range(40 + 9 * k)]
    rows += [("one", "val", 1, 0.7), ("one", "val", 1, 0.2), ("none", "val", 0, None), ("none", "val", None, 0.5)]
    df = spark.createDataFrame(rows, "model string, split string, label int, probability double").withColumn("prediction", (F.col("probability") > 0.5).cast("int"))
    got = {(r.model, r.split): tuple(r)[2:] for r in evaluate.metrics(df, by=["model", "split"]).collect()}
    assert len(got) == 5 and got["one", "val"][2] is None
    for (m, s), figures in got.items():
        part = df.filter((F.col("model") == m) & (F.col("split") == s))
        apart = (one(evaluate.accuracy(part)), one(evaluate.log_loss(part)), one(evaluate.auc(part)))
        assert figures == tuple(x if x is None else pytest.approx(x, abs=1e-12) for x in apart)
        assert tuple(evaluate.metrics(part).first()) == figures
        if m in "ab":
            pairs = [((x.label, x.probability), (y.label, y.probability)) for x in part.collect() for y in part.collect() if x.label == 1 and y.label == 0]
            assert figures[2] == pytest.approx(sum(1.0 if x[1] > y[1] else 0.5 if x[1] == y[1] else 0.0 for x, y in pairs) / len(pairs))
    assert tuple(evaluate.metrics(df.limit(0)).first()) == (None, None, None) and evaluate.metrics(df.limit(0), by=["model"]).count() == 0
    board = evaluate.leaderboard({m: df.filter(F.col("model") == m) for m in ("a", "b")}).collect()
    assert {r.model for r in board} == {"a", "b"} and board[0].accuracy >= board[1].accuracy


def test_splits(spark):
    df = spark.createDataFrame([(i, i // 5, 2000 + i // 5) for i in range(20)], "id int, t int, season int")
    got = split.split_by_position(df, "t", "id").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 14, "val": 3, "test": 3}
    assert {(r.season, r.split) for r in split.split_by_season(df).select("season", "split").distinct().collect()} == {(2000, "train"), (2001, "val"), (2002, "test"), (2003, "test")}
    parts = lambda most: {(r.season, r.split): r["count"] for r in split.split_by_season(df.filter(f"season <= {most}"), time="t", key="id").groupBy("season", "split").count().collect()}
    assert parts(2002) == {(2000, "train"): 5, (2001, "val"): 5, (2002, "test"): 5}
    assert parts(2001) == {(2000, "train"): 3, (2000, "val"): 2, (2001, "test"): 5}
    assert parts(2000) == {(2000, "train"): 3, (2000, "val"): 1, (2000, "test"): 1}


def test_states_default_by_side(spark):
    sides = spark.createDataFrame([("A", 1600.0, 1, 1, 1), ("A", 1700.0, 2, 2, 0)], "team string, elo double, date int, game_id int, is_home int")
    up = spark.createDataFrame([(9, "A", "Z")], "game_id int, home_team string, away_team string")
    states = score.snapshot(sides, "team", "date", "game_id")
    assert tuple(score.with_states(up, states, ["elo"]).select("home_elo", "away_elo").first()) == (1700.0, 1500.0)
    assert score.snapshot(sides, "team", "date", "game_id", prefer_home=True).first().elo == 1600.0


def test_sources(spark, tmp_path, games):
    schema = "team string, x double"
    assert sources.read_optional(spark, str(tmp_path / "absent.parquet"), schema).count() == 0
    with pytest.raises(Exception, match="absent"):
        sources.read_table(spark, str(tmp_path / "absent.parquet"))
    df = spark.createDataFrame([("a", float("nan")), ("b", 1.5)], schema)
    for kind in ("csv", "parquet"):
        path = str(tmp_path / f"t.{kind}")
        sources.write_table(df, path, ["team", "x"])
        assert sorted((r.team, r.x) for r in sources.read_table(spark, path, schema).collect()) == [("a", None), ("b", 1.5)]
    sources.write_feature_names(games, str(tmp_path / "names"), exclude=["pool"])
    names = [r.value for r in spark.read.text(str(tmp_path / "names")).collect()]
    assert names == sorted(set(games.columns) - {"pool"})
    sources.write_profile(quality.profile(games, ["home_score", "pool"]), str(tmp_path / "profile"))
    assert spark.read.json(str(tmp_path / "profile")).count() == 2


def test_event_key_pads_the_week(spark):
    df = spark.createDataFrame([(2020, 3, "A", "B")], "season int, week int, home_team string, away_team string")
    assert sources.with_event_key(df).first().game_id == "2020_03_A_B"


def test_empty_tables(games):
    none = games.limit(0)
    assert ratings.elo(none, "pool").count() == 0
    assert lagged.ewma(reshape.match_sides(none), ["team"], ["date", "game_id"], ["points_for"]).count() == 0


def test_standardised_and_summary(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (3.0, 5.0, 1.0), (None, 5.0, 1.0)], "a double, b double, home_c double")
    assert [tuple(r) for r in quality.standardised(df, ["a", "b"]).select("a", "b").collect()] == [(-1.0, 0.0), (1.0, 0.0), (None, 0.0)]
    got = quality.missing_summary(df, ["a", "b", "home_c"], {"side": ["home", "away"]}).first()
    assert (got.n_rows, got.n_features, got.n_side) == (3, 3, 1) and math.isclose(got.missing_share, 2 / 9)


def test_states_meet_moments_of_their_own_days_only(spark):
    """Many states and many moments of one key: rows come out for matches, and a state open at both ends holds everywhere."""
    log = spark.createDataFrame([("t", p, DAY(d, 6), 10 * p + d, "out" if d % 2 else "active") for p in range(4) for d in range(0, 12, p + 1)], "team string, player_id int, date timestamp_ntz, event_id int, status string")
    sides = spark.createDataFrame([(k, "t", DAY(k // 3, 12 * (k % 3))) for k in range(45)], "game_id int, team string, date timestamp_ntz")
    values = spark.createDataFrame([(0, 2.0), (1, 4.0)], "player_id int, value double")
    for days in (1, 4):
        got = {r.game_id: r.impact for r in asof.loss_score(sides, log, values, days=days).collect()}
        entries, moments = [tuple(r) for r in log.collect()], {r.game_id: r.date for r in sides.collect()}
        for k, at in moments.items():
            held = {}
            for _, p, since, key, status in sorted(entries, key=lambda e: (e[2], e[3])):
                if since <= at:
                    held[p] = status
            known = [v for p, v in ((0, 2.0), (1, 4.0)) if p in held]
            typical = sum(known) / len(known) if known else 1.0
            assert math.isclose(got[k], sum({0: 2.0, 1: 4.0}.get(p, typical) for p, s in held.items() if s == "out"))


@pytest.mark.parametrize("alpha", [0.03, 1 / 3, 0.9])
def test_ewma_over_long_series_and_gaps(spark, alpha):
    import random

    rnd = random.Random(5)
    rows = [(e, i, None if rnd.random() < 0.3 or 300 < i < 900 else rnd.uniform(-50, 50), float(i % 7) if e else None) for e in (0, 1) for i in range(2500)]
    got = lagged.ewma(spark.createDataFrame(rows, "e int, i int, x double, z double"), ["e"], ["i"], ["x", "z"], alpha)
    found = {(r.e, r.i): (r.x_ewma, r.z_ewma) for r in got.collect()}
    for e in (0, 1):
        state = [(None, 1.0), (None, 1.0)]
        for i, *values in [r[1:] for r in rows if r[0] == e]:
            for k, x in enumerate(values):
                y, w = state[k]
                assert (found[e, i][k] is None) == (y is None) and (y is None or math.isclose(found[e, i][k], y, rel_tol=1e-9, abs_tol=1e-9)), (e, i, k)
                if x is not None:
                    old = w * (1 - alpha)
                    state[k] = (x if y is None else (old * y + alpha * x) / (old + alpha), 1.0)
                elif y is not None:
                    state[k] = (y, w * (1 - alpha))
