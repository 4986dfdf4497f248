"""Form by spans equals the window functions over the two sides' rows."""

import pytest
from pyspark.sql import functions as F

from pairframe.operators import form, lagged, reshape
from pairframe.plans import training


@pytest.fixture(scope="module")
def events(spark):
    n = F.pmod(F.xxhash64("game_id"), F.lit(1000))
    home = (F.pmod(F.xxhash64("game_id", F.lit(1)), F.lit(7))).cast("int")
    day = F.expr("timestamp_ntz '1995-01-01 00:00:00' + make_dt_interval(cast(game_id div 2 * 3 as int), cast(game_id % 2 * 5 as int))")
    made = spark.range(400).withColumnRenamed("id", "game_id").withColumn("date", F.when(F.col("game_id") != 5, day)).withColumn("home_team", F.when(home > 0, home))
    made = made.withColumn("away_team", F.pmod(F.coalesce("home_team", F.lit(0)) + 1 + F.pmod(n, F.lit(5)), F.lit(7)).cast("int")).filter("not home_team <=> away_team")
    # a has gaps, b has values in the first and the last rows only, c has none
    return made.select(
        "*", F.when(n % 3 > 0, n.cast("double")).alias("home_a"), F.when(n % 4 > 0, n / 7).alias("away_a"), *[F.when((F.col("game_id") < 30) | (F.col("game_id") > 390), n / 3).alias(f"{p}_b") for p in ("home", "away")],
        *[F.lit(None).cast("double").alias(f"{p}_c") for p in ("home", "away")],
    ).persist()


def expected(events, made):
    sides = reshape.to_sides(events, ["game_id", "date"], {"team": ("home_team", "away_team"), **{c: (f"home_{c}", f"away_{c}") for c in made.columns}})
    long = lagged.gap_days(sides, ["team"], list(made.order), made.time)
    long = lagged.rolling_mean(long, ["team"], list(made.order), list(made.columns), made.windows)
    long = lagged.ewma(long, ["team"], list(made.order), list(made.columns), made.alpha)
    return {(r.game_id, r.is_home): r for r in long.collect()}


@pytest.mark.parametrize(("days", "alpha"), [(1, 1 / 3), (11, 0.1), (90, 1 / 3), (5000, 1.0)])
def test_form_equals_windows(events, days, alpha):
    made = form.Form(("date", "game_id"), "date", ("a", "b", "c"), (1, 3, 10), alpha, 7, days)
    want = expected(events, made)
    found = made.attach(events, made.states(events)).collect()
    assert len(found) == events.count() and 2 * len(found) == len(want)
    for r in found:
        for p, flag in (("home", 1), ("away", 0)):
            for name in made.names:
                a, b = r[f"{p}_{name}"], want[r.game_id, flag][name]
                assert a == b or (a is not None and b is not None and abs(a - b) <= 1e-9 * (1 + abs(b))), (r.game_id, p, name, a, b)


def test_some_events_and_none(events):
    made = form.Form(("date", "game_id"), "date", ("a", "b"), days=30)
    states = made.states(events)
    whole = {r.game_id: r for r in made.attach(events, states).collect()}
    early = made.attach(events.filter("date < timestamp_ntz '1996-01-01 00:00:00'"), states).collect()
    assert early and all(sorted(map(str, r)) == sorted(map(str, whole[r.game_id])) for r in early)
    assert made.attach(events.filter("false"), made.states(events.filter("false"))).count() == 0
    assert form.span(events.filter("false"), "date") == 90


def test_spans_shrink_as_the_table_grows(events):
    assert form.span(events, "date", rows=1000) == 90 and form.span(events, "date", rows=20) < 40 and form.span(events, "date", rows=0) == 1


def test_wide_rows_of_entry_a_are_not_shuffled(spark, sf, monkeypatch):
    plans = []
    monkeypatch.setattr(form.Form, "attach", lambda self, rows, states, attach=form.Form.attach: plans.append(attach(self, rows, states)) or plans[-1])
    table = training.build_features(spark, sf)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plans and plan.count("Exchange hashpartitioning") == plans[0]._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert table.count() == plans[0].count()
