"""Exact order statistics, positional splits and as-of states without global sorts or spread intervals."""

import datetime as dt
import inspect
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pairframe.operators import asof, evaluate, quality, select, split


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(4)
    rows = []
    for k in range(3001):
        heavy = 1.0 if k < 1490 else 3.0 if k < 2990 else 2.0  # the middle lies between two heavy values
        rows.append((k, rng.gauss(0, 1), None if rng.random() < 0.4 else rng.randrange(7), heavy, float("nan") if k % 3 == 0 else float(k), Decimal(rng.randrange(10**6)) / 100, None, 5.0))
    return spark.createDataFrame(rows, "k long, normal double, few int, heavy double, odd double, price decimal(12,2), none double, one double").repartition(5).persist()


COLUMNS = ["k", "normal", "few", "heavy", "odd", "price", "none", "one"]


@pytest.mark.parametrize(("inside", "width"), [(10**6, 5e-4), (40, 5e-4), (1, 5e-2), (1, 0.5)])
def test_medians_are_exact_however_far_brackets_narrow(numbers, inside, width):
    got = {c: select.middle(v) for c, v in select.ranked(numbers, COLUMNS, inside=inside, width=width).items()}
    want = numbers.select([F.median(c).cast("double").alias(c) for c in COLUMNS]).first().asDict()
    for c in COLUMNS:
        assert got[c] == want[c] or math.isclose(got[c], want[c], rel_tol=1e-12), c


def test_ranks_in_any_number(numbers):
    values = sorted(r.normal for r in numbers.collect())
    ranks = [0, 17, 1500, 3000, 3001, -1]
    for inside in (10**6, 10):
        got = select.ranked(numbers, ["normal"], {"normal": ranks}, inside=inside)["normal"]
        assert got == [values[0], values[17], values[1500], values[3000], None, None]
    assert select.ranked(numbers.limit(0), ["normal", "few"]) == {"normal": [], "few": []} and select.ranked(numbers, []) == {}


def test_no_percentile_gathers_a_column(spark, numbers, monkeypatch):
    """The exact median's jobs hold no percentile over all rows, and no window over raw ones."""
    seen, collect = [], type(numbers).collect
    monkeypatch.setattr(type(numbers), "collect", lambda self: (seen.append(self._jdf.queryExecution().toString()), collect(self))[1])
    assert quality.medians(numbers, ["normal", "few"])["few"] == 3.0
    text = "".join(seen)
    assert "median(" not in text and "percentile(" not in text
    quality.profile(numbers, ["normal"]).collect()
    assert "median(" not in seen[-1] and "percentile(" not in seen[-1]


@pytest.mark.parametrize("key", ["id", "name"])
def test_positions_without_a_window(spark, capsys, key):
    rng = random.Random(8)
    rows = [(None if k % 50 == 0 else dt.datetime(2020, 1, 1) + dt.timedelta(days=rng.choice([0, 0, 0, 1, 2, 9]), microseconds=rng.choice([0, 7])), k, f"{'same prefix for all ' * 2}{k:05d}é") for k in range(1003)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, id int, name string").repartition(4)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or dt.datetime.min, r[1]))
    a, b = int(0.7 * 1003), int((0.7 + 0.15) * 1003)
    want = {r[1]: "train" if i < a else "val" if i < b else "test" for i, r in enumerate(ordered)}
    out = split.split_by_position(df, "t", key)
    assert {r.id: r.split for r in out.collect()} == want
    out.explain()
    plan = capsys.readouterr().out
    assert "Window" not in plan and "Exchange SinglePartition" not in plan and "Sort" not in plan
    assert split.split_by_position(df.limit(0), "t", key).count() == 0
    assert [r.split for r in split.split_by_position(df.limit(1), "t", key).collect()] == ["test"]


def test_states_make_no_rows_between_moments(spark):
    """Years without moments cost nothing, and a row per (moment, known player) comes out."""
    day = lambda n: dt.datetime(2000, 1, 1) + dt.timedelta(days=n)
    log = spark.createDataFrame([(i, "A", p, day(i * 300), s) for i, (p, s) in enumerate([("p", "out"), ("q", "active"), ("p", None), ("q", "out"), ("p", "active")])] + [(9, None, "p", day(0), "out"), (10, "B", "z", day(5000), "out")], "event_id int, team string, player string, date timestamp_ntz, status string")
    moments = spark.createDataFrame([("A", day(0)), ("A", day(0)), ("A", day(3000)), ("A", day(9000)), ("B", day(2)), ("C", day(2)), (None, day(2))], "team string, date timestamp_ntz")
    at, rows = asof.numbered(moments, log.withColumnRenamed("date", "since"), "team", "date", "since", days=30)
    assert sorted(map(tuple, at.collect())) == [("A", day(0), 0), ("A", day(3000), 1), ("A", day(9000), 2), ("B", day(2), 0), ("C", day(2), 0)]
    assert {r.event_id: (r["__at"], r["__all"]) for r in rows.collect()} == {0: (0, 3), 1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (1, 3), 10: (1, 1)}
    held = asof.asof_state(rows, ["team", "player"], "since", "event_id", "status")
    assert sorted(map(tuple, held.collect())) == [("A", "p", "active", 1), ("A", "p", "active", 2), ("A", "p", "out", 0), ("A", "q", "out", 1), ("A", "q", "out", 2)]


def test_running_counts_over_parts_of_equal_depth(spark):
    """Scores in a hair's breadth of 0.5 spread over all parts, in order, and the AUC is exact."""
    rng = random.Random(3)
    rows = [(rng.randrange(2), 0.5 + rng.random() * 1e-9 if k % 50 else rng.random()) for k in range(6000)] + [(1, 0.5)] * 50 + [(0, 0.5)] * 70
    df = spark.createDataFrame(rows, "label int, probability double")
    by_score = df.groupBy(F.col("probability").alias("s")).agg(F.count_if(F.col("label") == 0).alias("n"))
    parts = evaluate.in_depth(by_score).groupBy("part").agg(F.count("*").alias("rows"), F.min("s").alias("low"), F.max("s").alias("high")).orderBy("part").collect()
    assert len(parts) > 900 and max(p["rows"] for p in parts) < 40 and all(a.high < b.low for a, b in zip(parts, parts[1:]))
    ones, zeros = (sorted(p for y, p in rows if y == k) for k in (1, 0))
    import bisect

    won = sum(bisect.bisect_left(zeros, p) + (bisect.bisect_right(zeros, p) - bisect.bisect_left(zeros, p)) / 2 for p in ones)
    assert evaluate.auc(df).first()[0] == pytest.approx(won / len(ones) / len(zeros), abs=1e-12)


def test_lower_middles_by_bits(spark, monkeypatch):
    """As a plain sort says: both signs, zeros, NaN, infinities, whole numbers, nulls, ties, no values; and no sketch is shuffled."""
    rng = random.Random(3)
    odd = [0.0, -0.0, float("inf"), float("-inf"), 1e-310, -1e-310, 1e300]
    rows = [(rng.gauss(0, 3), rng.choice([None, *odd]), rng.randrange(-5, 5), float("nan") if k % 3 else -1.5, None, rng.choice([0.1, 0.1, 0.30000000000000004]), 2.5 if k == 7 else None) for k in range(1001)]
    for n in (1001, 1000, 0):
        df = spark.createDataFrame(rows[:n], "a double, b double, c int, d double, e double, f double, g double").repartition(5)
        found = quality.medians(df, df.columns, lower=True)
        for k, c in enumerate(df.columns):
            values = sorted((r[k] for r in rows[:n] if r[k] is not None), key=lambda x: (x != x, x))
            want = float(values[(len(values) - 1) // 2]) if values else None
            assert found[c] == want or (want != want and found[c] != found[c]), (n, c)
    assert "percentile" not in inspect.getsource(quality) and quality.medians(df, [], lower=True) == {}


def test_lower_middles_end_with_few_values_left(spark, monkeypatch):
    """A column is done, and not read again, once each task has few different values left; wide tables are read some columns at a time."""
    rng = random.Random(4)
    rows = [(rng.gauss(0, 3), float(rng.randrange(-5, 5)), None if k % 2 else rng.random(), 7.0) for k in range(6000)]
    df, passes, counted = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(3), [], select._next_bits
    monkeypatch.setattr(select, "_next_bits", lambda df, names, found, *more: passes.append([names[i] for i in found]) or counted(df, names, found, *more))
    monkeypatch.setattr(select, "SOME", 3)
    found = quality.medians(df, df.columns, lower=True)
    for k, c in enumerate(df.columns):
        values = sorted(r[k] for r in rows if r[k] is not None)
        assert found[c] == values[(len(values) - 1) // 2]
    assert passes[:2] == [["a", "b", "c", "d"]] * 2 and len(passes) == 3 and set(passes[2]) <= {"a", "c"}
