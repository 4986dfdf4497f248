"""Lagged statistics in time blocks equal those over whole entities, and spread over more tasks than entities."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pairframe.operators import lagged

ORDER = ["day", "id"]


@pytest.fixture(scope="module")
def rows(spark):
    """Few entities (one of them null), long gaps without values, blocks without rows, blocks without values, null days."""
    rng, out = random.Random(11), []
    for team, n in (("a", 900), ("b", 5), (None, 300), ("c", 1)):
        day = 0
        for _ in range(n):
            day += rng.choice([0, 0, 1, 1, 2, 400]) if rng.random() < 0.2 else rng.choice([0, 1])
            quiet = 200 < day < 700
            out.append((team, None if rng.random() < 0.01 else day, len(out), None if quiet or rng.random() < 0.3 else rng.uniform(-5, 50), None if rng.random() < 0.9 else float(rng.randrange(9)), rng.randrange(100), day // 500))
    rng.shuffle(out)
    return spark.createDataFrame(out, "team string, day int, id long, x double, rare double, n int, season int").repartition(4).persist()


def same(a, b, digits=1e-9):
    names = sorted(set(a.columns))
    assert names == sorted(b.columns)
    left, right = ({r.id: r for r in df.collect()} for df in (a, b))
    assert left.keys() == right.keys() and a.count() == len(left)
    for i, r in left.items():
        for c in names:
            x, y = r[c], right[i][c]
            assert x == y or (isinstance(x, float) and y is not None and math.isclose(x, y, rel_tol=digits, abs_tol=digits)), (i, c, x, y)


@pytest.mark.parametrize(("days", "alphas"), [(20, (0.03, 1)), (100000, (1 / 3,))])
def test_blocks_bear_on_no_result(rows, days, alphas):
    block = F.floor(F.col("day") / days)
    for run in (
        lambda **b: lagged.rolling_mean(rows, ["team"], ORDER, ["x", "rare", "n"], (1, 3, 10), **b),
        lambda **b: lagged.previous(rows, ["team"], ORDER, ["x", "n"], **b),
        lambda **b: lagged.expanding_mean(rows, ["team"], ORDER, ["x", "rare", "n"], **b),
        lambda **b: lagged.expanding_mean(rows, ["team"], ORDER, ["x"], ["season"], **b),
        *[lambda a=a, **b: lagged.ewma(rows, ["team"], ORDER, ["x", "rare"], a, **b) for a in alphas],
    ):
        same(run(), run(block=block))


def test_gaps_in_blocks(rows):
    timed = rows.filter("day is not null").withColumn("t", F.timestamp_micros(F.col("day").cast("long") * 86_400_000_000))
    same(lagged.gap_days(timed, ["team"], ORDER, "t").drop("t"), lagged.gap_days(timed, ["team"], ORDER, "t", block=lagged.time_block("t", 7)).drop("t"))


def test_mean_by_hand_over_a_long_gap(spark):
    rows = spark.createDataFrame([("a", d, d, 10.0 if d == 0 else 4.0 if d == 90 else None) for d in range(100)], "team string, day int, id long, x double")
    got = {r.day: r.x_ewma for r in lagged.ewma(rows, ["team"], ORDER, ["x"], 0.5, block=F.floor(F.col("day") / 7)).collect()}
    k = 0.5**90
    assert got[0] is None and got[90] == 10.0 and math.isclose(got[99], (k * 10 + 0.5 * 4) / (k + 0.5), rel_tol=1e-12)


@pytest.mark.parametrize("run", [
    lambda df, b: lagged.rolling_mean(df, ["team"], ORDER, ["x"], block=b), lambda df, b: lagged.expanding_mean(df, ["team"], ORDER, ["x"], block=b), lambda df, b: lagged.ewma(df, ["team"], ORDER, ["x"], block=b),
])
def test_more_tasks_than_entities(spark, run):
    few = spark.range(4000).select((F.col("id") % 3).alias("team"), (F.col("id") / 10).cast("int").alias("day"), "id", F.rand(1).alias("x"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("32", "false", "-1"), strict=True):
            spark.conf.set(k, v)
        out = run(few, F.floor(F.col("day") / 10))
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max(out.columns[-1])).collect()]
        assert len(sizes) > 20 and max(sizes) < 4000 / 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rows_before_the_shuffle_of_tails_are_limited(rows, capsys):
    lagged.rolling_mean(rows, ["team"], ORDER, ["x"], (3,), block=F.floor(F.col("day") / 5)).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out
