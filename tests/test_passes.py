"""How often tables are worked out, and what is shuffled: splits by place, form of both sides, week figures of both sides."""

import re

import pytest
from pyspark.sql import functions as F

from pairframe import sources
from pairframe.operators import form, split
from pairframe.plans import queries, training
from test_form import events, expected  # noqa: F401


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seasons", [1, 2])
def test_places_are_found_in_two_written_columns(spark, monkeypatch, seasons):
    read = []
    monkeypatch.setattr(split, "row_at", lambda df, order, rank, row_at=split.row_at: read.append((df, rank)) or row_at(df, order, rank))
    rows = spark.range(100).join(spark.range(100).withColumnRenamed("id", "id2"), F.col("id") == F.col("id2")).select(F.col("id").alias("game_id"), (F.col("id") % 50).alias("date"), F.when(F.col("id") != 3, 2000 + F.col("id") % seasons).alias("season"), F.lit("x").alias("more"))
    out = split.split_by_season(rows)
    assert [r for _, r in read] == ([70, 85] if seasons == 1 else [int(0.7 * 51)])
    for df, _ in read:
        assert df.columns == ["date", "game_id"] and "FileScan parquet" in plan(df) and "Join" not in plan(df)
    assert plan(out).count("Join") == 1
    counts = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == ({"train": 70, "val": 15, "test": 15} if seasons == 1 else {"train": 35, "val": 16, "test": 49})


def test_wide_rows_of_play_form_are_neither_joined_nor_shuffled(spark, sf):
    found = plan(queries.q_play_form(spark, sf))
    assert "Join" not in found and "Window" not in found and "_r10" not in "".join(line for line in found.splitlines() if "Exchange" in line)


def test_form_without_an_exponential_mean(events):  # noqa: F811
    made = form.Form(("date", "game_id"), "date", ("a", "b", "c"), (1, 3, 10), None, 7, 30)
    want = expected(events, form.Form(("date", "game_id"), "date", ("a", "b", "c"), (1, 3, 10), 1 / 3, 7, 30))
    assert made.names == ["rest_days", *[f"{c}_r{k}" for c in "abc" for k in (1, 3, 10)]]
    for r in made.attach(events, made.states(events)).collect():
        for p, flag in (("home", 1), ("away", 0)):
            for name in made.names:
                a, b = r[f"{p}_{name}"], want[r.game_id, flag][name]
                assert a == b or (a is not None and b is not None and abs(a - b) <= 1e-9 * (1 + abs(b)))


@pytest.mark.parametrize("make", [queries.q_week_sides, training.team_week_table])
def test_matches_are_not_shuffled_for_their_weeks(spark, sf, monkeypatch, make):
    joined = []
    monkeypatch.setattr(queries, "with_weeks", lambda *a, with_weeks=queries.with_weeks: joined.append((a[0], with_weeks(*a))) or joined[-1][1])
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        make(spark, sf)
        assert len(joined) == 2
        for before, after in joined:
            assert plan(after).count("Exchange hashpartitioning") == plan(before).count("Exchange hashpartitioning")
            assert plan(after).count("BroadcastExchange") == plan(before).count("BroadcastExchange") + 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def parts_of(df):
    """Parts that exchanges deal out, as the plan names them."""
    return [int(n) for n in re.findall(r"Exchange hashpartitioning\([^)]*?, (\d+)\)", plan(df))]


@pytest.mark.parametrize("make", [queries.q_play_agg, queries.q_play_points, queries.q_proxy_fill, queries.q_ewma])
def test_parts_follow_the_size_of_the_table(spark, sf, monkeypatch, make):
    """Every task holds the same number of rows however large the table: rows by key are dealt out in pieces, not in as many parts as the session names."""
    spans = []
    monkeypatch.setattr(form, "span", lambda *a, span=form.span: spans.append(span(*a)) or spans[-1])
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    want = sorted(map(str, make(spark, sf).collect()))
    try:
        monkeypatch.setattr(sources, "PIECE", 50)
        monkeypatch.setattr(sources.pieces, "__defaults__", (50,))
        monkeypatch.setattr(sources, "SMALL", 5)
        found = make(spark, sf)
        lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
        assert parts_of(found).count(-(-lines // 50)) >= 2 and 4 not in parts_of(found)[:1]
        assert make is not queries.q_ewma or spans[-1] < spans[0] == 90
        assert sorted(map(str, found.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("make", [queries.q_play_agg, queries.q_proxy_fill])
def test_plays_are_summed_up_where_they_were_joined(spark, sf, make):
    """Groups of wide sums are not built in tasks of raw rows, which hold as many groups as rows."""
    lines = plan(make(spark, sf)).splitlines()
    first = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line or "BroadcastHashJoin [l_orderkey" in line or "BroadcastHashJoin [o_orderkey" in line)
    assert sum("HashAggregate" in line for line in lines[:first]) == 2 and not any("Exchange" in line for line in lines[:first])


def test_training_rows_are_formed_once_and_read_from_files(spark, sf, monkeypatch):
    """Both sides' form is not worked out again for the medians, nor are rows shuffled when a model reads them."""
    formed = []
    monkeypatch.setattr(form.Form, "attach", lambda self, *a, attach=form.Form.attach: formed.append(a) or attach(self, *a))
    rows, features = training.training_rows(spark, sf)
    assert len(formed) == 1 and "Exchange" not in plan(rows) and "FileScan parquet" in plan(rows) and len(features) > 100
    assert rows.filter(" or ".join(f"`{c}` is null" for c in features)).count() == 0 < rows.filter("split = 'train'").count()
