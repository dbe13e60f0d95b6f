"""Tables that are written on the way go when their last reader is through."""

import os

import pytest
from pyspark.sql import functions as F

from touchline.operators import ratings, rolling
from touchline.plans import features as ft
from touchline.session import checkpoint_dir, materialize, passing, settled


def _tables(spark):
    folder = checkpoint_dir(spark).removeprefix("file:")
    return {n for n in os.listdir(folder) if n.startswith("touchline-")}


def _matches(spark, n=60):
    names = F.array(*[F.lit(f"T{i}") for i in range(6)])
    return spark.range(n).select(
        F.col("id").cast("string").alias("game_id"), F.concat(F.lit("g"), F.col("id").cast("string")).alias("game"),
        F.date_format(F.date_add(F.lit("2024-08-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("date"),
        F.lit("L").alias("league"), F.lit("2425").alias("season"), F.get(names, (F.col("id") % 6).cast("int")).alias("home_team"),
        F.get(names, ((F.col("id") + 1 + F.col("id") % 5) % 6).cast("int")).alias("away_team"), F.lit(1).alias("week"),
        F.concat((F.col("id") % 3).cast("string"), F.lit("-"), (F.col("id") % 2).cast("string")).alias("score"))


def test_only_kept_tables_stay(spark):
    before = _tables(spark)
    with passing(spark) as keep:
        first = materialize(spark.range(5))
        with passing(spark) as inner:
            lost, second = materialize(spark.range(3)), materialize(first.where("id > 1"))
            derived = inner(second.withColumn("x", F.col("id") * 2))
        assert derived.count() == 3 and first.count() == 5
        out = keep(derived)
    assert out.agg(F.sum("x")).first()[0] == 18 and len(_tables(spark) - before) == 1
    for gone in (first, lost):
        with pytest.raises(Exception, match="does not exist|FILE_NOT_EXIST|PATH_NOT_FOUND"):
            gone.count()


def test_a_failing_step_leaves_no_tables(spark):
    before = _tables(spark)
    with pytest.raises(ValueError), passing(spark):
        materialize(spark.range(5))
        raise ValueError
    materialize(spark.range(2))  # outside of any block: stays
    assert len(_tables(spark) - before) == 1


def test_the_feature_table_leaves_one_table(spark):
    schedule, before = _matches(spark), _tables(spark)
    table = settled(spark, lambda: ft.feature_table(schedule))
    assert len(_tables(spark) - before) == 1 and table.count() == 60
    parsed = materialize(ft.parsed_matches(schedule))
    matches = ft.indexed_matches(parsed)
    replayed = settled(spark, lambda: ratings.elo(matches, slice_rows=25))
    shared = ft.feature_rows(parsed, matches, replayed=replayed)
    assert shared.exceptAll(table).isEmpty() and table.exceptAll(shared).isEmpty()
    known, alone = ft.history(matches, replayed=replayed), ft.history(matches)
    assert known.team_state.exceptAll(alone.team_state).isEmpty() and known.team_state.count() == 6


def test_histories_are_filled_in_where_a_blocks_matches_lie(spark, monkeypatch):
    """The feature table equals its parts, joined side by side, and no side is joined to the other by row."""
    monkeypatch.setattr(rolling, "SPANS", 1)
    monkeypatch.setattr(rolling, "FADE", 2.0)  # blocks of 8 rows
    events = _matches(spark).where("CAST(game_id AS INT) % 4 > 0").select(
        "game_id", "game", F.col("league").alias("_league"), F.col("season").alias("_season"), F.explode(F.array("home_team", "away_team")).alias("team"),
        F.explode(F.sequence(F.lit(1), F.col("game_id").cast("int") % 3 + 1)).alias("n")).select(
        "*", F.lit("SavedShot").alias("type"), F.lit("Successful").alias("outcome_type"), F.lit(90.0).alias("x"), F.lit(90.0).alias("end_x"))
    events = events.withColumn("game", F.concat(F.date_format(F.date_add(F.lit("2024-08-01").cast("date"), F.col("game_id").cast("int")), "yyyy-MM-dd"), F.lit(" x")))
    late = _matches(spark).select(*[F.col(c) if c not in ("season", "date") else F.when(F.col("game_id").cast("int") < 30, F.col(c)).otherwise(
        F.lit("2526") if c == "season" else F.concat(F.col(c), F.lit("T12:30:00"))).alias(c) for c in ft.SCHEDULE_COLUMNS])
    parsed = materialize(ft.parsed_matches(late))
    matches = ft.indexed_matches(parsed, events)
    assert matches.where("targets_present = 1").count() > 20
    table = ft.feature_rows(parsed, matches)
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and not any("Join" in line and "row_idx" in line for line in plan.splitlines())
    sides = ft.both_sides(ft.side_features(ft.team_rows(matches)))
    want = sides.join(ft.head_to_head(matches), "row_idx").join(ratings.elo(matches).select("row_idx", "home_elo", "away_elo"), "row_idx")
    columns = sorted(c for c in want.columns)
    got, want = (sorted(map(tuple, df.select("row_idx", *[c for c in columns if c != "row_idx"]).collect())) for df in (table, want))
    assert got == want and len(got) == 60 and len(set(r[1:] for r in got)) > 50
