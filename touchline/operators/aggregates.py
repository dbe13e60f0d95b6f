"""Event counts per game and team, season spans, team sets, squad priors, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from touchline.config import EVENT_STATS
from touchline.functions.events import event_flags
from touchline.functions.scalars import game_day_from_text, lenient_double, next_season


def event_team_stats(events: DataFrame) -> DataFrame:
    """Eight counts per (game_id, team).

    The descriptive columns are grouped first, so the pass over the events is a hash aggregation with
    map-side counts; the smallest text per group is then taken from the few rows left.
    """
    counts = events.groupBy("game_id", "team", "game", "_league", "_season").agg(
        *[F.count_if(flag).alias(name) for name, flag in event_flags().items()])
    return (
        counts.groupBy("game_id", "team").agg(
            F.min("game").alias("game"), F.min("_league").alias("league"), F.min("_season").alias("season"),
            *[F.sum(name).alias(name) for name in EVENT_STATS])
        .where(F.col("league").isNotNull() & F.col("season").isNotNull() & F.col("team").isNotNull())
    )


def _stats(prefix: str = "") -> list:
    return [F.col(f"{prefix}{c}") for c in EVENT_STATS]


def paired_games(stats: DataFrame, name_map: DataFrame) -> DataFrame:
    """One row per event game: team counts before and after naming, and both sides' statistics.

    ``name_map`` holds league, season, source_name, team_name. Sides are ordered by mapped name.
    """
    named = stats.join(
        name_map.withColumnRenamed("source_name", "team"), ["league", "season", "team"], "left")
    payload = F.when(F.col("team_name").isNotNull(), F.struct(F.col("team_name").alias("name"), *_stats()))
    return named.groupBy("league", "season", "game_id").agg(
        F.min("game").alias("game"),
        F.count("team").alias("teams"), F.count("team_name").alias("mapped"),
        F.min(payload).alias("lo"), F.max(payload).alias("hi"))


def two_team_games(stats: DataFrame, name_map: DataFrame) -> DataFrame:
    """Games with exactly two teams, both mapped, keyed by (league, season, day, pair_lo, pair_hi).

    Several event games on one key leave the one with the highest game id.
    """
    games = paired_games(stats, name_map).where(
        (F.col("teams") == 2) & (F.col("mapped") == 2) & F.col("game").isNotNull()
        & (F.col("lo.name") != F.col("hi.name")))
    keyed = games.select(
        "league", "season", game_day_from_text("game").alias("day"),
        F.col("lo.name").alias("pair_lo"), F.col("hi.name").alias("pair_hi"), "game_id", "lo", "hi")
    return keyed.groupBy("league", "season", "day", "pair_lo", "pair_hi").agg(
        F.max(F.struct("game_id", "lo", "hi")).alias("g")
    ).select(
        "league", "season", "day", "pair_lo", "pair_hi", F.col("g.game_id").alias("event_game_id"),
        *[F.col(f"g.{side}.{c}").alias(f"{side}_{c}") for side in ("lo", "hi") for c in EVENT_STATS])


def season_span(schedule: DataFrame) -> DataFrame:
    """Largest week per (league, season) over all fixtures, played or not; 0 when no week is known."""
    return schedule.groupBy("league", "season").agg(
        F.coalesce(F.max(F.col("week").cast("double")), F.lit(0.0)).alias("span"))


def season_teams(schedule: DataFrame) -> DataFrame:
    sides = F.inline(F.array(F.struct(F.col("home_team").alias("team")), F.struct(F.col("away_team").alias("team"))))
    return schedule.select("league", "season", sides).where("team IS NOT NULL").distinct()


def keeper_save_pct(keepers: DataFrame, save: str = "save_pct", minutes: str = "minutes") -> DataFrame:
    """Minutes-weighted save percentage per (team, season)."""
    m = lenient_double(minutes)
    return keepers.groupBy("team", "season").agg(
        F.sum(lenient_double(save) * m).alias("_w"), F.sum(m).alias("_m")
    ).where((F.col("_m") > 0) & F.col("team").isNotNull() & F.col("season").isNotNull()).select(
        "team", "season", (F.col("_w") / F.col("_m")).alias("gk_save"))


def squad_priors(players: DataFrame, keepers: DataFrame, goals: str = "gls", nineties: str = "nineties",
                 minutes: str = "minutes", age: str = "age", save: str = "save_pct") -> DataFrame:
    """Squad aggregates of one season keyed by the season that may use them, the next one."""
    g, n, m, a = (lenient_double(c) for c in (goals, nineties, minutes, age))
    squads = players.groupBy("team", "season").agg(
        F.sum(g).alias("_g"), F.sum(n).alias("_n"), F.sum(m).alias("_m"),
        F.sum(m * m).alias("_mm"), F.sum(a * m).alias("_am"),
    ).where((F.col("_n") > 0) & (F.col("_m") > 0) & F.col("team").isNotNull())
    use = next_season("season")
    return (
        squads.join(keeper_save_pct(keepers, save, minutes), ["team", "season"], "left").where(use.isNotNull())
        .select("team", use.alias("season"), (F.col("_g") / F.col("_n")).alias("gls90"),
                F.coalesce("gk_save", F.lit(0.0)).alias("gk_save"),
                (F.col("_mm") / (F.col("_m") * F.col("_m"))).alias("min_hhi"),
                (F.col("_am") / F.col("_m")).alias("age"))
    )


def join_priors(matches: DataFrame, priors: DataFrame) -> DataFrame:
    """Both sides' priors by (team, season), league ignored so promoted clubs keep theirs."""
    out = matches
    for side in ("home", "away"):
        named = priors.select(
            F.col("team").alias(f"{side}_team"), "season",
            *[F.col(c).alias(f"{side}_{c}") for c in ("gls90", "gk_save", "min_hhi", "age")])
        out = out.join(named, [f"{side}_team", "season"], "left")
    return out


def unmapped_names(names: DataFrame, name_map: DataFrame) -> DataFrame:
    """Source names (league, season, source_name) with no mapping."""
    return names.join(name_map, ["league", "season", "source_name"], "left_anti")
