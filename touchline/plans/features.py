"""The leak-free feature table, team snapshots and features of unplayed fixtures."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from touchline.config import EVENT_STATS, GOAL_TARGETS, NUMERIC_FEATURES, PER_SIDE, STAT_TARGETS, UNK_INDEX, UNK_TOKEN, FeatureConfig
from touchline.functions.scalars import (
    clamp, coerce_date, cold_start, epoch_micros, game_day, micros_days, orient, outcome_label, parse_score, points,
    prev_season, season_progress, whole_days,
)
from touchline.operators.aggregates import event_team_stats, season_span, season_teams, two_team_games
from touchline.operators.matching import event_name_map
from touchline.operators.ordering import dense_index, row_index
from touchline.operators.ratings import elo, latest_ratings
from touchline.operators.rolling import Scan, Trackers, block_states, prior_states
from touchline.session import materialize, passing

ORDER = ("date", "game", "game_id")
SCHEDULE_COLUMNS = ("league", "season", "game", "game_id", "date", "week", "home_team", "away_team", "score")


def scan_schedule(schedule: DataFrame) -> DataFrame:
    """The nine columns in use; order is carried by windows and the row index, not by a global sort."""
    return schedule.select(*SCHEDULE_COLUMNS)


def parsed_matches(schedule: DataFrame) -> DataFrame:
    """Schedule with the date parsed, goals, label and the reason a row cannot be used (null if it can)."""
    home, away = parse_score("score")
    reason = (
        F.when(F.col("home_goals").isNull() | F.col("away_goals").isNull(), "score")
        .when(F.col("date").isNull(), "date")
        .when(F.col("home_team").isNull() | F.col("away_team").isNull(), "team")
        .when(F.col("league").isNull(), "league")
        .when(F.col("season").isNull(), "season")
        .when(F.col("home_team") == F.col("away_team"), "same_team")
    )
    return (
        scan_schedule(schedule)
        .withColumns({"date": coerce_date("date"), "home_goals": home, "away_goals": away})
        .withColumns({"label": outcome_label("home_goals", "away_goals"), "reject_reason": reason})
    )


def valid_matches(parsed: DataFrame) -> DataFrame:
    return parsed.where("reject_reason IS NULL").drop("reject_reason", "score")


def match_quarantine(parsed: DataFrame) -> DataFrame:
    return parsed.where("reject_reason IS NOT NULL")


def attach_event_targets(matches: DataFrame, games: DataFrame) -> DataFrame:
    """Left join of event statistics by (league, season, day, unordered pair), oriented by the schedule.

    Adds home_<stat>, away_<stat> (0 without coverage) and targets_present.
    """
    keyed = matches.withColumns({
        "day": game_day("date"),
        "pair_lo": F.least("home_team", "away_team"), "pair_hi": F.greatest("home_team", "away_team")})
    joined = keyed.join(games, ["league", "season", "day", "pair_lo", "pair_hi"], "left")
    covered, home_is_lo = F.col("event_game_id").isNotNull(), F.col("home_team") == F.col("pair_lo")
    stats = {}
    for c in EVENT_STATS:
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        stats[f"home_{c}"] = F.coalesce(F.when(home_is_lo, lo).otherwise(hi), F.lit(0))
        stats[f"away_{c}"] = F.coalesce(F.when(home_is_lo, hi).otherwise(lo), F.lit(0))
    return joined.withColumns({**stats, "targets_present": covered.cast("int")}).drop(
        "day", "pair_lo", "pair_hi", "event_game_id", *[f"{s}_{c}" for s in ("lo", "hi") for c in EVENT_STATS])


def indexed_matches(parsed: DataFrame, events: DataFrame | None = None,
                    cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Valid matches with event targets and their global chronological row_idx.

    ``parsed`` comes from ``parsed_matches`` and is best written out first, as several steps read it.
    """
    matches = valid_matches(parsed)
    if events is None:
        none = {f"{s}_{c}": F.lit(0).cast("long") for s in ("home", "away") for c in EVENT_STATS}
        matches = matches.withColumns({**none, "targets_present": F.lit(0)})
        return row_index(matches, ORDER)
    with passing(parsed.sparkSession) as keep:
        stats = materialize(event_team_stats(events))
        names = event_name_map(stats, season_teams(parsed), cfg.name_threshold)
        return keep(row_index(attach_event_targets(matches, two_team_games(stats, names)), ORDER))


def team_rows(matches: DataFrame) -> DataFrame:
    """Two rows per match, one per side, built in one scan. A match without goals adds nothing to anyone's history."""
    played, covered = F.col("home_goals").isNotNull(), F.col("targets_present") == 1

    def side(me: str, other: str, home: bool) -> Column:
        def stat(who: str, c: str) -> Column:
            return F.when(covered, F.col(f"{who}_{c}").cast("double"))

        return F.struct(
            F.col(f"{me}_team").alias("team"), F.lit(home).alias("is_home"),
            F.col(f"{me}_goals").cast("double").alias("gf"), F.col(f"{other}_goals").cast("double").alias("ga"),
            F.when(played, points(f"{me}_goals", f"{other}_goals")).alias("pts"),
            stat(me, "sot").alias("sot"), stat(me, "shots").alias("shots"),
            stat(other, "shots").alias("shots_against"), stat(me, "box_shots").alias("box_shots"),
            stat(me, "deep_comp").alias("deep_comp"))

    return matches.select(
        "row_idx", "date", F.when(played, F.col("date")).alias("played_on"), "season", F.inline(F.array(side("home", "away", True), side("away", "home", False))))


def trackers(cfg: FeatureConfig) -> tuple[Trackers, Trackers, Trackers]:
    a = cfg.ema_alpha
    return (
        Trackers({"gf_ema": "gf", "ga_ema": "ga", "pts_ema": "pts"}, "played", a),
        Trackers({"venue_gf_ema": "gf", "venue_ga_ema": "ga", "venue_pts_ema": "pts"}, "venue_played", a, ("is_home",)),
        Trackers({"sot_ema": "sot", "shots_ema": "shots", "shots_against_ema": "shots_against",
                  "box_shots_ema": "box_shots", "deep_comp_ema": "deep_comp"}, "ws_played", a),
    )


def season_debuts(rows: DataFrame) -> DataFrame:
    """First match of each team in each season; one row per (team, season)."""
    return rows.where("played_on IS NOT NULL").groupBy("team", "season").agg(F.min("row_idx").alias("debut"))


def new_to_season(rows: DataFrame, debuts: DataFrame) -> DataFrame:
    """1 if the team has no earlier match in the previous season; 0 for a malformed season code."""
    earlier = debuts.select("team", F.col("season").alias("_prev"), F.col("debut").alias("_debut"))
    return rows.withColumn("_prev", prev_season("season")).join(earlier, ["team", "_prev"], "left").withColumn(
        "new_to_season",
        F.when(F.col("_prev").isNull(), 0.0).when(F.col("_debut") < F.col("row_idx"), 0.0).otherwise(1.0)
    ).drop("_prev", "_debut")


def date_features(cfg: FeatureConfig, previous: Sequence[Column], date: str = "date", days=whole_days) -> dict[str, Column]:
    """Rest days and congestion from the last few prior dates, latest first; null where there are fewer."""
    def counted(d: Column) -> Column:
        apart = days(d, date)
        return F.when((apart >= 0) & (apart <= cfg.congestion_window_days), 1.0).otherwise(0.0)

    rest = clamp(days(previous[0], date).cast("double"), 0.0, cfg.max_rest_days)
    return {
        "rest_days": F.coalesce(rest, F.lit(cfg.default_rest_days)),
        "congestion14": reduce(add, [counted(d) for d in previous]),
    }


def _previous_dates(cfg: FeatureConfig) -> list[Column]:
    return [F.col(f"prev_{i}") for i in range(1, cfg.congestion_memory + 1)]


def side_features(rows: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """The 17 per-side features of each team row, from strictly prior matches. Dates are made numbers once, before they are compared."""
    timed = rows.withColumns({"_now": epoch_micros("date"), "_on": epoch_micros("played_on")})
    prior = prior_states(timed, ["team"], ["row_idx"], trackers(cfg), ("_on", "prev", cfg.congestion_memory),
                         ("row_idx", "team", "is_home", "season", "_now"))
    flagged = new_to_season(prior, materialize(season_debuts(rows)))  # written, so its size decides how it is joined
    emas = {o: cold_start(o) for t in trackers(cfg) for o in t.values}
    return flagged.withColumns({
        **emas, **date_features(cfg, _previous_dates(cfg), "_now", micros_days),
        "played": F.col("played").cast("double"), "venue_played": F.col("venue_played").cast("double"),
        "ws_cov": (F.col("ws_played") > 0).cast("double"),
    }).select("row_idx", "team", "is_home", *PER_SIDE)


def pair_rows(matches: DataFrame) -> DataFrame:
    gd = (F.col("home_goals") - F.col("away_goals")).cast("double")
    return matches.select(
        "row_idx", "home_team", "away_team", F.least("home_team", "away_team").alias("pair_lo"),
        F.greatest("home_team", "away_team").alias("pair_hi"),
        orient("home_team", "away_team", gd).alias("oriented_gd"))


def head_to_head(matches: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """row_idx, h2h_played (capped) and h2h_gd_ema seen from the home side."""
    prior = prior_states(
        pair_rows(matches), ["pair_lo", "pair_hi"], ["row_idx"],
        [Trackers({"_gd": "oriented_gd"}, "_met", cfg.ema_alpha)], keep=("row_idx", "home_team", "away_team"))
    return prior.select(
        "row_idx", F.least(F.col("_met"), F.lit(cfg.h2h_played_cap)).cast("double").alias("h2h_played"),
        orient("home_team", "away_team", cold_start("_gd")).alias("h2h_gd_ema"))


def differences() -> dict[str, Column]:
    return {
        "gf_ema_diff": F.col("h_gf_ema") - F.col("a_gf_ema"),
        "ga_ema_diff": F.col("h_ga_ema") - F.col("a_ga_ema"),
        "pts_ema_diff": F.col("h_pts_ema") - F.col("a_pts_ema"),
        "elo_diff": F.col("home_elo") - F.col("away_elo"),
        "venue_pts_ema_diff": F.col("h_venue_pts_ema") - F.col("a_venue_pts_ema"),
    }


def both_sides(sides: DataFrame) -> DataFrame:
    """Team rows back to one row per match with h_ and a_ columns."""
    return sides.groupBy("row_idx").agg(*[
        F.max(F.when(F.col("is_home") == home, F.col(c))).alias(f"{p}_{c}")
        for p, home in (("h", True), ("a", False)) for c in PER_SIDE])


TEAM_VALUES = ("gf", "ga", "pts", "sot", "shots", "shots_against", "box_shots", "deep_comp")
MICROS_A_DAY = 86_400_000_000


def _team_table(rows: pa.Table) -> pa.Table:
    """``team_rows`` of a block of played matches: all home sides, then all away sides."""
    def doubles(name: str) -> np.ndarray:
        return rows[name].cast(pa.float64()).to_numpy()

    open_ = rows["targets_present"].to_numpy() != 1
    out: dict[str, list] = {c: [] for c in ("row_idx", "team", "is_home", "_on", *TEAM_VALUES)}
    for me, other in (("home", "away"), ("away", "home")):
        f, a = doubles(f"{me}_goals"), doubles(f"{other}_goals")
        here = {"row_idx": rows["row_idx"], "team": rows[f"{me}_team"], "is_home": pa.array(np.full(len(f), me == "home")),
                "_on": rows["date"].cast(pa.int64()), "gf": pa.array(f), "ga": pa.array(a), "pts": pa.array(np.where(f > a, 3.0, np.where(f == a, 1.0, 0.0)))}
        here |= {c: pa.array(doubles(f"{me}_{c}"), mask=open_) for c in ("sot", "shots", "box_shots", "deep_comp")}
        here["shots_against"] = pa.array(doubles(f"{other}_shots"), mask=open_)
        for c, values in here.items():
            out[c] += values.chunks if isinstance(values, pa.ChunkedArray) else [values]
    return pa.table({c: pa.chunked_array(v) for c, v in out.items()})


def _pair_table(rows: pa.Table) -> pa.Table:
    """``pair_rows`` of a block of played matches."""
    home, away, turned = rows["home_team"], rows["away_team"], pc.greater(rows["home_team"], rows["away_team"])
    gd = (rows["home_goals"].cast(pa.int64()).to_numpy() - rows["away_goals"].cast(pa.int64()).to_numpy()).astype(float)
    return pa.table({"row_idx": rows["row_idx"], "pair_lo": pc.if_else(turned, away, home), "pair_hi": pc.if_else(turned, home, away),
                     "oriented_gd": pa.array(np.where(turned.to_numpy(), -gd, gd))})


def _block_features(cfg: FeatureConfig, columns: Sequence[str]):
    """A block's matches with the histories of both teams and of the pair and both ratings, as ``side_features`` and ``head_to_head`` have them."""
    emas = {o for t in trackers(cfg) for o in t.values}

    def filled(column: pa.ChunkedArray) -> np.ndarray:
        return column.cast(pa.float64()).fill_null(0.0).to_numpy()

    def finish(rows: pa.Table, tables: list[pa.Table], ratings: pa.Table) -> pa.Table:
        teams, pairs = tables
        n, now = rows.num_rows, teams["_on"].to_numpy()
        side = {o: filled(teams[o]) for o in (*emas, "played", "venue_played")}
        side["ws_cov"] = (teams["ws_played"].to_numpy() > 0).astype(float)
        side["congestion14"] = np.zeros(2 * n)
        for i in range(1, cfg.congestion_memory + 1):
            known = teams[f"prev_{i}"].is_valid().to_numpy()
            apart = np.floor((now - teams[f"prev_{i}"].fill_null(0).to_numpy()) / float(MICROS_A_DAY))
            side["congestion14"] += known & (apart >= 0) & (apart <= cfg.congestion_window_days)
            if i == 1:
                side["rest_days"] = np.where(known, np.clip(apart, 0.0, cfg.max_rest_days), cfg.default_rest_days)
        out = {f"{p}_{c}": pa.array(side[c][part]) for p, part in (("h", slice(0, n)), ("a", slice(n, 2 * n))) for c in PER_SIDE if c in side}
        out["h2h_played"] = pa.array(np.minimum(pairs["_met"].to_numpy(), cfg.h2h_played_cap).astype(float))
        gd = filled(pairs["_gd"])
        out["h2h_gd_ema"] = pa.array(np.where(pc.greater(rows["home_team"], rows["away_team"]).to_numpy(), -gd, gd))
        order = np.argsort(ratings["row_idx"].to_numpy())
        place = order[np.searchsorted(ratings["row_idx"].to_numpy()[order], rows["row_idx"].to_numpy())] if n else order[:0]
        out |= {c: ratings[c].take(pa.array(place)) for c in ("home_elo", "away_elo")}
        return pa.table({**{c: rows[c] for c in columns}, **out})

    made = [f"{p}_{c}" for p in "ha" for c in PER_SIDE if c != "new_to_season"]
    return finish, [*made, "h2h_played", "h2h_gd_ema", "home_elo", "away_elo"]


def with_histories(matches: DataFrame, coded: DataFrame, ratings: DataFrame, keep: Sequence[str], cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """``keep`` of ``coded`` (``matches`` with more columns), with the features of both sides and of the pair and the ratings.

    Both histories are filled in where a block's matches lie, so what leaves a task is one row per match and no side is joined to the other.
    """
    rows = team_rows(matches)
    debuts = materialize(season_debuts(rows))  # written, so its size decides how it is joined
    for side, p in (("home", "h"), ("away", "a")):
        coded = new_to_season(coded.withColumn("team", F.col(f"{side}_team")), debuts).withColumnRenamed("new_to_season", f"{p}_new_to_season").drop("team")
    keep = [*keep, "h_new_to_season", "a_new_to_season"]
    inputs = ["row_idx", "home_team", "away_team", "date", "home_goals", "away_goals", "targets_present", *[
        f"{s}_{c}" for s in ("home", "away") for c in ("sot", "shots", "box_shots", "deep_comp")]]
    narrow = coded.select(*dict.fromkeys([*keep, *inputs]))
    finish, made = _block_features(cfg, keep)
    schema = T.StructType([*[narrow.schema[c] for c in keep], *[T.StructField(c, T.DoubleType()) for c in made]])
    scans = [Scan(rows.withColumn("_on", epoch_micros("played_on")), _team_table, ("team",), trackers(cfg), ("_on", "prev", cfg.congestion_memory)),
             Scan(pair_rows(matches), _pair_table, ("pair_lo", "pair_hi"), (Trackers({"_gd": "oriented_gd"}, "_met", cfg.ema_alpha),))]
    return block_states(narrow, "row_idx", scans, ratings, finish, schema)


def vocabulary(schedule: DataFrame) -> DataFrame:
    """(kind, value, idx): sorted values from 1 per kind over all rows, 0 is the unknown value."""
    def entry(kind: str, column: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(column).alias("value"))

    values = schedule.select(F.inline(F.array(
        entry("team", "home_team"), entry("team", "away_team"), entry("league", "league"), entry("season", "season")
    ))).where("value IS NOT NULL")
    unknown = schedule.sparkSession.createDataFrame(
        [(k, UNK_TOKEN, UNK_INDEX) for k in ("team", "league", "season")], "kind string, value string, idx long")
    return dense_index(values, ["kind"], "value").select("kind", "value", "idx").unionByName(unknown)


def vocabulary_sizes(vocab: DataFrame) -> DataFrame:
    return vocab.groupBy("kind").agg(F.count(F.lit(1)).alias("size"))


def encode_categories(df: DataFrame, vocab: DataFrame) -> DataFrame:
    """Adds the four index columns; a value not in the vocabulary becomes 0."""
    out = df
    for kind, source, target in (("team", "home_team", "home_team_idx"), ("team", "away_team", "away_team_idx"),
                                 ("league", "league", "league_idx"), ("season", "season", "season_idx")):
        codes = vocab.where(F.col("kind") == kind).select(F.col("value").alias(source), F.col("idx").alias(target))
        out = out.join(codes, source, "left").withColumn(target, F.coalesce(target, F.lit(UNK_INDEX).cast("long")))
    return out


def add_progress(df: DataFrame, spans: DataFrame) -> DataFrame:
    return df.join(spans, ["league", "season"], "left").withColumn(
        "season_progress", season_progress("week", F.coalesce("span", F.lit(0.0)))).drop("span")


def feature_table(schedule: DataFrame, events: DataFrame | None = None,
                  cfg: FeatureConfig = FeatureConfig(), vocab: DataFrame | None = None) -> DataFrame:
    """One row per valid match: identity, encodings, label, targets and the 44 numeric features."""
    parsed = materialize(parsed_matches(schedule))
    return feature_rows(parsed, indexed_matches(parsed, events, cfg), cfg, vocab)


def feature_rows(parsed: DataFrame, matches: DataFrame, cfg: FeatureConfig = FeatureConfig(), vocab: DataFrame | None = None,
                 replayed: DataFrame | None = None) -> DataFrame:
    """The feature table of ``indexed_matches`` and their ratings by ``elo``, which other steps may read as well.

    Vocabulary and spans are written once, so the four code joins read one small table and are broadcast only when its size
    allows; codes are attached while rows are narrow.
    """
    ratings = (elo(matches, cfg.elo_base, cfg.elo_k) if replayed is None else replayed).select("row_idx", "home_elo", "away_elo")
    codes = materialize(vocabulary(parsed) if vocab is None else vocab)
    coded = encode_categories(add_progress(matches, materialize(season_span(parsed))), codes)
    about = ("row_idx", "game", "game_id", "date", "league", "season", "home_team_idx", "away_team_idx", "league_idx", "season_idx", "label")
    targets = (*GOAL_TARGETS, *STAT_TARGETS)
    made = with_histories(matches, coded, ratings, (*about, *targets, "targets_present", "season_progress"), cfg).withColumns(differences())
    return made.select(*about, *[F.col(c).cast("double").alias(c) for c in targets], "targets_present", *NUMERIC_FEATURES)


@dataclass(frozen=True)
class History:
    """What is known after the last match: per team, per pair and per (team, season)."""

    team_state: DataFrame
    h2h_state: DataFrame
    appearances: DataFrame


def _after(rows: DataFrame) -> Column:
    """The first row index that no row has."""
    return F.coalesce(rows.agg(F.max("row_idx")).scalar() + 1, F.lit(0)).cast("long")


def team_state(matches: DataFrame, cfg: FeatureConfig = FeatureConfig(), replayed: DataFrame | None = None) -> DataFrame:
    """Snapshot per team after its last match.

    One closing row per team and venue is put after the history and reads its prior state, so the
    snapshot comes out of the same operator as the training features.
    """
    rows = team_rows(matches)
    empty = {c: F.lit(None).cast("double") for c in ("gf", "ga", "pts", "sot", "shots", "shots_against",
                                                     "box_shots", "deep_comp")}
    closing = (
        rows.groupBy("team").agg(F.max("row_idx").alias("last_row"), F.max_by("date", "row_idx").alias("last_date"))
        .withColumn("is_home", F.explode(F.array(F.lit(True), F.lit(False))))
        .withColumns({**empty, "row_idx": _after(rows) + F.col("is_home").cast("long"),
                      "date": F.lit(None).cast("timestamp_ntz"), "played_on": F.lit(None).cast("timestamp_ntz"), "season": F.lit(None).cast("string"),
                      "closing": F.lit(True)})
    )
    both = rows.withColumn("closing", F.lit(False)).unionByName(closing, allowMissingColumns=True)
    prior = prior_states(both, ["team"], ["row_idx"], trackers(cfg),
                         ("played_on", "prev", cfg.congestion_memory), only="closing").where("closing")
    whole = ("gf_ema", "ga_ema", "pts_ema", "sot_ema", "shots_ema", "shots_against_ema", "box_shots_ema",
             "deep_comp_ema")
    at = {v: F.col("is_home") == v for v in (True, False)}
    snapshot = prior.groupBy("team").agg(
        F.max("played").alias("played"), F.max("ws_played").alias("ws_played"),
        F.max("last_date").alias("last_date"), F.max(F.array_compact(F.array(*_previous_dates(cfg)))).alias("recent_dates"),
        *[F.max(c).alias(c) for c in whole],
        *[F.max(F.when(at[v], F.col(f"venue_{c}"))).alias(f"{side}_{c}")
          for side, v in (("home", True), ("away", False)) for c in ("gf_ema", "ga_ema", "pts_ema", "played")])
    ratings = latest_ratings(matches, elo(matches, cfg.elo_base, cfg.elo_k) if replayed is None else replayed)
    return snapshot.join(ratings, "team")


def h2h_state(matches: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Per unordered pair: meetings so far and goal-difference average seen from the smaller name."""
    rows = pair_rows(matches).withColumn("closing", F.lit(False))
    closing = rows.select("pair_lo", "pair_hi").distinct().withColumns(
        {"row_idx": _after(rows), "closing": F.lit(True)})
    prior = prior_states(
        rows.unionByName(closing, allowMissingColumns=True), ["pair_lo", "pair_hi"], ["row_idx"],
        [Trackers({"gd_ema": "oriented_gd"}, "met", cfg.ema_alpha)], only="closing")
    return prior.where("closing").select("pair_lo", "pair_hi", "met", "gd_ema")


def history(matches: DataFrame, cfg: FeatureConfig = FeatureConfig(), replayed: DataFrame | None = None) -> History:
    return History(
        materialize(team_state(matches, cfg, replayed)), materialize(h2h_state(matches, cfg)),
        team_rows(matches).select("team", "season").distinct())


def has_history(teams: DataFrame, state: DataFrame) -> DataFrame:
    return teams.join(state, "team", "left_semi")


def peek_features(fixtures: DataFrame, known: History, cfg: FeatureConfig = FeatureConfig(),
                  spans: DataFrame | None = None) -> DataFrame:
    """Features of unplayed fixtures from the snapshots, state left as it is.

    ``fixtures``: fixture_id, date, league, season, home_team, away_team and either season_progress or
    week (with ``spans``). Adds home_known and away_known.
    """
    out = fixtures
    for side, p in (("home", "h"), ("away", "a")):
        s = known.team_state
        renamed = s.select(F.col("team").alias(f"{side}_team"), *[
            F.col(c).alias(f"_{p}_{c}") for c in s.columns if c != "team"])
        seen = known.appearances.select(
            F.col("team").alias(f"{side}_team"), F.col("season").alias("_prev"), F.lit(True).alias(f"_{p}_seen"))
        out = (
            out.join(renamed, f"{side}_team", "left").withColumn("_prev", prev_season("season"))
            .join(seen, [f"{side}_team", "_prev"], "left")
        )
        plain = {f"{p}_{c}": cold_start(f"_{p}_{c}") for c in (
            "gf_ema", "ga_ema", "sot_ema", "pts_ema", "shots_ema", "shots_against_ema", "box_shots_ema",
            "deep_comp_ema")}
        venue = {f"{p}_venue_{c}": cold_start(F.col(f"_{p}_{side}_{c}").cast("double"))
                 for c in ("gf_ema", "ga_ema", "pts_ema", "played")}
        previous = [F.get(f"_{p}_recent_dates", F.lit(i)) for i in range(cfg.congestion_memory)]
        dates = {f"{p}_{k}": v for k, v in date_features(cfg, previous).items()}
        out = out.withColumns({
            **plain, **venue, **dates,
            f"{p}_played": cold_start(F.col(f"_{p}_played").cast("double")),
            f"{p}_ws_cov": (F.coalesce(f"_{p}_ws_played", F.lit(0)) > 0).cast("double"),
            f"{p}_new_to_season": F.when(F.col("_prev").isNull() | F.col(f"_{p}_seen").isNotNull(), 0.0).otherwise(1.0),
            f"{side}_elo": cold_start(f"_{p}_elo", cfg.elo_base),
            f"{side}_known": F.col(f"_{p}_played").isNotNull(),
        }).drop("_prev")
    pairs = out.withColumns({"pair_lo": F.least("home_team", "away_team"), "pair_hi": F.greatest("home_team", "away_team")})
    out = pairs.join(known.h2h_state, ["pair_lo", "pair_hi"], "left").withColumns({
        "h2h_played": F.least(F.coalesce("met", F.lit(0)), F.lit(cfg.h2h_played_cap)).cast("double"),
        "h2h_gd_ema": orient("home_team", "away_team", cold_start("gd_ema")), **differences()})
    if spans is not None:
        out = add_progress(out, spans)
    elif "season_progress" not in out.columns:
        out = out.withColumn("season_progress", F.lit(0.0))
    return out.select(*fixtures.drop("season_progress").columns, "home_known", "away_known", *NUMERIC_FEATURES)


def peek_as_of(fixtures: DataFrame, matches: DataFrame, cfg: FeatureConfig = FeatureConfig(), spans: DataFrame | None = None) -> DataFrame:
    """Features of fixtures of any date, each from the matches before it in (date, game, game_id); later ones stay unseen.

    ``fixtures``: fixture_id, date, league, season, home_team, away_team, a game (without one: before all matches of its date) and either
    season_progress or week (with ``spans``). ``matches``: ``indexed_matches``. Fixtures are put among the matches as rows without
    goals, so one ordered pass of the operators that make the training features gives both the histories and what each fixture sees.
    """
    game = F.col("game") if "game" in fixtures.columns else F.lit("")
    asked = fixtures.select(
        "date", game.alias("game"), F.col("fixture_id").cast("string").alias("game_id"), "season", "home_team", "away_team",
        F.lit(True).alias("_fixture"))
    history = matches.select(*[c for c in matches.columns if c in {
        "date", "game", "game_id", "season", "home_team", "away_team", "home_goals", "away_goals", "targets_present",
        *[f"{s}_{c}" for s in ("home", "away") for c in EVENT_STATS]}]).withColumn("_fixture", F.lit(False))
    # A fixture stands before a match of its own id.
    both = row_index(history.unionByName(asked, allowMissingColumns=True).withColumn("_after", ~F.col("_fixture")), (*ORDER, "_after"))
    rows = team_rows(both)
    # A fixture without a team is rated against a name that no one has.
    named = both.withColumns({c: F.coalesce(c, F.concat(F.lit(f"\0{c}"), F.col("row_idx").cast("string"))) for c in ("home_team", "away_team")})
    ratings = elo(named, cfg.elo_base, cfg.elo_k).select("row_idx", "home_elo", "away_elo")
    out = (
        both.where("_fixture").select("row_idx", F.col("game_id").alias("_id"))
        .join(both_sides(side_features(rows, cfg)), "row_idx").join(head_to_head(both, cfg), "row_idx").join(ratings, "row_idx")
        .withColumns({**differences(), "home_known": F.col("h_played") > 0, "away_known": F.col("a_played") > 0}))
    given = add_progress(fixtures, spans) if spans is not None else fixtures
    if "season_progress" not in given.columns:
        given = given.withColumn("season_progress", F.lit(0.0))
    joined = given.withColumn("_id", F.col("fixture_id").cast("string")).join(out, "_id")
    return joined.select(*fixtures.drop("season_progress").columns, "home_known", "away_known", *NUMERIC_FEATURES)
