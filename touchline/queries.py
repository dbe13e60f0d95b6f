"""Registered queries: each reads the base tables under a folder and returns a DataFrame."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from touchline.config import EVENT_STATS, NUMERIC_FEATURES, STAT_TARGETS, FeatureConfig, LossConfig, ModelConfig, SplitConfig
from touchline.functions import outcomes as oc
from touchline.functions import scalars as sc
from touchline.functions.names import normalize_names, token_jaccard
from touchline.operators import aggregates as ag
from touchline.operators import calibrate as cal
from touchline.operators import matching, metrics as mt, ordering, ratings, scaling
from touchline.operators.rolling import prior_states
from touchline.plans import evaluate as ev
from touchline.plans import features as ft
from touchline.plans import store
from touchline.plans import training as tr
from touchline.plans.predict import predict_fixtures
from touchline.session import checkpoint_dir, materialize, passing, settled
from touchline.sources import clean, dynamic, landed, pages, tables  # noqa: F401  pages registers its reader
from touchline.streaming import landing, live
from touchline.views import view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CFG = FeatureConfig()
ID = ("l_orderkey", "l_linenumber", "l_partkey")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, without negative zeros."""
    def short(f: T.StructField):
        c = F.col(f"`{f.name}`")
        return ((F.round(c + F.lit(0.0), 6) + F.lit(0.0)) if isinstance(f.dataType, T.DoubleType) else c).alias(f.name)

    return df.select(*[short(f) for f in df.schema.fields])


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def schedule(spark, sf):
    return view(spark, sf, "v_schedule")


def events(spark, sf):
    return view(spark, sf, "v_match_events")


def parsed(spark, sf):
    return ft.parsed_matches(schedule(spark, sf))


def valid(spark, sf):
    return ft.valid_matches(parsed(spark, sf))


def indexed(spark, sf, with_events=False):
    return ft.indexed_matches(materialize(parsed(spark, sf)), events(spark, sf) if with_events else None, CFG)


def predictions(spark, sf):
    """Probabilities to twelve digits, so that a tie between classes is a tie in both engines."""
    scored = oc.outcome_probs(view(spark, sf, "v_predictions"), "rate_home", "rate_away", "rho")
    return scored.withColumns({p: F.round(p, 12) for p in mt.PROBS})


def date_text(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm:ss"))


# Events and their targets

@query
def event_team_stats(spark, sf):
    return ag.event_team_stats(events(spark, sf)).select("game_id", "team", "game", "league", "season", *EVENT_STATS)


def _games(spark, sf):
    stats = materialize(ag.event_team_stats(events(spark, sf)))
    names = matching.event_name_map(stats, ag.season_teams(schedule(spark, sf)), CFG.name_threshold)
    return stats, names


@query
def two_team_games(spark, sf):
    return ag.two_team_games(*_games(spark, sf))


@query
def attach_event_targets(spark, sf):
    joined = ft.attach_event_targets(valid(spark, sf), ag.two_team_games(*_games(spark, sf)))
    return joined.select("game_id", "league", "season", "home_team", "away_team", "targets_present",
                         *[f"{s}_{c}" for s in ("home", "away") for c in EVENT_STATS])


@query
def unmapped_names(spark, sf):
    stats, names = _games(spark, sf)
    return ag.unmapped_names(
        stats.select("league", "season", F.col("team").alias("source_name")).distinct(), names)


@query
def feature_coverage(spark, sf):
    p = materialize(parsed(spark, sf))
    stats, names = _games(spark, sf)
    matches = ft.attach_event_targets(ft.valid_matches(p), ag.two_team_games(stats, names))
    lost = ag.unmapped_names(stats.select("league", "season", F.col("team").alias("source_name")).distinct(), names)
    return rounded(ev.coverage_report(p, matches, ag.paired_games(stats, names), lost))


# Schedule, scalars, seasons

@query
def parsed_matches(spark, sf):
    return date_text(valid(spark, sf)).withColumn("week", F.col("week").cast("double"))


@query
def match_quarantine(spark, sf):
    return ft.match_quarantine(parsed(spark, sf)).select("game_id", "game", "score", "reject_reason")


@query
def match_points(spark, sf):
    return valid(spark, sf).select(
        "game_id", sc.points("home_goals", "away_goals").alias("home_points"),
        sc.points("away_goals", "home_goals").alias("away_points"),
        sc.rating_score("home_goals", "away_goals").alias("rating_score"))


@query
def season_codes(spark, sf):
    return schedule(spark, sf).select("season").distinct().select(
        "season", sc.prev_season("season").alias("prev_season"), sc.next_season("season").alias("next_season"))


@query
def season_span(spark, sf):
    return ag.season_span(schedule(spark, sf))


@query
def season_teams(spark, sf):
    return ag.season_teams(schedule(spark, sf))


@query
def season_progress(spark, sf):
    s = schedule(spark, sf)
    return rounded(ft.add_progress(s, ag.season_span(s)).select("game_id", "season_progress"))


@query
def ordinal_days(spark, sf):
    return valid(spark, sf).select("game_id", sc.ordinal_day("date").alias("day"))


@query
def lenient_numbers(spark, sf):
    p = view(spark, sf, "v_players")
    return p.select("team", "season", "age", "minutes", "nineties",
                    *[sc.lenient_double(c).alias(f"{c}_value") for c in ("age", "minutes", "nineties")])


@query
def vocabulary(spark, sf):
    return ft.vocabulary(schedule(spark, sf))


@query
def vocabulary_sizes(spark, sf):
    return ft.vocabulary_sizes(ft.vocabulary(schedule(spark, sf)))


@query
def encoded_matches(spark, sf):
    s = schedule(spark, sf)
    return ft.encode_categories(s, ft.vocabulary(s)).select(
        "game_id", "home_team_idx", "away_team_idx", "league_idx", "season_idx")


# Order

@query
def row_index(spark, sf):
    return indexed(spark, sf).select("game_id", "row_idx")


@query
def temporal_split(spark, sf):
    return ordering.temporal_split(indexed(spark, sf).select("row_idx"), SplitConfig())


@query
def row_range_shard(spark, sf):
    m = indexed(spark, sf).select("row_idx", "game_id")
    n = m.count()
    return ordering.row_range(m, n // 4, n - n // 4, 3, 1)


@query
def seeded_shuffle(spark, sf):
    return ordering.seeded_shuffle(indexed(spark, sf).select("row_idx", "game_id"), 7)


# Rolling form

def _form(spark, sf, columns, with_events=False):
    rows = ft.team_rows(indexed(spark, sf, with_events))
    return rounded(ft.side_features(rows, CFG).select("row_idx", "team", "is_home", *columns))


@query
def team_form(spark, sf):
    t = ft.trackers(CFG)[0]
    rows = ft.team_rows(indexed(spark, sf))
    out = prior_states(rows, ["team"], ["row_idx"], [t])
    return rounded(out.select("row_idx", "team", "is_home", *[sc.cold_start(c).alias(c) for c in t.values]))


@query
def venue_form(spark, sf):
    t = ft.trackers(CFG)[1]
    rows = ft.team_rows(indexed(spark, sf))
    out = prior_states(rows, ["team"], ["row_idx"], [t])
    return rounded(out.select("row_idx", "team", "is_home", *[sc.cold_start(c).alias(c) for c in t.values]))


@query
def event_form(spark, sf):
    t = ft.trackers(CFG)[2]
    rows = ft.team_rows(indexed(spark, sf, True))
    out = prior_states(rows, ["team"], ["row_idx"], [t])
    return rounded(out.select("row_idx", "team", "is_home", *[sc.cold_start(c).alias(c) for c in t.values]))


@query
def prior_counts(spark, sf):
    return _form(spark, sf, ["played", "venue_played", "ws_cov"], True)


@query
def rest_days(spark, sf):
    return _form(spark, sf, ["rest_days"])


@query
def congestion(spark, sf):
    return _form(spark, sf, ["congestion14"])


@query
def new_to_season(spark, sf):
    rows = ft.team_rows(indexed(spark, sf))
    return ft.new_to_season(rows, ft.season_debuts(rows)).select("row_idx", "team", "is_home", "new_to_season")


@query
def head_to_head(spark, sf):
    return rounded(ft.head_to_head(indexed(spark, sf), CFG))


# Ratings

@query
def match_components(spark, sf):
    return ratings.components(schedule(spark, sf), "home_team", "away_team").select(
        F.col("vertex").alias("team"), "component")


@query
def elo_ratings(spark, sf):
    out = ratings.elo(indexed(spark, sf), CFG.elo_base, CFG.elo_k)
    return rounded(out.select("row_idx", "home_elo", "away_elo"))


# Feature table and snapshots

@query
def feature_table(spark, sf):
    return date_text(rounded(ft.feature_table(schedule(spark, sf), events(spark, sf), CFG)))


@query
def team_state(spark, sf):
    state = rounded(ft.team_state(indexed(spark, sf, True), CFG).drop("recent_dates"))
    return state.withColumn("last_date", F.date_format("last_date", "yyyy-MM-dd HH:mm:ss"))


@query
def h2h_state(spark, sf):
    return rounded(ft.h2h_state(indexed(spark, sf), CFG))


def _fixtures(p: DataFrame) -> DataFrame:
    """Unplayed rows of a parsed schedule, moved to the day after the last played match."""
    last = p.agg(F.max("date")).first()[0] + timedelta(days=3)
    return p.where("reject_reason = 'score'").select(
        F.col("game_id").alias("fixture_id"), F.lit(last).cast("timestamp_ntz").alias("date"),
        "league", "season", "home_team", "away_team", "week")


@query
def peek_features(spark, sf):
    known = ft.history(indexed(spark, sf, True), CFG)
    spans = ag.season_span(schedule(spark, sf))
    return rounded(ft.peek_features(_fixtures(parsed(spark, sf)), known, CFG, spans))


@query
def as_of_features(spark, sf):
    """Every played match asked for as a fixture of its own date: it sees what the feature table saw."""
    matches = indexed(spark, sf, True)
    asked = matches.select(F.col("game_id").alias("fixture_id"), "date", "game", "league", "season", "home_team", "away_team", "week")
    return rounded(ft.peek_as_of(asked, matches, CFG, ag.season_span(schedule(spark, sf))).select("fixture_id", *NUMERIC_FEATURES))


@query
def known_teams(spark, sf):
    state = ft.team_state(indexed(spark, sf), CFG)
    return ft.has_history(ag.season_teams(schedule(spark, sf)).select("team").distinct(), state)


# Names and squads

@query
def name_jaccard(spark, sf):
    n = normalize_names(view(spark, sf, "v_names"), "left_name", "lt", "lj")
    n = normalize_names(n, "right_name", "rt", "rj")
    return rounded(n.select("block", "left_name", "right_name", token_jaccard("lt", "rt").alias("jaccard")))


@query
def name_matches(spark, sf):
    n = view(spark, sf, "v_names")
    return matching.match_names(n.select("block", "left_name"), n.select("block", "right_name"), ["block"], CFG.name_threshold)


@query
def name_candidates(spark, sf):
    n = view(spark, sf, "v_names")
    left, right = (normalize_names(n.select("block", F.col(c).alias("name")).distinct(), "name")
                   for c in ("left_name", "right_name"))
    return matching.candidate_pairs(left, right, ["block"], CFG.name_threshold).select("block", "l_name", "r_name")


@query
def club_matches(spark, sf):
    """Spellings with accents, marks, stop words and missing tokens, aliases, and names no one is like enough to."""
    n = view(spark, sf, "v_clubs")
    return rounded(matching.match_names(n.select("block", "left_name"), n.select("block", "right_name"), ["block"], CFG.name_threshold))


@query
def club_unmapped(spark, sf):
    n = view(spark, sf, "v_clubs")
    named = {"league": F.col("block").cast("string"), "season": F.lit("all")}
    left = n.select("left_name", "block").distinct().withColumns(named)
    names = matching.match_names(left.drop("block"), n.select("right_name", "block").withColumns(named).drop("block"),
                                 ["league", "season"], CFG.name_threshold)
    return ag.unmapped_names(left.select("league", "season", F.col("left_name").alias("source_name")),
                             names.withColumnRenamed("left_name", "source_name"))


@query
def squad_priors(spark, sf):
    p = view(spark, sf, "v_players")
    return rounded(ag.squad_priors(p, p))


@query
def keeper_save_pct(spark, sf):
    return rounded(ag.keeper_save_pct(view(spark, sf, "v_players")))


@query
def match_priors(spark, sf):
    p = view(spark, sf, "v_players")
    out = ag.join_priors(valid(spark, sf), ag.squad_priors(p, p))
    return rounded(out.select("game_id", *[f"{s}_{c}" for s in ("home", "away") for c in ("gls90", "gk_save", "min_hhi", "age")]))


# Outcome probabilities

@query
def poisson_pmf(spark, sf):
    rates = view(spark, sf, "v_predictions").select("rate_home").distinct()
    return rounded(rates.select("rate_home", F.posexplode(oc.poisson_pmf("rate_home")).alias("k", "p")))


@query
def score_grid(spark, sf):
    rates = view(spark, sf, "v_predictions").select("rate_home", "rate_away", "rho").distinct()
    cells = oc.grid_cells(oc.score_grid("rate_home", "rate_away", "rho"))
    return rounded(rates.select("rate_home", "rate_away", "rho", F.inline(cells)))


@query
def outcome_probs(spark, sf):
    return rounded(predictions(spark, sf).select(*ID, *mt.PROBS))


@query
def temperature_scaled(spark, sf):
    scaled = oc.apply_temperature(mt.PROBS, 1.3)
    return rounded(predictions(spark, sf).select(*ID, *[c.alias(p) for c, p in zip(scaled, mt.PROBS)]))


@query
def picks(spark, sf):
    return predictions(spark, sf).select(
        *ID, oc.pick(*mt.PROBS).alias("pick_plain"), oc.pick(*mt.PROBS, 1.35).alias("pick_boosted"))


# Metrics

@query
def probability_metrics(spark, sf):
    return rounded(mt.probability_metrics(predictions(spark, sf)))


@query
def reliability(spark, sf):
    return rounded(mt.reliability_table(predictions(spark, sf)))


@query
def confusion(spark, sf):
    return mt.confusion(predictions(spark, sf))


@query
def class_report(spark, sf):
    return rounded(mt.classification_metrics(predictions(spark, sf)))


@query
def masked_mae(spark, sf):
    return rounded(view(spark, sf, "v_predictions").agg(
        mt.masked_mae("rate_home", "home_goals").alias("mae_home"),
        mt.masked_mae("rate_away", "away_goals").alias("mae_away")))


@query
def goal_mae(spark, sf):
    return rounded(view(spark, sf, "v_predictions").agg(*[c.alias(n) for n, c in mt.goal_mae().items()]))


@query
def poisson_nll(spark, sf):
    decay = sc.time_decay(F.lit(0), F.col("l_orderkey") % 1000, 390.0)
    return rounded(view(spark, sf, "v_predictions").agg(
        mt.poisson_nll().alias("plain"), mt.poisson_nll(decay).alias("decayed")))


@query
def outcome_nll(spark, sf):
    return rounded(predictions(spark, sf).agg(
        mt.outcome_nll().alias("plain"), mt.weighted_outcome_nll((0.8, 1.3, 0.9)).alias("weighted")))


@query
def masked_huber(spark, sf):
    pairs = [("rate_home", "home_goals"), ("rate_away", "away_goals")]
    return rounded(view(spark, sf, "v_predictions").agg(mt.masked_huber(pairs).alias("huber")))


@query
def composite_score(spark, sf):
    """Every term and weight differs, so none can stand in for another."""
    pairs = [("rate_home", "home_goals"), ("rate_away", "away_goals")]
    sot, corners, cards = mt.masked_huber(pairs), mt.masked_huber(pairs[:1]), mt.masked_huber(pairs[1:], delta=0.5)
    weights = LossConfig(lambda_outcome=0.7, lambda_sot=0.3, lambda_corners=0.2, lambda_cards=0.1)
    return rounded(predictions(spark, sf).agg(
        mt.composite_score(mt.poisson_nll(), mt.outcome_nll(), sot, corners, cards, weights).alias("composite")))


# Calibration

@query
def temperature_losses(spark, sf):
    return rounded(cal.temperature_losses(predictions(spark, sf)))


@query
def fit_temperature(spark, sf):
    return rounded(cal.fit_temperature(predictions(spark, sf)))


@query
def boost_scores(spark, sf):
    return rounded(cal.boost_scores(predictions(spark, sf)).select("boost", "accuracy", "macro_f1"))


@query
def tune_draw_boost(spark, sf):
    return rounded(cal.tune_draw_boost(predictions(spark, sf)))


@query
def decision_layer(spark, sf):
    d = cal.fit_decision_layer(predictions(spark, sf))
    return spark.createDataFrame([tuple(d.values())], ", ".join(f"{k} double" for k in d))


@query
def ensemble_average(spark, sf):
    return rounded(mt.ensemble_average(predictions(spark, sf), "l_orderkey", [*mt.PROBS, "rate_home"]))


@query
def run_summary(spark, sf):
    runs = ev.run_summary(view(spark, sf, "v_runs"), ("val_accuracy", "val_log_loss"))
    return rounded(runs.withColumns({
        "feature_counts": F.size("feature_counts").cast("long"), "seeds": F.size("seeds").cast("long")}))


@query
def history_summary(spark, sf):
    """Nested run rows appended to a history file, read back, flattened and summarised."""
    r = view(spark, sf, "v_runs")
    a, n = F.col("val_accuracy"), F.col("val_log_loss")
    nested = r.select(
        F.when(F.col("seed") != 4, F.col("tag")).alias("tag"), "seed", "num_numeric_features",
        F.struct(a.alias("accuracy"), n.alias("log_loss"), (a * 0.7137).alias("macro_f1")).alias("val"),
        F.struct((a * 0.3713).alias("accuracy"), (a * 0.1319).alias("macro_f1")).alias("test_argmax"),
        F.struct((n * 0.5717).alias("log_loss"), (n * 0.2917).alias("rps")).alias("test_prob"))
    path = scratch(spark, "history")
    tables.append_history(nested, path)
    runs = ev.run_summary(ev.flat_history(spark.read.schema(nested.schema).json(path)))
    return rounded(runs.withColumns({
        "feature_counts": F.array_join("feature_counts", ","),
        "seeds": F.array_join(F.transform("seeds", lambda x: F.concat_ws(":", x["seed"], x["n"])), ",")}))


@query
def unknown_targets(spark, sf):
    """Leagues that were chosen and are not there."""
    chosen = view(spark, sf, "nation").select(F.concat(F.lit("L"), "n_nationkey").alias("league"))
    return tables.unknown_choices(chosen, schedule(spark, sf).select("league").distinct(), "league")


@query
def resample_counts(spark, sf):
    """How often the first resample holds each row, by its index alone."""
    rows = indexed(spark, sf).select("row_idx")
    copies = tr.resampled(rows, 3, 1).groupBy("row_idx").count()
    return rows.join(copies, "row_idx", "left").agg(
        F.count(F.lit(1)).alias("rows"),
        (F.abs(F.sum("count") / F.count(F.lit(1)) - 1) < 0.05).alias("about_as_many"), (F.abs(
            F.avg(F.col("count").isNull().cast("int")) - 0.3679) < 0.05).alias("about_a_third_left_out"))


# Fitted statistics

@query
def normalization_stats(spark, sf):
    return rounded(scaling.normalization_stats(ft.team_rows(indexed(spark, sf)), ("gf", "ga", "pts")))


@query
def standardized(spark, sf):
    rows = ft.team_rows(indexed(spark, sf)).select("row_idx", "is_home", "gf", "ga", "pts")
    stats = scaling.load_stats(scaling.normalization_stats(rows, ("gf", "ga", "pts")))
    return rounded(scaling.standardize(rows, stats))


@query
def class_weights(spark, sf):
    return rounded(scaling.class_weights(valid(spark, sf), 0.5))


@query
def reference_day(spark, sf):
    return scaling.reference_day(valid(spark, sf))


@query
def time_decay(spark, sf):
    v = valid(spark, sf)
    latest = scaling.reference_day(v).first()["reference_day"]
    weighted = scaling.add_decay(v, 390.0, latest)
    mean = weighted.agg(F.avg("decay")).scalar()
    return rounded(weighted.select("game_id", (F.col("decay") / mean).alias("weight")))


# Sources and tables

@query
def repair_wrapped_json(spark, sf):
    """Real pages come back untouched; JSON put into a page comes back as JSON."""
    pages = view(spark, sf, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("origin"), F.col("html").alias("text"))
    wrapped = view(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.lit("event").alias("origin"),
        F.concat(F.lit("<html><head></head><body>"), "props", F.lit("</body></html>")).alias("text"))
    return pages.unionByName(wrapped).withColumn("text", landed.repair_wrapped_json("text"))


@query
def cleaned_orders(spark, sf):
    o = view(spark, sf, "orders").select(
        "o_orderkey", "o_orderdate", "o_orderstatus",
        F.when(F.col("o_orderkey") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("price"))
    tagged = clean.tag_provenance(clean.clean_values(o), "landed", F.concat(F.lit("L"), "o_orderstatus"), "9495")
    return tagged.drop("o_orderstatus")


@query
def flattened_lineitem(spark, sf):
    nested = view(spark, sf, "lineitem").select(
        F.struct(F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias(" line ")).alias("key"),
        F.struct(F.col("l_quantity").alias("quantity"), F.struct(F.col("l_tax").alias("tax")).alias("rate")).alias("amount"))
    return clean.flatten_columns(nested)


@query
def target_grid(spark, sf):
    return tables.seen_targets(schedule(spark, sf))


@query
def ingest_report(spark, sf):
    s = schedule(spark, sf)
    named = {"source": F.lit("table"), "collection": F.lit("schedule")}
    extra = s.select("league").distinct().withColumn("season", F.lit("0203"))
    targets = tables.seen_targets(s).unionByName(extra).withColumns(named)
    return tables.ingest_report(s.withColumns(named), targets).withColumn("rows", F.col("rows").cast("long"))


@query
def append_ignore(spark, sf):
    """The same rows loaded twice: the second load adds nothing."""
    rows = view(spark, sf, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("_league"), F.lit("all").alias("_season"))
    path, key = scratch(spark, "append"), ["key", "_league", "_season"]
    for _ in range(2):
        tables.append_table(rows, path, key)
    return tables.read_table(spark, path, rows.schema)


@query
def append_null_keys(spark, sf):
    """Three loads of rows of which some have a null in the key or in a partition column."""
    o = view(spark, sf, "orders")
    rows = o.select(
        F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey").cast("string")).alias("key"),
        F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderstatus")).alias("_league"), F.lit("all").alias("_season"))
    path, key = scratch(spark, "append-null"), ["key", "_league", "_season"]
    for _ in range(3):
        tables.append_table(rows, path, key)
    return tables.read_table(spark, path, rows.schema)


@query
def feature_table_written(spark, sf):
    """A table that was written, then refused a replacement whose index repeats."""
    rows = indexed(spark, sf).select("row_idx", "game_id")
    path = scratch(spark, "features")
    tables.write_feature_table(rows, path)
    with contextlib.suppress(ValueError):
        tables.write_feature_table(rows.withColumn("row_idx", F.col("row_idx") - F.col("row_idx") % 2), path)
    return tables.read_table(spark, path)


@query
def replace_partitions(spark, sf):
    """Two loads of the same partitions leave one copy."""
    rows = clean.tag_provenance(clean.clean_values(schedule(spark, sf)), "landed", F.col("league"), F.col("season"))
    path = scratch(spark, "replace")
    for _ in range(2):
        tables.replace_partitions(rows, path)
    return tables.read_table(spark, path, rows.schema).withColumn("week", F.col("week").cast("double"))


@query
def landed_schedule(spark, sf):
    """Schedule written as landed JSON lines and read back with the declared schema."""
    path = scratch(spark, "landed")
    clean.tag_provenance(schedule(spark, sf), "landed", F.col("league"), F.col("season")).write.partitionBy(
        "_league", "_season").json(path)
    return landed.read_landed(spark, path, "schedule").drop("_corrupt_record", "_source")


@query
def landed_source(spark, sf):
    """Landed lines of two leagues through the data source, which reads their folders only."""
    path = scratch(spark, "pages")
    clean.tag_provenance(schedule(spark, sf), "landed", F.col("league"), F.col("season")).write.partitionBy("_league", "_season").json(path)
    rows = landed.read_landed(spark, path, "schedule", reader="pages").where("_league IN ('L1', 'L3')")
    return rows.drop("_corrupt_record", "_source")


#: Of each landed kind, the fields of its records besides team and season, and the player columns they are made of.
DRIFTING = {
    "player_standard": {"Performance_Gls": "gls", "Playing Time_90s": "nineties", "Playing Time_Min": "minutes", "age": "age"},
    "player_keeper": {"Performance_Save%": "save_pct", "Playing Time_Min": "minutes"},
    "player_shooting": {"Standard_Gls": "gls", "Standard_Sh": "minutes"},
    "player_playing_time": {"Playing Time_Min": "minutes", "Playing Time_90s": "nineties"},
    "player_misc": {"Performance_Fls": "gls"},
}


def _drifting_line(fields: dict[str, str]) -> Column:
    """Records in three shapes by turns: flat, with objects, and without their last field; some lines are cut off, some hold a list."""
    tags = [F.col(c) for c in ("team", "season")]
    flat = F.to_json(F.struct(*tags, *[F.col(c).alias(n) for n, c in fields.items()]))
    grouped: dict[str, list[Column]] = {}
    for n, c in fields.items():
        head, _, rest = n.partition("_")
        grouped.setdefault(head, []).append(F.col(c).alias(rest or n))
    nested = F.to_json(F.struct(*tags, *[v[0].alias(h) if h in fields else F.struct(*v).alias(h) for h, v in grouped.items()]))
    fewer = F.to_json(F.struct(*tags, *[F.col(c).alias(n) for n, c in list(fields.items())[:-1]]))
    return (F.when(F.col("k") % 13 == 0, F.concat(F.lit('{"team": "'), F.col("team"))).when(F.col("k") % 17 == 0, F.lit("[1, 2]"))
            .when(F.col("k") % 3 == 0, nested).when(F.col("k") % 3 == 1, fewer).otherwise(flat))


@query
def landed_kinds(spark, sf):
    """Records of six kinds whose fields come and go, read back into their declared columns: how many have which value."""
    players = materialize(view(spark, sf, "v_drifting"))
    out = []
    for kind, fields in DRIFTING.items():
        path = scratch(spark, f"drift-{kind}")
        players.select(_drifting_line(fields).alias("value")).write.text(path)
        rows = dynamic.collection(dynamic.read_records(spark, path), kind)
        out.append(rows.select("team", "season", F.inline(F.array(*[
            F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("field"), F.col(f"`{n}`").alias("value")) for n in fields]))))
    path = scratch(spark, "drift-events")
    e = events(spark, sf)
    e.select(F.to_json(F.struct("game_id", "team", "type", F.when(F.col("type") != "Pass", F.col("x")).alias("x"), F.when(
        F.col("type") == "Pass", F.col("x").cast("string")).alias("x_"))).alias("value")).select(
        F.regexp_replace("value", '"x_"', '"x"').alias("value")).write.text(path)
    rows = dynamic.collection(dynamic.read_records(spark, path), "match_events")
    out.append(rows.select("team", F.lit("all").alias("season"), F.lit("match_events").alias("kind"), F.lit("x").alias("field"),
                           F.col("x").cast("long").cast("string").alias("value")))
    found = reduce(DataFrame.unionByName, out).where("value IS NOT NULL")
    return found.groupBy("kind", "field", "team", "season", "value").agg(F.count(F.lit(1)).alias("rows"))


@query
def landed_rejects(spark, sf):
    """Lines that are no records stay, with the reason."""
    path = scratch(spark, "drift-bad")
    view(spark, sf, "v_drifting").select(_drifting_line(DRIFTING["player_standard"]).alias("value")).write.text(path)
    return dynamic.rejected(dynamic.read_records(spark, path))


# Models

def _ranges(table: DataFrame) -> dict[str, DataFrame]:
    return {k: ordering.row_range(table, *v) for k, v in ordering.split_ranges(table).items()}


def _splits(spark, sf):
    return _ranges(settled(spark, lambda: ft.feature_table(schedule(spark, sf), events(spark, sf), CFG)))


@query
def training_export(spark, sf):
    parts = _splits(spark, sf)
    stats = scaling.load_stats(scaling.normalization_stats(parts["train"]))
    return scaling.training_export(parts["val"], stats)


@query
def goal_rate_scores(spark, sf):
    parts = _splits(spark, sf)
    fitted = tr.fit(parts["train"], ModelConfig(ensemble=2, seed=1))
    return rounded(tr.predict(fitted, parts["test"]).select(
        "row_idx", "label", "rate_home", "rate_away", *mt.PROBS, *[f"pred_{t}" for t in STAT_TARGETS]))


@query
def rate_certificate(spark, sf):
    """Every head's optimum, coefficient by coefficient."""
    prepared = tr.prepare(_splits(spark, sf)["train"], NUMERIC_FEATURES)
    return tr.certificate(prepared, tr.fit_prepared(prepared, ModelConfig()))


@query
def sweep_certificate(spark, sf):
    """The whole grid, each set at rest, with its scores in their ranges."""
    swept = parameter_sweep(spark, sf)
    return swept.select(
        "reg_param", "half_life_days", "class_weight_power", "converged", (F.col("steepest") < 1e-8).alias("at_rest"),
        (F.col("score_accuracy").between(0, 1) & F.col("score_f1").between(0, 1) & (F.col("score_logloss") < 0)
         & (F.col("score_combined") <= F.col("score_f1")) & (F.col("score") == F.col("score_logloss"))).alias("scored"))


@query
def league_rho(spark, sf):
    scored = view(spark, sf, "v_predictions").withColumn("league_idx", F.col("l_orderkey") % 5)
    return tr.league_rho(scored)


@query
def evaluation_summary(spark, sf):
    parts = _splits(spark, sf)
    fitted = tr.fit(parts["train"])
    val, test = (materialize(tr.predict(fitted, parts[k])) for k in ("val", "test"))
    summary = ev.evaluate(test, val, cal.fit_decision_layer(val), fitted.config, "bench")
    path = scratch(spark, "history")
    tables.append_history(summary, path)
    return spark.read.schema(summary.schema).json(path)


@query
def parameter_sweep(spark, sf):
    """The documented grid over all features."""
    parts = _splits(spark, sf)
    return tr.temporal_sweep(parts["train"], parts["val"])


@query
def fixture_predictions(spark, sf):
    """Fitted, saved, and predicted from what was saved.

    The feature table and the history come from the same indexed matches and ratings; a table goes once its last reader is through.
    """
    path = scratch(spark, "run")
    with passing(spark) as keep:
        p = keep(materialize(parsed(spark, sf)))
        matches = ft.indexed_matches(p, events(spark, sf), CFG)
        replayed = settled(spark, lambda: ratings.elo(matches, CFG.elo_base, CFG.elo_k))
        with passing(spark):
            parts = _ranges(settled(spark, lambda: ft.feature_rows(p, matches, CFG, replayed=replayed)))
            with passing(spark):
                fitted = tr.fit(parts["train"])
            decision = cal.fit_decision_layer(materialize(tr.predict(fitted, parts["val"]).select(*mt.PROBS, "label")))
        store.save_run(fitted, ft.history(matches, CFG, replayed), ft.vocabulary(p), decision, path)
    fitted, known, vocab, decision = store.load_run(spark, path)
    return rounded(predict_fixtures(_fixtures(p), known, vocab, fitted, decision, cfg=CFG, spans=ag.season_span(p)))


# Streams

@query
def live_event_windows(spark, sf):
    stream = spark.readStream.schema(view(spark, sf, "events").schema).parquet(f"{sf}/events*.parquet")
    counted = live.windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"],
                                   "1 hour", delay="1 hour", total=F.sum("value"))
    table = scratch(spark, "windows")
    live.write_updates(counted, table, scratch(spark, "windows-cp")).awaitTermination()
    keys = ["window_start", "window_end", "event_type"]
    return live.current_totals(spark.read.parquet(table), keys).select(
        *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("window_start", "window_end")],
        "event_type", "events", F.round("total", 4).alias("total"))


def _split_arrivals(spark, sf):
    """The arrivals replayed batch by batch in disorder: a folder with all rows, late ones marked."""
    arrivals, source, folder = materialize(view(spark, sf, "v_arrivals")), scratch(spark, "arrivals"), scratch(spark, "split")
    for (n,) in sorted(arrivals.select("arrival").distinct().collect()):  # a few batches, landed one after the other
        arrivals.where(F.col("arrival") == n).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, arrival int").option(
        "maxFilesPerTrigger", 1).parquet(source)
    live.start_split(stream, "ts", "12 hours", folder, scratch(spark, "split-cp")).awaitTermination()
    return f"{folder}/rows"


def _on_time(spark, rows):
    schema = spark.read.parquet(rows).schema
    return spark.readStream.schema(schema).parquet(rows).where("NOT _late")


@query
def live_late_rows(spark, sf):
    """Rows per batch, and how many of them came after the watermark."""
    rows = spark.read.parquet(_split_arrivals(spark, sf))
    return rows.groupBy("_batch").agg(F.count(F.lit(1)).alias("rows"), F.count_if("_late").alias("late"))


@query
def live_sliding_windows(spark, sf):
    rows = _split_arrivals(spark, sf)
    counted = live.windowed_counts(_on_time(spark, rows), "ts", ["event_type"], "6 hours", "2 hours", "12 hours", total=F.sum("value"))
    table = scratch(spark, "sliding")
    live.write_updates(counted, table, scratch(spark, "sliding-cp")).awaitTermination()
    return live.current_totals(spark.read.parquet(table), ["window_start", "window_end", "event_type"]).select(
        *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("window_start", "window_end")], "event_type", "events",
        F.round("total", 4).alias("total"))


@query
def live_sessions(spark, sf):
    """Sessions that are closed for good when the stream ends."""
    rows = _split_arrivals(spark, sf)
    table = scratch(spark, "sessions")
    live.start_append(live.sessions(_on_time(spark, rows), "ts", ["user_id"], "3 hours", "12 hours"), table, scratch(spark, "sessions-cp")).awaitTermination()
    return spark.read.parquet(table).select(
        "user_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("session_start", "session_end")], "events")


@query
def live_landing(spark, sf):
    path, table = scratch(spark, "land-in"), scratch(spark, "land-out")
    schedule(spark, sf).withColumns({"_source": F.lit("x"), "_league": F.col("league"), "_season": F.col("season")}).write.json(path)
    rows = landing.prepare(landing.landing_stream(spark, path, "schedule"), "landed", F.col("league"), F.col("season"))
    landing.start_landing(rows, table, ["game_id", "_league", "_season"], scratch(spark, "land-cp")).awaitTermination()
    return tables.read_table(spark, table, rows.schema).select("game_id", "home_team", "away_team", "_league", "_season")


@query
def live_team_state(spark, sf):
    """Played matches of the schedule replayed as a stream, with the ratings read before each match."""
    path, table = scratch(spark, "state-in"), scratch(spark, "state-out")
    m = valid(spark, sf)
    end = m.agg((F.max("date") + F.expr("INTERVAL 30 DAYS")).alias("date"))
    played = m.select(F.col("league").alias("group"), F.col("date").cast("timestamp").alias("date"), "game", "game_id",
                      "home_team", "away_team", F.col("home_goals").cast("long").alias("home_goals"),
                      F.col("away_goals").cast("long").alias("away_goals"))
    closing = m.select(F.col("league").alias("group")).distinct().withColumns({
        "date": end.scalar().cast("timestamp"), "game": F.lit("end"), "game_id": F.lit("end"),
        "home_team": F.lit("-"), "away_team": F.lit("--"),
        "home_goals": F.lit(None).cast("long"), "away_goals": F.lit(None).cast("long")})
    rows = played.unionByName(closing)
    rows.write.parquet(path)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        state = live.live_team_state(spark.readStream.schema(rows.schema).parquet(path), CFG)
        state.writeStream.format("parquet").option("path", table).option(
            "checkpointLocation", scratch(spark, "state-cp")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return rounded(spark.read.parquet(table).where("status = 'played'").select(
        "game_id", "home_elo", "away_elo", "h_gf_ema", "a_gf_ema", "h_played", "a_played"))
