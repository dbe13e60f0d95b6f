"""Test-set summary, run history and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from touchline.config import STAT_TARGETS, ModelConfig
from touchline.functions.outcomes import apply_temperature, pick
from touchline.operators.metrics import (
    CLASSES, PROBS, brier, class_metrics, confusion_columns, goal_mae, log_loss, reliability_table, rps,
)
from touchline.plans.training import stat_maes

CALIBRATED = tuple(f"cal_{p}" for p in PROBS)


def _scores(prefix: str, probs: Sequence[str]) -> list[Column]:
    return [f("label", probs).alias(f"{prefix}_{n}") for n, f in (("log_loss", log_loss), ("brier", brier), ("rps", rps))]


def _score_struct(prefix: str) -> Column:
    return F.struct(*[F.col(f"{prefix}_{n}").alias(n) for n in ("log_loss", "brier", "rps")])


def _class_struct(prefix: str) -> Column:
    return F.struct(*[c.alias(n) for n, c in class_metrics(prefix).items()])


def _matrix(prefix: str) -> Column:
    return F.array(*[F.array(*[F.col(f"{prefix}{t}{p}") for p in CLASSES]) for t in CLASSES])


def _decide(df: DataFrame, decision: dict[str, float]) -> DataFrame:
    out = df.withColumns(dict(zip(CALIBRATED, apply_temperature(PROBS, decision["temperature"]))))
    return out.withColumns({
        "_plain": pick(*PROBS), "_acc": pick(*CALIBRATED, decision["draw_boost_acc"]),
        "_f1": pick(*CALIBRATED, decision["draw_boost_f1"])})


def evaluate(test: DataFrame, val: DataFrame, decision: dict[str, float], cfg: ModelConfig,
             tag: str = "") -> DataFrame:
    """One nested summary row; test and validation are each read once for all counts and scores."""
    y = F.col("label")
    scored = _decide(test, decision)
    wide = scored.agg(
        F.count(F.lit(1)).alias("n_rows"), *_scores("raw", PROBS), *_scores("cal", CALIBRATED),
        *confusion_columns(y, F.col("_plain"), "p"), *confusion_columns(y, F.col("_acc"), "a"),
        *confusion_columns(y, F.col("_f1"), "f"),
        *[c.alias(n) for n, c in {**goal_mae(), **stat_maes(test)}.items()])
    table = reliability_table(scored.select("label", *[F.col(c).alias(p) for c, p in zip(CALIBRATED, PROBS)]))
    rows = table.agg(F.array_sort(F.collect_list(F.struct(*table.columns)))).scalar()  # one row per bin
    summary = wide.select(
        F.lit(tag).alias("tag"), F.lit(cfg.seed).alias("seed"), F.lit(cfg.ensemble).alias("ensemble"),
        F.lit(len(cfg.features)).alias("num_numeric_features"), "n_rows",
        *[F.lit(decision[k]).alias(k) for k in ("temperature", "draw_boost_acc", "draw_boost_f1")],
        _class_struct("p").alias("test_argmax"), _class_struct("a").alias("test_boosted_acc"),
        _class_struct("f").alias("test_boosted"), _score_struct("raw").alias("test_prob"),
        _score_struct("cal").alias("test_prob_calibrated"),
        F.struct(F.col("mae_home_goals").alias("home"), F.col("mae_away_goals").alias("away")).alias("test_mae_goals"),
        F.struct(*[F.col(f"mae_{t}").alias(t) for t in STAT_TARGETS]).alias("test_mae"),
        _matrix("p").alias("test_confusion_argmax"), _matrix("f").alias("test_confusion_boosted"),
        rows.alias("test_reliability"))
    valued = _decide(val, decision).agg(
        *_scores("raw", PROBS), *_scores("cal", CALIBRATED), *confusion_columns(y, F.col("_plain"), "p"))
    fields = [c.alias(n) for n, c in class_metrics("p").items()]
    val_row = valued.select(
        F.struct(*fields, *[F.col(f"raw_{n}").alias(n) for n in ("log_loss", "brier", "rps")]).alias("val"),
        _score_struct("cal").alias("val_prob_calibrated"))
    return summary.withColumns({
        "val": val_row.select("val").scalar(), "val_prob_calibrated": val_row.select("val_prob_calibrated").scalar()})


HISTORY_METRICS = {
    "val_accuracy": "val.accuracy", "val_log_loss": "val.log_loss", "val_macro_f1": "val.macro_f1",
    "test_accuracy": "test_argmax.accuracy", "test_log_loss": "test_prob.log_loss", "test_rps": "test_prob.rps",
    "test_macro_f1": "test_argmax.macro_f1",
}


def flat_history(history: DataFrame) -> DataFrame:
    return history.select(F.coalesce("tag", F.lit("")).alias("tag"), "seed", "num_numeric_features",
                          *[F.col(path).alias(name) for name, path in HISTORY_METRICS.items()])


def run_summary(runs: DataFrame, metrics: Sequence[str] = tuple(HISTORY_METRICS)) -> DataFrame:
    """Per tag: runs, seeds with their counts, distinct feature counts, mean and population deviation.

    Seeds are counted before they are gathered, so a tag with very many runs stays a short list.
    """
    stats = runs.groupBy("tag").agg(
        F.count(F.lit(1)).alias("runs"), F.array_sort(F.collect_set("num_numeric_features")).alias("feature_counts"),
        *[f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    seeds = runs.groupBy("tag", "seed").agg(F.count(F.lit(1)).alias("n")).groupBy("tag").agg(
        F.array_sort(F.collect_list(F.struct("seed", "n"))).alias("seeds"))
    return stats.join(seeds, "tag")


def coverage_report(parsed: DataFrame, matches: DataFrame, games: DataFrame, unmapped: DataFrame) -> DataFrame:
    """One row: rows written and skipped, targets present, event games used and skipped, unmapped names.

    ``games`` is ``paired_games``: one row per event game with its team counts.
    """
    used = (F.col("teams") == 2) & (F.col("mapped") == 2) & F.col("game").isNotNull()
    game_counts = games.agg(F.count_if(used).alias("indexed"), F.count_if(~used).alias("skipped"))
    n, covered = F.col("rows_written"), F.col("targets_present")
    return matches.agg(
        F.count(F.lit(1)).alias("rows_written"), F.count_if(F.col("targets_present") == 1).alias("targets_present")
    ).select(
        n, parsed.where("reject_reason IS NOT NULL").agg(F.count(F.lit(1))).scalar().alias("rows_skipped"), covered,
        F.when(n > 0, covered / n * 100.0).otherwise(0.0).alias("targets_pct"),
        game_counts.select("indexed").scalar().alias("games_indexed"),
        game_counts.select("skipped").scalar().alias("games_skipped"),
        unmapped.agg(F.count(F.lit(1))).scalar().alias("unmapped_names"))
