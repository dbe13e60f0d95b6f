"""Proper scores, confusion-based metrics, errors and losses; each is one aggregation pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from touchline.config import LossConfig
from touchline.functions.outcomes import clip_prob, pick, true_prob
from touchline.functions.scalars import col

PROBS = ("p_home", "p_draw", "p_away")
CLASSES = (0, 1, 2)
# Magnitudes that make the errors of the statistics comparable, and their weight.
MAE_REFERENCE = {"sot": 5.0, "corners": 5.0, "cards": 2.0}
REGRESSION_WEIGHT = 0.10


def _hit(label: Column, k: int) -> Column:
    return (label == k).cast("double")


def log_loss(label: str = "label", probs: Sequence[str] = PROBS) -> Column:
    return F.avg(-F.log(clip_prob(true_prob(label, probs))))


def brier(label: str = "label", probs: Sequence[str] = PROBS) -> Column:
    y = col(label)
    return F.avg(sum(((col(p) - _hit(y, k)) ** 2 for k, p in enumerate(probs)), F.lit(0.0)))


def rps(label: str = "label", probs: Sequence[str] = PROBS) -> Column:
    """Mean squared distance of the cumulative distributions over home < draw < away, halved."""
    y, (h, d, a) = col(label), (col(p) for p in probs)
    first = h - _hit(y, 0)
    second = h + d - _hit(y, 0) - _hit(y, 1)
    third = h + d + a - 1.0
    return F.avg((first * first + second * second + third * third) / 2.0)


def probability_metrics(df: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    return df.groupBy(*by).agg(
        log_loss(label).alias("log_loss"), brier(label).alias("brier"), rps(label).alias("rps"))


def reliability_table(df: DataFrame, bins: int = 10, label: str = "label") -> DataFrame:
    """Per confidence bin: count, mean confidence, accuracy. Left-closed bins, the last one closed."""
    step = F.lit(1.0 / bins)
    confidence = F.greatest(*PROBS)
    scored = df.select(confidence.alias("c"), (pick(*PROBS) == col(label)).cast("double").alias("ok"))
    guess = F.least(F.floor(F.col("c") * bins), F.lit(bins - 1))
    # The edges are i * step, so move by one where the product says the guess is off.
    bin_of = F.when(F.col("c") < guess * step, guess - 1).when(
        (guess < bins - 1) & (F.col("c") >= (guess + 1) * step), guess + 1).otherwise(guess)
    found = scored.groupBy(bin_of.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("c").alias("mean_c"), F.avg("ok").alias("acc"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    top = F.when(F.col("bin") == bins - 1, 1.0).otherwise((F.col("bin") + 1) * step)
    return grid.join(found, "bin", "left").select(
        "bin", (F.col("bin") * step).alias("bin_low"), top.alias("bin_high"),
        F.coalesce("n", F.lit(0)).cast("long").alias("count"),
        F.coalesce("mean_c", F.lit(0.0)).alias("mean_confidence"), F.coalesce("acc", F.lit(0.0)).alias("accuracy"))


def confusion_columns(label: Column, pred: Column, prefix: str = "c") -> list[Column]:
    return [F.count_if((label == t) & (pred == p)).alias(f"{prefix}{t}{p}") for t in CLASSES for p in CLASSES]


def confusion_wide(df: DataFrame, pred: Column, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """One row per group with the nine counts c<true><predicted>."""
    return df.withColumn("_pred", pred).groupBy(*by).agg(*confusion_columns(col(label), F.col("_pred")))


def confusion(df: DataFrame, boost: float = 1.0, label: str = "label") -> DataFrame:
    """(label, pred, count) with all nine cells present."""
    wide = confusion_wide(df, pick(*PROBS, boost), label=label)
    cells = F.array(*[
        F.struct(F.lit(t).alias("label"), F.lit(p).alias("pred"), F.col(f"c{t}{p}").alias("count"))
        for t in CLASSES for p in CLASSES])
    return wide.select(F.inline(cells))


def _ratio(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d).otherwise(0.0)


def class_metrics(prefix: str = "c") -> dict[str, Column]:
    """Accuracy and macro precision, recall and F1 from the nine count columns."""
    cell = {(t, p): F.col(f"{prefix}{t}{p}").cast("double") for t in CLASSES for p in CLASSES}
    total = sum(cell.values(), F.lit(0.0))
    right = sum((cell[k, k] for k in CLASSES), F.lit(0.0))
    precision, recall, f1 = [], [], []
    for k in CLASSES:
        p = _ratio(cell[k, k], sum((cell[t, k] for t in CLASSES), F.lit(0.0)))
        r = _ratio(cell[k, k], sum((cell[k, q] for q in CLASSES), F.lit(0.0)))
        precision.append(p)
        recall.append(r)
        f1.append(_ratio(2.0 * p * r, p + r))
    mean = {n: (x[0] + x[1] + x[2]) / 3.0 for n, x in (
        ("macro_precision", precision), ("macro_recall", recall), ("macro_f1", f1))}
    return {"accuracy": _ratio(right, total), **mean}


def classification_metrics(df: DataFrame, pred: Column | None = None, by: Sequence[str] = (),
                           label: str = "label") -> DataFrame:
    wide = confusion_wide(df, pick(*PROBS) if pred is None else pred, by, label)
    return wide.select(*by, *[c.alias(n) for n, c in class_metrics().items()])


def masked_mae(predicted: str, target: str, mask: str = "targets_present") -> Column:
    m = col(mask).cast("double")
    return F.sum(F.abs(col(predicted) - col(target)) * m) / F.greatest(F.sum(m), F.lit(1.0))


def goal_mae(rate_home: str = "rate_home", rate_away: str = "rate_away") -> dict[str, Column]:
    home = F.avg(F.abs(col(rate_home) - col("home_goals")))
    away = F.avg(F.abs(col(rate_away) - col("away_goals")))
    return {"mae_home_goals": home, "mae_away_goals": away, "mae_goals": (home + away) / 2.0}


def goal_nll(rate_home: str = "rate_home", rate_away: str = "rate_away") -> Column:
    """Poisson loss of one row, mean of both sides."""
    def side(rate: str, goals: str) -> Column:
        return col(rate) - col(goals) * F.log(col(rate) + 1e-8)

    return (side(rate_home, "home_goals") + side(rate_away, "away_goals")) / 2.0


def poisson_nll(weight: Column | None = None, rate_home: str = "rate_home", rate_away: str = "rate_away") -> Column:
    """Mean Poisson loss; a weight is rescaled to mean one."""
    row = goal_nll(rate_home, rate_away)
    return F.avg(row) if weight is None else F.sum(row * weight) / F.sum(weight)


def outcome_nll(label: str = "label", probs: Sequence[str] = PROBS) -> Column:
    return F.avg(-F.log(F.greatest(F.lit(1e-9), true_prob(label, probs))))


def weighted_outcome_nll(class_weights: Sequence[float], label: str = "label",
                         probs: Sequence[str] = PROBS) -> Column:
    y = col(label)
    w = F.when(y == 0, float(class_weights[0])).when(y == 1, float(class_weights[1])).otherwise(float(class_weights[2]))
    return F.sum(-w * F.log(F.greatest(F.lit(1e-9), true_prob(label, probs)))) / F.sum(w)


def huber(predicted: str, target: str, delta: float = 1.0) -> Column:
    e = col(predicted) - col(target)
    return F.when(F.abs(e) <= delta, 0.5 * e * e).otherwise(delta * (F.abs(e) - 0.5 * delta))


def masked_huber(pairs: Sequence[tuple[str, str]], mask: str = "targets_present", delta: float = 1.0) -> Column:
    """Mean over the pairs (predicted, target), averaged over the rows that have targets."""
    m = col(mask).cast("double")
    row = sum((huber(p, t, delta) for p, t in pairs), F.lit(0.0)) / float(len(pairs))
    return F.sum(row * m) / F.greatest(F.sum(m), F.lit(1.0))


def composite_score(goals: Column, outcome: Column, sot: Column, corners: Column, cards: Column,
                    cfg: LossConfig = LossConfig()) -> Column:
    return (goals + cfg.lambda_outcome * outcome + cfg.lambda_sot * sot
            + cfg.lambda_corners * corners + cfg.lambda_cards * cards)


def selection_score(kind: str) -> Column:
    """Score to maximise from columns outcome_nll, accuracy, macro_f1, mae_sot, mae_corners, mae_cards."""
    if kind == "logloss":
        return -F.col("outcome_nll")
    if kind == "accuracy":
        return F.col("accuracy")
    if kind == "f1":
        return F.col("macro_f1")
    if kind == "combined":
        scaled = [F.col(f"mae_{h}") / ref for h, ref in MAE_REFERENCE.items()]
        return F.col("macro_f1") - REGRESSION_WEIGHT * (scaled[0] + scaled[1] + scaled[2]) / 3.0
    raise ValueError(f"unknown selection score: {kind!r}")


def ensemble_average(members: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Mean of the members' probabilities and point predictions per row."""
    return members.groupBy(key).agg(*[F.avg(c).alias(c) for c in columns])
