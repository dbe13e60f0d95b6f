"""Goal rates to outcome probabilities, calibration and picks, as column expressions; ``masses`` does the same for arrays inside a task."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, functions as F

from touchline.functions.scalars import col

RATE_FLOOR, PROB_FLOOR, RHO_SCALE = 1e-9, 1e-12, 0.15


def poisson_pmf(rate: Column | str, max_goals: int = 10) -> Column:
    """Array of P(X = 0..max_goals), worked out in logs."""
    if not 1 <= max_goals <= 20:
        raise ValueError("max_goals must lie between 1 and 20")
    lam = F.greatest(col(rate), F.lit(RATE_FLOOR))
    goals = F.array(*[F.lit(k) for k in range(max_goals + 1)])
    return F.transform(
        goals, lambda k: F.exp(-lam + k * F.log(lam) - F.log(F.factorial(k).cast("double")))
    )


def bounded_rho(rho: Column | str | None) -> Column:
    return F.lit(0.0) if rho is None else F.lit(RHO_SCALE) * F.tanh(col(rho))


def score_grid(rate_home: Column | str, rate_away: Column | str, rho: Column | str | None = None,
               max_goals: int = 10) -> Column:
    """Array over home goals of arrays over away goals, with the low-score correction."""
    lh, la = (F.greatest(col(c), F.lit(RATE_FLOOR)) for c in (rate_home, rate_away))
    home, away = poisson_pmf(rate_home, max_goals), poisson_pmf(rate_away, max_goals)
    if rho is None:
        return F.transform(home, lambda p: F.transform(away, lambda q: p * q))
    r = bounded_rho(rho)

    def tau(i: Column, j: Column) -> Column:
        return (
            F.when((i == 0) & (j == 0), F.lit(1.0) - lh * la * r)
            .when((i == 0) & (j == 1), F.lit(1.0) + lh * r)
            .when((i == 1) & (j == 0), F.lit(1.0) + la * r)
            .when((i == 1) & (j == 1), F.lit(1.0) - r)
            .otherwise(1.0)
        )

    return F.transform(
        home, lambda p, i: F.transform(away, lambda q, j: F.greatest(F.lit(0.0), p * q * tau(i, j)))
    )


def grid_cells(grid: Column | str) -> Column:
    """The score grid as one flat array of (i, j, p)."""
    return F.flatten(F.transform(
        col(grid), lambda row, i: F.transform(row, lambda p, j: F.struct(i.alias("i"), j.alias("j"), p.alias("p")))
    ))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, v: s + v)


def grid_outcomes(grid: Column | str) -> tuple[Column, Column, Column]:
    """Mass below, on and above the diagonal of a score grid, renormalised."""
    g = col(grid)
    home = _total(F.transform(g, lambda row, i: _total(F.filter(row, lambda p, j: j < i))))
    draw = _total(F.transform(g, lambda row, i: F.get(row, i)))
    away = _total(F.transform(g, lambda row, i: _total(F.filter(row, lambda p, j: j > i))))
    total = F.greatest(home + draw + away, F.lit(RATE_FLOOR))
    return home / total, draw / total, away / total


def outcome_probs(df, rate_home: str, rate_away: str, rho: str | None = None, max_goals: int = 10):
    """Adds p_home, p_draw, p_away without building the (G+1) x (G+1) grid per row.

    Only four cells carry the correction, so the masses come from the two marginals, their running sums
    and those cells: plain columns that stay inside generated code, O(G) per row instead of O(G^2).
    """
    if not 1 <= max_goals <= 20:
        raise ValueError("max_goals must lie between 1 and 20")
    steps = range(max_goals + 1)
    out = df.withColumns({"_lh": F.greatest(F.col(rate_home), F.lit(RATE_FLOOR)),
                          "_la": F.greatest(F.col(rate_away), F.lit(RATE_FLOOR))})
    lh, la = F.col("_lh"), F.col("_la")
    # The logs are of positive numbers; saying that they are never null keeps the generated code short.
    out = out.withColumns({"_nh": F.coalesce(F.log(lh), F.lit(0.0)), "_na": F.coalesce(F.log(la), F.lit(0.0)),
                           "_r": F.coalesce(bounded_rho(rho), F.lit(0.0))})
    out = out.withColumns({
        f"_{s}{k}": F.exp(F.lit(float(k)) * F.col(f"_n{s}") - F.col(f"_l{s}") - F.lit(math.lgamma(k + 1)))
        for s in "ha" for k in steps})
    h, a = ([F.col(f"_{s}{k}") for k in steps] for s in "ha")
    draw = reduce(add, (h[k] * a[k] for k in steps))
    cum = {f"_c{s}{k}": reduce(add, p[: k + 1]) for s, p in (("h", h), ("a", a)) for k in steps[:-1]}
    out = out.withColumns({**cum, "_draw": draw})
    home = reduce(add, (h[k] * F.col(f"_ca{k - 1}") for k in steps[1:]))
    away = reduce(add, (a[k] * F.col(f"_ch{k - 1}") for k in steps[1:]))
    r = F.col("_r")

    def change(i: int, j: int, factor: Column) -> Column:
        return h[i] * a[j] * (F.greatest(F.lit(0.0), factor) - 1.0)

    shift = {"_home": F.lit(0.0), "_draw": F.lit(0.0), "_away": F.lit(0.0)} if rho is None else {
        "_home": change(1, 0, 1.0 + la * r),
        "_draw": change(0, 0, 1.0 - lh * la * r) + change(1, 1, 1.0 - r),
        "_away": change(0, 1, 1.0 + lh * r),
    }
    out = out.withColumns({
        "_home": home + shift["_home"], "_draw": F.col("_draw") + shift["_draw"], "_away": away + shift["_away"]})
    out = out.withColumn("_all", F.greatest(F.col("_home") + F.col("_draw") + F.col("_away"), F.lit(RATE_FLOOR)))
    return out.select(*df.columns, *[(F.col(f"_{n}") / F.col("_all")).alias(f"p_{n}") for n in ("home", "draw", "away")])


def masses(lh: np.ndarray, la: np.ndarray, max_goals: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The masses that ``outcome_probs`` starts from: home, draw and away of independent sides, not yet divided by their sum."""
    h, a = np.exp(-lh), np.exp(-la)
    draw, home, away = h * a, np.zeros_like(lh), np.zeros_like(la)
    below_h, below_a = h.copy(), a.copy()
    for k in range(1, max_goals + 1):
        h = h * lh / k
        a = a * la / k
        draw += h * a
        home += h * below_a
        away += a * below_h
        below_h += h
        below_a += a
    return home, draw, away


def shifts(lh: np.ndarray, la: np.ndarray, r: np.ndarray | float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a dependence ``r`` adds to the masses: only four cells of the score grid carry it."""
    low = np.exp(-lh - la)

    def change(cell: np.ndarray, factor: np.ndarray | float) -> np.ndarray:
        return cell * (np.maximum(0.0, factor) - 1.0)

    return (change(low * lh, 1.0 + la * r), change(low, 1.0 - lh * la * r) + change(low * lh * la, 1.0 - r), change(low * la, 1.0 + lh * r))


def clip_prob(p: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(PROB_FLOOR), p))


def apply_temperature(probs: tuple[Column | str, ...], temperature: Column | float) -> tuple[Column, ...]:
    """Power scaling p ** (1/T), renormalised; T = 1 leaves the input as it is."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    ps = [col(p) for p in probs]
    scaled = [F.pow(clip_prob(p), F.lit(1.0) / t) for p in ps]
    total = scaled[0] + scaled[1] + scaled[2]
    return tuple(F.when(t == 1.0, p).otherwise(s / total) for p, s in zip(ps, scaled))


def pick(p_home: Column | str, p_draw: Column | str, p_away: Column | str, boost: Column | float = 1.0) -> Column:
    """Class with the largest probability after scaling the draw; on ties the first class."""
    h, a = col(p_home), col(p_away)
    d = col(p_draw) * (boost if isinstance(boost, Column) else F.lit(float(boost)))
    return F.when((h >= d) & (h >= a), 0).when(d >= a, 1).otherwise(2)


def true_prob(label: Column | str = "label", probs=("p_home", "p_draw", "p_away")) -> Column:
    y = col(label)
    return F.when(y == 0, col(probs[0])).when(y == 1, col(probs[1])).when(y == 2, col(probs[2]))
