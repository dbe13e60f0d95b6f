"""What a pass over the training rows adds up, and what it does not work out again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions import outcomes as oc
from touchline.operators import stacked
from touchline.operators.metrics import PROBS
from touchline.operators.stacked import Fit, Solution, fit_stacked
from touchline.plans import training as tr

RATES = [(0.0, 0.4), (1.3, 1.1), (2.6, 0.2), (9.0, 7.5), (40.0, 0.01), (1e-12, 3.0), (0.7, 0.7)]


def test_masses_of_arrays_equal_the_columns(spark):
    rows = [(h, a, r) for h, a in RATES for r in (-1.0, 0.0, 0.8)]
    df = spark.createDataFrame(rows, "h double, a double, r double")
    want = np.array([tuple(r[p] for p in PROBS) for r in oc.outcome_probs(df, "h", "a", "r").collect()])
    h, a, r = np.array(rows).T
    h, a = np.maximum(h, oc.RATE_FLOOR), np.maximum(a, oc.RATE_FLOOR)
    parts = np.array([m + s for m, s in zip(oc.masses(h, a), oc.shifts(h, a, oc.RHO_SCALE * np.tanh(r)))])
    assert (parts / np.maximum(parts.sum(axis=0), oc.RATE_FLOOR)).T == pytest.approx(want, rel=1e-10, abs=1e-13)


@pytest.fixture(scope="module")
def prepared(spark):
    n, draw = 600, np.random.default_rng(2)
    rows = [(i, float(draw.normal()), float(draw.normal() * 2), [1, 2, None][i % 3], [0, 1, 2, None][int(draw.integers(0, 4))], i % 5) for i in range(n)]
    df = spark.createDataFrame(rows, "row_idx long, f double, g double, league_idx long, label int, k int").withColumns(
        {t: F.col("k").cast("double") for t in tr.LABELS}).withColumns({"date": F.lit("2024-08-01").cast("timestamp_ntz"), "targets_present": F.lit(1)})
    return tr.prepare(df, ("f", "g"))


@pytest.mark.parametrize("counted", [False, True])
def test_rho_of_a_pass_equals_the_operator(spark, prepared, counted):
    draw = np.random.default_rng(3)
    betas = draw.normal(size=(2, 2, prepared.width)) * np.array([0.3, 1.4])[:, None, None]  # one member of low rates, one of high ones
    solutions = [dict(zip(tr.GOAL_TARGETS, (Solution(tuple(b), 0.0, 0.0, 1, True) for b in pair))) for pair in betas]
    counts = [F.lit(1), (F.col("row_idx") % 4).cast("int")] if counted else []
    got = tr._fitted_rho(prepared, tr.vectors(prepared, [F.lit(1.0)], counts), solutions, 10)
    for i, pair in enumerate(betas):
        scored = tr.with_products(prepared.rows, np.array(pair).T, "_e").withColumns({
            "rate_home": F.exp(F.get("_e", F.lit(0))), "rate_away": F.exp(F.get("_e", F.lit(1))), "n": counts[i] if counted else F.lit(1)})
        want = tr.league_rho(scored.where("n > 0 AND league_idx IS NOT NULL"), weight="n").collect()
        assert got[i] == {r.league_idx: r.rho for r in want} and len(got[i]) == 2


def test_curvature_is_shared_and_left_out(spark, monkeypatch):
    draw = np.random.default_rng(5)
    x = np.column_stack([np.ones(300), draw.normal(size=(300, 2))])
    y, w = draw.poisson(np.exp(0.3 + 0.4 * x[:, 1])).astype(float), draw.uniform(0.1, 2, (300, 2))
    rows = spark.createDataFrame([(a.tolist(), [b, b + 1], c.tolist()) for a, b, c in zip(x, y.tolist(), w)],
                                 "inputs array<double>, labels array<double>, weights array<double>").repartition(3)
    fits = [Fit("poisson", i % 2, i % 2, reg) for i in range(4) for reg in (0.01, 0.1, 1.0)] + [Fit("huber", 0, 0, reg) for reg in (0.01, 0.1)]
    seen, plain = [], stacked.pass_sums

    def spied(vectors, fits, points, labels, weights, bent=None):
        seen.append((set(points), set(points) if bent is None else bent, stacked._alike(fits, points, set(points) if bent is None else bent)))
        return plain(vectors, fits, points, labels, weights, bent)

    monkeypatch.setattr(stacked, "pass_sums", spied)
    found = fit_stacked(rows, fits, 3, 2, 2)
    monkeypatch.setattr(stacked, "pass_sums", lambda *a: plain(*a[:5]))  # every pass with every curvature
    every = fit_stacked(rows, fits, 3, 2, 2)
    assert all(s.converged and s.steepest <= 1e-8 for s in found) and len(seen) <= max(s.iterations for s in every) + 1
    assert all(a.beta == pytest.approx(b.beta, abs=1e-7) for a, b in zip(found, every))
    assert sorted(map(len, seen[0][2])) == [2, 6, 6]  # at the start one curvature per weight, and one of the Huber fits
    assert not seen[-1][1] and sum(len(bent) for _, bent, _ in seen) < sum(len(points) for points, _, _ in seen)


def test_few_rows_of_a_high_penalty_agree_in_single_precision():
    draw = np.random.default_rng(7)
    x = np.column_stack([np.ones(500), draw.normal(size=(500, 6))])
    bend = draw.uniform(size=(500, 14))
    exact = stacked._products(np.ascontiguousarray(x.T)) @ bend
    assert stacked._products(np.ascontiguousarray(x.T, np.float32)) @ bend.astype(np.float32) == pytest.approx(exact, rel=1e-4, abs=1e-3)
