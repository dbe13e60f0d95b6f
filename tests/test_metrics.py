"""Scores against plain NumPy, grids against a loop, splits and weights at the edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.config import SplitConfig
from touchline.operators import calibrate as cal
from touchline.operators import metrics as mt
from touchline.operators import ordering, scaling


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet((2, 1.2, 1.5), 400)
    y = np.array([rng.choice(3, p=r) for r in p])
    return spark.createDataFrame([(*map(float, r), int(k)) for r, k in zip(p, y)], "p_home double, p_draw double, p_away double, label int"), p, y


def test_scores(scored):
    df, p, y = scored
    r = mt.probability_metrics(df).first()
    hot = np.eye(3)[y]
    assert abs(r.log_loss + np.log(p[np.arange(len(y)), y]).mean()) < 1e-12
    assert abs(r.brier - ((p - hot) ** 2).sum(1).mean()) < 1e-12
    assert abs(r.rps - ((p.cumsum(1) - hot.cumsum(1)) ** 2).sum(1).mean() / 2) < 1e-12


def test_temperature_and_boosts(scored):
    df, p, y = scored
    losses = {r.temperature: r.log_loss for r in cal.temperature_losses(df).collect()}
    assert len(losses) == 251
    for t in (0.5, 1.0, 2.37):
        s = p if t == 1 else p ** (1 / t) / (p ** (1 / t)).sum(1, keepdims=True)
        assert abs(losses[t] + np.log(s[np.arange(len(y)), y]).mean()) < 1e-10
    scores = {r.boost: r for r in cal.boost_scores(df).collect()}
    for b, r in scores.items():
        q = p.copy()
        q[:, 1] *= b
        pred = q.argmax(1)
        f1 = []
        for k in range(3):
            tp = ((pred == k) & (y == k)).sum()
            f1.append(2 * tp / max((pred == k).sum() + (y == k).sum(), 1))
        assert abs(r.accuracy - (pred == y).mean()) < 1e-12 and abs(r.macro_f1 - np.mean(f1)) < 1e-12
    with pytest.raises(ValueError):
        cal.tune_draw_boost(df, "other")
    with pytest.raises(ValueError):
        mt.selection_score("other")


def test_ties_go_to_the_first(spark):
    df = spark.createDataFrame([(0.5, 1.0), (0.7, 1.0), (0.9, 2.0)], "c double, v double")
    assert cal.grid_best(df, "c", "v").first().c == 0.5
    assert cal.grid_best(df.where("v = 1"), "c", "v", True).first().c == 0.5


def test_reliability_edges(spark):
    df = spark.createDataFrame([(3 * 0.1, 0.3, 0.3, 0), (1.0, 0.0, 0.0, 0), (0.7, 0.1, 0.2, 1)], "p_home double, p_draw double, p_away double, label int")
    rows = {r.bin: r for r in mt.reliability_table(df).collect()}
    assert len(rows) == 10 and [b for b, r in rows.items() if r["count"]] and rows[3]["count"] == 1
    assert rows[9]["count"] == 1 and rows[0].mean_confidence == 0.0 and sum(r["count"] for r in rows.values()) == 3


def test_splits(spark):
    for n in (0, 1, 7, 100):
        got = {r.split: r["count"] for r in ordering.temporal_split(spark.range(n).withColumnRenamed("id", "row_idx")).groupBy("split").count().collect()}
        a, b = int(n * 0.70), int(n * (0.70 + 0.15))
        want = {k: v for k, v in (("train", a), ("val", b - a), ("test", n - b)) if v}
        assert got == want
        assert ordering.split_ranges(spark.range(n), SplitConfig()) == {"train": (0, a), "val": (a, b), "test": (b, n)}


def test_scaler_and_weights(spark):
    df = spark.createDataFrame([(1.0, 5.0, 0), (3.0, 5.0, 0), (None, 5.0, 2)], "x double, c double, label int")
    stats = scaling.load_stats(scaling.normalization_stats(df, ("x", "c")))
    assert stats == {"x": (2.0, 1.0), "c": (5.0, 0.0)}
    assert [r.c for r in scaling.standardize(df, stats).collect()] == [0.0, 0.0, 0.0]
    assert {r.x for r in scaling.standardize(df, stats, neutral=True).collect()} == {0.0}
    w = [r.weight for r in scaling.class_weights(df).orderBy("label").collect()]
    inverse = np.array([4 / 6, 4 / 3, 4 / 3])
    assert np.allclose(w, inverse / inverse.mean())
    assert [r.weight for r in scaling.class_weights(df, 0.0).collect()] == [1.0, 1.0, 1.0]
    with pytest.raises(Exception, match="no rows"):
        scaling.normalization_stats(df.where("x > 9"), ("x",)).collect()
    with pytest.raises(Exception, match="no dated rows"):
        scaling.reference_day(df.select(F.lit(None).cast("timestamp_ntz").alias("date"))).collect()
