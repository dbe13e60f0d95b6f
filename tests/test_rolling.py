"""The block scan against a sequential fold, with blocks of all sizes and runs of blocks several levels high."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from touchline.operators import rolling
from touchline.operators.rolling import Trackers, ema_prior, prior_states

START = dt.datetime(2020, 1, 1)


def fold(values, alpha):
    out, state = [], None
    for v in values:
        out.append(state)
        if v is not None:
            state = float(v) if state is None else v * alpha + state * (1 - alpha)
    return out


def rows_for(seed, keys=(("a", 700), ("b", 90), ("c", 1))):
    rng, rows = random.Random(seed), []
    for key, n in keys:
        for i in range(n):
            x = rng.randint(-3, 6)
            rows.append((key, i, x, None if rng.random() < 0.4 else x * 1.0, rng.random() < 0.5, START + dt.timedelta(days=3 * i)))
    rng.shuffle(rows)
    return rows


SCHEMA = "key string, pos long, x long, y double, flag boolean, at timestamp_ntz"


@pytest.mark.parametrize("alpha", [0.2, 0.03, 0.9, 1.0])
@pytest.mark.parametrize("fade, fan", [(230.0, 128), (9.0, 3)])
def test_equals_sequential_fold(spark, monkeypatch, alpha, fade, fan):
    monkeypatch.setattr(rolling, "FADE", fade)
    monkeypatch.setattr(rolling, "FAN", fan)
    rows = rows_for(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    groups = [Trackers({"ex": "x"}, "nx", alpha), Trackers({"ey": "y"}, "ny", alpha), Trackers({"ef": "x"}, "nf", alpha, ("flag",))]
    got = {(r.key, r.pos): r for r in prior_states(df, ["key"], ["pos"], groups, ("at", "prev", 3)).collect()}
    assert len(got) == len(rows)
    for key in "abc":
        mine = sorted(r for r in rows if r[0] == key)
        ex, ey = fold([r[2] for r in mine], alpha), fold([r[3] for r in mine], alpha)
        seen, by_flag = 0, {True: [], False: []}
        for i, r in enumerate(mine):
            g = got[key, r[1]]
            assert g.nx == i and g.ny == seen and g.nf == len(by_flag[r[4]])
            ef = fold(by_flag[r[4]] + [0], alpha)[-1]
            for have, want in ((g.ex, ex[i]), (g.ey, ey[i]), (g.ef, ef)):
                assert (have is None) == (want is None)
                assert want is None or abs(have - want) < 1e-9
            dates = [d for d in (g.prev_1, g.prev_2, g.prev_3) if d is not None]
            assert dates == [m[5] for m in mine[max(0, i - 3):i]][::-1]
            seen += r[3] is not None
            by_flag[r[4]].append(r[2])


def test_key_with_no_observation_for_long(spark, monkeypatch):
    monkeypatch.setattr(rolling, "FADE", 20.0)
    monkeypatch.setattr(rolling, "FAN", 4)
    rows = [("a", i, 0, 5.0 if i < 3 else None, True, START) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = ema_prior(df, ["key"], ["pos"], "y", 0.5).where("pos >= 3")
    assert got.agg(F.min("ema"), F.max("ema"), F.count("ema")).first() == (5.0, 5.0, 397)


def test_partitioning_does_not_matter(spark):
    df = spark.createDataFrame(rows_for(2), SCHEMA)
    a, b = (ema_prior(df.repartition(n), ["key"], ["pos"], "x", 0.2).select("key", "pos", F.round("ema", 9).alias("e")) for n in (1, 7))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_any_order_null_keys_and_one_row_per_block(spark, monkeypatch):
    monkeypatch.setattr(rolling, "FADE", 0.1)
    monkeypatch.setattr(rolling, "FAN", 2)
    rows = [(None if k == "b" else k, *rest) for k, *rest in rows_for(4, (("a", 60), ("b", 30)))]
    df = spark.createDataFrame(rows, SCHEMA)
    for order in (["pos"], ["at", "pos"]):
        got = {(r.key, r.pos): r.ema for r in ema_prior(df, ["key"], order, "x", 0.2).collect()}
        for key in ("a", None):
            mine = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
            assert all(same(got[key, r[1]], want) for r, want in zip(mine, fold([r[2] for r in mine], 0.2)))
    assert ema_prior(df.limit(0), ["key"], ["pos"], "x", 0.2).count() == 0


def test_alpha_out_of_range(spark):
    df = spark.createDataFrame(rows_for(3), SCHEMA)
    with pytest.raises(ValueError):
        ema_prior(df, ["key"], ["pos"], "x", 0.0).collect()


def same(have, want):
    if have is None or want is None:
        return have is want
    if math.isnan(want) or math.isinf(want):
        return math.isnan(have) if math.isnan(want) else have == want
    return abs(have - want) <= 1e-9 * max(1.0, abs(want))


EXTREMES = {
    "large at a block's end": {185: 1e20}, "large in a block": {100: 1e20}, "nan": {10: float("nan")}, "inf": {10: float("inf")},
    "both infinities": {10: float("inf"), 250: float("-inf")}, "largest": {3: 1e307}, "tiny": {0: 1e-300, 1: -1e-290},
    "minus infinity late": {599: float("-inf")},
}


@pytest.mark.parametrize("fade", [230.0, 25.0])
@pytest.mark.parametrize("alpha", [0.2, 0.03, 0.9])
def test_extreme_values_equal_the_fold(spark, monkeypatch, fade, alpha):
    monkeypatch.setattr(rolling, "FADE", fade)
    rows, want = [], {}
    for key, odd in EXTREMES.items():
        values = [odd.get(i, 1.0) for i in range(700)]
        rows += [(key, i, 0, v, True, START) for i, v in enumerate(values)]
        want[key] = fold(values, alpha)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for r in ema_prior(df, ["key"], ["pos"], "y", alpha).collect():
        assert same(r.ema, want[r.key][r.pos]), (r.key, r.pos)


def test_rows_are_dealt_by_block_and_keep_names_what_comes_out(spark, monkeypatch):
    """No window and no shuffle by key: one team that plays everything is dealt like any other."""
    monkeypatch.setattr(rolling, "FADE", 9.0)
    monkeypatch.setattr(rolling, "SPANS", 1)
    monkeypatch.setattr(rolling, "FAN", 3)
    rows = rows_for(7, (("a", 500), ("b", 500)))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = prior_states(df, ["key"], ["pos"], [Trackers({"ey": "y"}, "ny")], ("at", "prev", 2), keep=("key", "pos"))
    assert out.columns == ["key", "pos", "ey", "ny", "prev_1", "prev_2"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "FlatMapCoGroupsInArrow" in plan
    for key in "ab":
        mine = sorted(r for r in rows if r[0] == key)
        got = {r.pos: r for r in out.where(F.col("key") == key).collect()}
        assert all(same(got[r[1]].ey, want) for r, want in zip(mine, fold([r[3] for r in mine], 0.2)))
        assert got[499].prev_1 == mine[498][5] and got[499].prev_2 == mine[497][5]


def test_many_keys_on_one_order_number(spark, monkeypatch):
    monkeypatch.setattr(rolling, "FADE", 1.0)
    monkeypatch.setattr(rolling, "SPANS", 1)
    rows = [(f"k{k}" if k else None, i, k + i, float(k + i), True, START) for k in range(60) for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.key, r.pos): r for r in prior_states(df, ["key"], ["pos"], [Trackers({"e": "y"}, "n")]).collect()}
    assert len(got) == len(rows)
    for k in range(60):
        for i, want in enumerate(fold([float(k + i) for i in range(12)], 0.2)):
            r = got[f"k{k}" if k else None, i]
            assert r.n == i and same(r.e, want)


def test_only_asked_rows_come_out_with_their_whole_history(spark):
    rows = spark.range(9000).select(F.col("id").alias("at"), (F.col("id") % 3).cast("string").alias("k"), F.rand(4).alias("v"), (F.col("id") >= 8990).alias("asked"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    tracked = [Trackers({"e": "v"}, "n", 0.9)]
    whole = {r.at: r for r in prior_states(rows, ["k"], ["at"], tracked).collect()}
    some = prior_states(rows, ["k"], ["at"], tracked, only="asked").collect()
    assert 10 <= len(some) < 5000 and {r.at for r in some if r.asked} == set(range(8990, 9000))
    assert all(r == whole[r.at] for r in some)


def test_a_run_of_blocks_is_folded_once(spark, monkeypatch):
    """Each block is put together with what came before it one time, not once for every later block of its run."""
    plans, written = [], rolling.materialize
    monkeypatch.setattr(rolling, "materialize", lambda df: plans.append(df._jdf.queryExecution().analyzed().toString()) or written(df))
    rows = spark.range(40).select(F.col("id").alias("at"), F.lit("a").alias("k"), F.lit(1.0).alias("v"))
    assert prior_states(rows, ["k"], ["at"], [Trackers({"e": "v"}, "n", 0.9)]).count() == 40
    assert not any("slice(l#" in p for p in plans)
