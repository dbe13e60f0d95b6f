"""Hand-made edge rows."""

import datetime as dt

from pyspark.sql import functions as F

from touchline.functions import scalars as sc
from touchline.functions.events import event_flags
from touchline.functions.names import normalize_names
from touchline.functions.outcomes import apply_temperature, grid_outcomes, outcome_probs, pick, score_grid


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_parse_score(spark):
    cases = {"2–1": (2, 1), "0-3": (0, 3), "10–2": (10, 2), None: (None, None), "": (None, None),
             "postponed": (None, None), "3": (None, None), "(4) 1–1 (3)": (4, 1)}
    assert one(spark, [(c,) for c in cases], "s string", *sc.parse_score("s")) == list(cases.values())
    strict = one(spark, [("(4) 1–1 (3)",), (" 2 - 1 ",)], "s string", *sc.parse_score("s", strict=True))
    assert strict == [(None, None), (2, 1)]


def test_seasons(spark):
    cases = {"2526": ("2425", "2627"), "0001": ("9900", "0102"), "25": (None, None), "25a6": (None, None), None: (None, None)}
    assert one(spark, [(c,) for c in cases], "s string", sc.prev_season("s"), sc.next_season("s")) == list(cases.values())


def test_coerce_date(spark):
    day = dt.datetime(2024, 8, 16)
    at = day.replace(hour=15)
    cases = {"2024-08-16T00:00:00": day, "2024-08-16": day, "2024-13-01": None, "TBD": None, None: None, "2024": None,
             "2024-08-16T15:00:00+00:00": at, "2024-08-16T15:00:00Z": at, "20240816": day, "20240816T150000Z": at,
             "2024-08-16T20:30:00.000+0530": at, "2024-08-16T14:00-01": at, "20240230": None, "202408161": None}
    assert [r[0] for r in one(spark, [(c,) for c in cases], "s string", sc.coerce_date("s"))] == list(cases.values())


def test_lenient_double(spark):
    cases = {"12": 12.0, "24-113": 24.0, "n/a": 0.0, None: 0.0, "": 0.0, "-5": -5.0, "5d": 0.0, "NaN": 0.0, "1e2": 100.0}
    assert [r[0] for r in one(spark, [(c,) for c in cases], "s string", sc.lenient_double("s"))] == list(cases.values())


def test_days_and_progress(spark):
    rows = [("2024-08-16 12:00:00", "2024-08-17 11:59:00"), ("2024-08-16 12:00:00", "2024-08-17 12:00:00")]
    ts = [F.col(c).cast("timestamp_ntz") for c in "ab"]
    assert [r[0] for r in one(spark, rows, "a string, b string", sc.whole_days(*ts))] == [0, 1]
    got = one(spark, [(19.0, 38.0), (None, 38.0), (5.0, 0.0), (50.0, 38.0)], "w double, s double", sc.season_progress("w", "s"))
    assert [r[0] for r in got] == [0.5, 0.0, 0.0, 1.0]
    assert one(spark, [("2024-01-01",), (None,)], "d string", sc.ordinal_day(F.col("d").cast("date"))) == [(738886,), (0,)]


def test_event_flags(spark):
    rows = [("Goal", None, 83.0, None), ("Goal", None, 82.9, None), ("Goal", None, None, None),
            ("CornerAwarded", "Unsuccessful", None, None), ("CornerAwarded", "Successful", None, None),
            ("Pass", "Unsuccessful", None, 90.0), ("Pass", "Successful", None, 75.0), (None, None, 99.0, 99.0)]
    flags = event_flags()
    got = one(spark, rows, "type string, outcome_type string, x double, end_x double",
              *[flags[n] for n in ("sot", "box_shots", "corners", "deep_comp", "passes")])
    yes = [[i for i, v in enumerate(r) if v] for r in got]
    assert yes == [[0, 1], [0], [0], [], [2], [4], [3, 4], []]


def test_name_normalisation(spark):
    names = spark.createDataFrame([("1. FC Köln",), ("FC",), ("Atlético de Madrid",)], "n string")
    got = [r.tokens for r in normalize_names(names, "n").collect()]
    assert got == [["koln"], [], ["atletico", "madrid"]]


def test_outcomes(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.0), (1.0, 1.0, -1.0), (0.0, 1.2, 0.5), (2.7, 0.4, 1.0)], "h double, a double, r double")
    fast = [tuple(r) for r in outcome_probs(df, "h", "a", "r").select("p_home", "p_draw", "p_away").collect()]
    grid = [tuple(r) for r in df.select(*grid_outcomes(score_grid("h", "a", "r"))).collect()]
    for f, g in zip(fast, grid):
        assert abs(sum(f) - 1) < 1e-12 and all(abs(x - y) < 1e-12 for x, y in zip(f, g))
    assert fast[0][0] == fast[0][2] and fast[1][1] > fast[0][1]
    independent = outcome_probs(df.limit(1), "h", "a").select("p_home", "p_draw", "p_away").first()
    assert all(abs(x - y) < 1e-15 for x, y in zip(independent, fast[0]))


def test_temperature_and_pick(spark):
    df = spark.createDataFrame([(0.4, 0.2, 0.4), (0.0, 0.3, 0.7)], "h double, d double, a double")
    same = [tuple(r) for r in df.select(*apply_temperature(("h", "d", "a"), 1.0)).collect()]
    assert same == [(0.4, 0.2, 0.4), (0.0, 0.3, 0.7)]
    warm = [tuple(r) for r in df.select(*apply_temperature(("h", "d", "a"), 2.0)).collect()]
    assert abs(sum(warm[1]) - 1) < 1e-12 and warm[1][2] == max(warm[1]) and warm[1][0] > 0
    assert [tuple(r) for r in df.select(pick("h", "d", "a"), pick("h", "d", "a", 3.0)).collect()] == [(0, 1), (2, 1)]


def test_date_rewriting_stands_outside_the_generated_method(spark):
    """In line it made a method too long for the JVM to compile, 4 times as slow for plain dates."""
    rows = [("2024-01-02",), ("20240102T0304",), ("2024-01-02T03:04:05+02:00",), ("TBD",), (None,)]
    df = spark.createDataFrame(rows, "d string").repartition(1).select(sc.coerce_date("d").alias("t"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "transform(" in plan
    assert [str(r.t) for r in df.collect()] == ["2024-01-02 00:00:00", "2024-01-02 03:04:00", "2024-01-02 01:04:05", "None", "None"]
