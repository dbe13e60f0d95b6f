"""The feature table against a sequential replay, and its properties."""

import datetime as dt
import math
from collections import defaultdict

from pyspark.sql import functions as F

from touchline.config import NUMERIC_FEATURES, FeatureConfig
from touchline.operators import rolling
from touchline.plans import features as ft
from touchline.session import materialize

CFG = FeatureConfig()
EVENTS = {"sot": "sot", "shots": "shots", "box": "box_shots", "deep": "deep_comp"}


def step(old, new, a=CFG.ema_alpha):
    return float(new) if old is None else new * a + old * (1 - a)


def replay(matches, spans):
    """One pass in order: emit first, update after."""
    team = defaultdict(lambda: defaultdict(lambda: None))
    dates, seasons, pairs = defaultdict(list), defaultdict(set), defaultdict(lambda: [None, 0])
    elo, out = defaultdict(lambda: CFG.elo_base), {}

    def days(a, b):
        return math.floor((b - a).total_seconds() / 86400)

    for m in matches:
        row = {}
        for p, me, venue in (("h", m.home_team, "home"), ("a", m.away_team, "away")):
            s, prev = team[me], f"{(int(m.season[:2]) - 1) % 100:02d}{m.season[:2]}"
            for k in ("gf", "ga", "pts", "sot", "shots", "shots_against"):
                row[f"{p}_{k}_ema"] = s[k] or 0.0
            row[f"{p}_box_shots_ema"], row[f"{p}_deep_comp_ema"] = s["box"] or 0.0, s["deep"] or 0.0
            for k in ("gf", "ga", "pts"):
                row[f"{p}_venue_{k}_ema"] = s[venue + k] or 0.0
            row[f"{p}_played"], row[f"{p}_venue_played"] = len(dates[me]), s[venue] or 0
            row[f"{p}_ws_cov"] = 1.0 if s["cov"] else 0.0
            row[f"{p}_rest_days"] = max(0, min(days(dates[me][-1], m.date), 30)) if dates[me] else 7.0
            row[f"{p}_congestion14"] = sum(0 <= days(d, m.date) <= 14 for d in dates[me][-15:])
            row[f"{p}_new_to_season"] = 0.0 if prev in seasons[me] else 1.0
        row["home_elo"], row["away_elo"] = elo[m.home_team], elo[m.away_team]
        for c in ("gf_ema", "ga_ema", "pts_ema", "venue_pts_ema"):
            row[f"{c}_diff"] = row[f"h_{c}"] - row[f"a_{c}"]
        row["elo_diff"] = row["home_elo"] - row["away_elo"]
        pair = pairs[frozenset((m.home_team, m.away_team))]
        sign = -1 if m.home_team > m.away_team else 1
        row["h2h_played"], row["h2h_gd_ema"] = min(pair[1], 10), sign * (pair[0] or 0.0)
        span = spans[m.league, m.season]
        row["season_progress"] = max(0, min(m.week / span, 1)) if m.week is not None and span > 0 else 0.0
        out[m.row_idx] = row

        e = 1 / (1 + 10 ** ((elo[m.away_team] - elo[m.home_team]) / 400))
        got = (1, 0.5, 0)[m.label]
        elo[m.home_team] += CFG.elo_k * (got - e)
        elo[m.away_team] -= CFG.elo_k * (got - e)
        for me, venue, f, a, mine, other in ((m.home_team, "home", m.home_goals, m.away_goals, "home", "away"),
                                             (m.away_team, "away", m.away_goals, m.home_goals, "away", "home")):
            s, pts = team[me], 3 if f > a else 1 if f == a else 0
            for k, v in (("gf", f), ("ga", a), ("pts", pts)):
                s[k], s[venue + k] = step(s[k], v), step(s[venue + k], v)
            s[venue] = (s[venue] or 0) + 1
            if m.targets_present:
                s["cov"] = True
                for k, c in EVENTS.items():
                    s[k] = step(s[k], m[f"{mine}_{c}"])
                s["shots_against"] = step(s["shots_against"], m[f"{other}_shots"])
            dates[me].append(m.date)
            seasons[me].add(m.season)
        pair[0], pair[1] = step(pair[0], sign * (m.home_goals - m.away_goals)), pair[1] + 1
    return out


def test_equals_sequential_replay(batch):
    matches = batch["matches"].orderBy("row_idx").collect()
    spans = {(r.league, r.season): r.span for r in ft.season_span(batch["parsed"]).collect()}
    want = replay(matches, spans)
    rows = batch["table"].select("row_idx", *NUMERIC_FEATURES).collect()
    assert len(rows) == len(matches) == len(want)
    for r in rows:
        for c in NUMERIC_FEATURES:
            assert abs(r[c] - want[r.row_idx][c]) < 1e-7, (r.row_idx, c, r[c], want[r.row_idx][c])


def test_row_index_is_dense_and_ordered(batch):
    m = batch["matches"]
    assert m.agg(F.min("row_idx"), F.max("row_idx"), F.countDistinct("row_idx")).first() == (0, m.count() - 1, m.count())
    keys = [(r.date, r.game, r.game_id) for r in m.orderBy("row_idx").collect()]
    assert keys == sorted(keys)


def test_later_matches_change_nothing_before(spark, batch):
    """Features of early rows stay the same when later matches are taken away."""
    m = batch["matches"]
    early = m.where("row_idx < 400")
    a, b = (ft.side_features(ft.team_rows(x), CFG).where("row_idx < 400") for x in (m, early))
    cols = [c if c in ("row_idx", "team", "is_home") else F.round(c, 9).alias(c) for c in a.columns]
    assert a.select(*cols).exceptAll(b.select(*cols)).isEmpty()


def test_block_sizes_do_not_matter(batch, monkeypatch):
    rows = materialize(ft.team_rows(batch["matches"]))
    a = ft.side_features(rows, FeatureConfig())
    monkeypatch.setattr(rolling, "FADE", 15.0)
    monkeypatch.setattr(rolling, "FAN", 4)
    b = ft.side_features(rows, FeatureConfig())
    cols = [c if c in ("row_idx", "team", "is_home") else F.round(c, 9).alias(c) for c in a.columns]
    a, b = materialize(a.select(*cols)), materialize(b.select(*cols))
    assert a.count() == b.count() and a.exceptAll(b).isEmpty()


def test_snapshot_equals_next_row(spark, batch):
    """Peeking at the last match from the history before it gives its training features."""
    m = batch["matches"]
    last = m.agg(F.max("row_idx")).first()[0]
    known = ft.history(materialize(m.where(F.col("row_idx") < last)), CFG)
    fixture = m.where(F.col("row_idx") == last).withColumn("fixture_id", F.col("game_id"))
    spans = ft.season_span(batch["parsed"])
    peeked = ft.peek_features(fixture.select("fixture_id", "date", "league", "season", "home_team", "away_team", "week"),
                              known, CFG, spans).first()
    row = batch["table"].where(F.col("row_idx") == last).first()
    assert peeked.home_known and peeked.away_known
    for c in NUMERIC_FEATURES:
        assert abs(peeked[c] - row[c]) < 1e-9, c
    unknown = spark.createDataFrame([("f", row.date, "L0", "0203", "new", "newer")],
                                    "fixture_id string, date timestamp_ntz, league string, season string, home_team string, away_team string")
    cold = ft.peek_features(unknown, known, CFG).first()
    assert (cold.home_known, cold.home_elo, cold.h_rest_days, cold.h_played, cold.h2h_played) == (False, 1500.0, 7.0, 0.0, 0.0)


def test_as_of_equals_peeking_for_later_fixtures_and_sees_no_later_match(spark, batch):
    m, spans = batch["matches"], ft.season_span(batch["parsed"])
    columns = ("fixture_id", "date", "league", "season", "home_team", "away_team", "week")
    end = m.agg(F.max("date")).first()[0]
    later = m.where("row_idx % 97 = 0").withColumn("fixture_id", F.col("game_id")).withColumn("date", F.lit(end + dt.timedelta(days=2)).cast("timestamp_ntz"))
    want = ft.peek_features(later.select(*columns), ft.history(m, CFG), CFG, spans)
    got = ft.peek_as_of(later.select(*columns), m, CFG, spans)
    assert got.columns == want.columns
    short = [F.round(c, 7).alias(c) if c in NUMERIC_FEATURES else F.col(c) for c in got.columns]
    assert got.count() == want.count() > 3 and got.select(*short).exceptAll(want.select(*short)).isEmpty()
    half = m.where("row_idx < 500")
    past = half.where("row_idx % 50 = 7").withColumn("fixture_id", F.col("game_id")).select(*columns, "game")
    a, b = (ft.peek_as_of(past, x, CFG, spans).select(*short) for x in (m, half))
    assert a.count() == 10 and a.exceptAll(b).isEmpty()


def test_same_team_is_set_aside(spark):
    df = spark.createDataFrame([("l", "2425", "g", "1", "2024-08-16", 1.0, "a", "a", "1-0"),
                                ("l", "2425", "g", "2", "TBD", 1.0, "a", "b", "1-0"),
                                ("l", "2425", "g", "3", "2024-08-16", None, "a", "b", "2–2")],
                               "league string, season string, game string, game_id string, date string, week double, home_team string, away_team string, score string")
    parsed = ft.parsed_matches(df)
    assert {r.game_id: r.reject_reason for r in ft.match_quarantine(parsed).collect()} == {"1": "same_team", "2": "date"}
    assert [(r.game_id, r.label) for r in ft.valid_matches(parsed).collect()] == [("3", 1)]
