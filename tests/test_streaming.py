import datetime as dt
import random

import pandas as pd

import __spark_entry__ as entry
from touchline.config import FeatureConfig
from touchline.plans import features as ft
from touchline.operators.ratings import elo
from touchline.streaming import live


def test_live_state_equals_batch(spark, sf, batch):
    streamed = {r.game_id: r for r in entry.queries()["live_team_state"](spark, sf).collect()}
    m = batch["matches"]
    rated = m.join(elo(m), "row_idx").collect()
    assert len(streamed) == len(rated)
    for r in rated:
        s = streamed[r.game_id]
        assert abs(s.home_elo - r.home_elo) < 1e-5 and abs(s.away_elo - r.away_elo) < 1e-5


def test_sessions(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, at), (1, at + dt.timedelta(minutes=4)), (1, at + dt.timedelta(minutes=30)), (2, at)]
    spark.createDataFrame(rows, "user long, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user long, ts timestamp").parquet(str(tmp_path / "in"))
    q = live.sessions(stream, "ts", ["user"], "10 minutes").writeStream.format("memory").queryName("sess").outputMode(
        "complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.user, r.events) for r in spark.table("sess").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_live_event_stats_equal_batch(spark, batch, tmp_path):
    batch["events"].write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch["events"].schema).parquet(str(tmp_path / "in"))
    live.write_updates(live.live_event_stats(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = live.current_totals(spark.read.parquet(str(tmp_path / "out")), ["game_id", "team"])
    want = ft.event_team_stats(batch["events"]).select(*got.columns)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


class Handle:
    """State in plain dictionaries that counts how often a team's entry is read and written."""

    def __init__(self):
        self.calls, self.kept = {"reads": 0, "writes": 0}, {}

    def getMapState(self, *_):
        calls, kept = self.calls, self.kept

        class Teams:
            containsKey = staticmethod(kept.__contains__)

            def getValue(self, key):
                calls["reads"] += 1
                return kept[key]

            def updateValue(self, key, value):
                calls["writes"] += 1
                kept[key] = value
        return Teams()

    def getListState(self, *_):
        class Rows(list):
            def get(self):
                return iter(self)

            def put(self, rows):
                self[:] = rows
        return Rows()

    def getValueState(self, *_):
        class Value:
            value = None

            def exists(self):
                return self.value is not None

            def get(self):
                return self.value

            def update(self, value):
                self.value = value
        return Value()


def test_team_state_is_read_and_written_once_a_call(monkeypatch):
    monkeypatch.setattr(live, "CHUNK", 7)
    day, rng = dt.datetime(2024, 1, 1), random.Random(5)
    rows = []
    for i in range(300):
        home, away = rng.sample("abcd", 2)
        goals = (rng.randint(0, 3), rng.randint(0, 3)) if i % 9 else (None, None)
        rows.append((day + dt.timedelta(days=i // 3), f"g{rng.random()}", f"{i}", home, away, *goals))
    order = sorted(rows[:150], key=lambda r: r[:3]) + sorted(rows[150:], key=lambda r: r[:3])
    cfg, elo_of, want = FeatureConfig(), {}, {}
    for r in order:
        h, a = elo_of.get(r[3], cfg.elo_base), elo_of.get(r[4], cfg.elo_base)
        want[r[2]] = (h, a)
        if r[5] is not None:
            expected, score = 1 / (1 + 10 ** ((a - h) / 400)), 1.0 if r[5] > r[6] else 0.5 if r[5] == r[6] else 0.0
            elo_of[r[3]], elo_of[r[4]] = h + cfg.elo_k * (score - expected), a + cfg.elo_k * ((1 - score) - (1 - expected))
    handle, state, got = Handle(), live.TeamState(cfg, 3.0), []
    state.init(handle)
    end = (day + dt.timedelta(days=200), "end", "end", "-", "--", None, None)
    for part in (rows[:150], [*rows[150:], end, (day, "old", "old", "a", "b", 1, 0)]):
        rng.shuffle(part)
        chunks = [pd.DataFrame(part[i:i + 40], columns=live._FIELDS) for i in range(0, len(part), 40)]
        handle.calls.update(reads=0, writes=0)
        got += [r for out in state.handleInputRows(("L",), iter(chunks), None) for r in out.itertuples(index=False)]
        assert handle.calls["reads"] <= 4 and handle.calls["writes"] <= 4
    late = [r for r in got if r.status == "late"]
    assert [r.game_id for r in late] == ["old"]
    handled = [r for r in got if r.status != "late"]
    assert [r.game_id for r in handled] == [r[2] for r in sorted(rows, key=lambda r: r[:3])]
    assert all((r.status == "fixture") == (int(r.game_id) % 9 == 0) for r in handled)
    assert all(abs(r.home_elo - want[r.game_id][0]) < 1e-9 and abs(r.away_elo - want[r.game_id][1]) < 1e-9 for r in handled)
