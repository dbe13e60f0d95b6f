"""Live event counts and live team state."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator, Sequence
from datetime import timedelta
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from touchline.config import FeatureConfig
from touchline.functions.events import event_flags
from touchline.sources.tables import read_table, replace_partitions


def live_event_stats(events: DataFrame) -> DataFrame:
    """Eight running counts per (game_id, team), for update or complete mode."""
    return events.groupBy("game_id", "team").agg(*[F.count_if(c).alias(n) for n, c in event_flags().items()])


def windowed_counts(events: DataFrame, time: str, keys: Sequence[str], length: str, slide: str | None = None,
                    delay: str = "10 minutes", **aggs: Column) -> DataFrame:
    """Tumbling or sliding windows with a watermark; state of closed windows is dropped."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    grouped = events.withWatermark(time, delay).groupBy(window.alias("w"), *keys)
    totals = grouped.agg(F.count(F.lit(1)).alias("events"), *[c.alias(n) for n, c in aggs.items()])
    return totals.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                         *keys, "events", *aggs)


def sessions(events: DataFrame, time: str, keys: Sequence[str], gap: str, delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("events")).select(
        F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "events")


def start_split(events: DataFrame, time: str, delay: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Every batch's rows into ``folder``/rows, partitioned by ``_late`` and ``_batch``, so that late rows are kept and counted.

    A row is late when it lies before the newest time of all earlier batches less ``delay``: the watermark that batch starts with. The
    newest time of each batch is a row of ``folder``/marks. A batch that runs again replaces its own partitions.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        marks = read_table(batch.sparkSession, f"{folder}/marks")
        seen = None if marks is None else marks.where(F.col("_batch") < batch_id).agg(F.max("newest")).first()[0]
        late = F.lit(False) if seen is None else F.coalesce(F.col(time) < F.lit(seen) - F.expr(f"INTERVAL {delay}"), F.lit(False))
        replace_partitions(batch.withColumns({"_late": late, "_batch": F.lit(batch_id)}), f"{folder}/rows", ["_late", "_batch"])
        replace_partitions(batch.agg(F.max(time).alias("newest")).withColumn("_batch", F.lit(batch_id)), f"{folder}/marks", ["_batch"])

    return events.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_append(totals: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Totals that no later row can change, once each."""
    return totals.writeStream.format("parquet").option("path", table).outputMode("append").option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_updates(totals: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Each batch's changed totals go to their own partition; the newest batch per key is the current total."""
    def store(batch: DataFrame, batch_id: int) -> None:
        replace_partitions(batch.withColumn("_batch", F.lit(batch_id)), table, ["_batch"])

    return totals.writeStream.outputMode("update").foreachBatch(store).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_totals(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    values = [c for c in table.columns if c not in {*keys, "_batch"}]
    newest = F.max_by(F.struct(*values), "_batch").alias("v")
    return table.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])


STATE_OUTPUT = (
    "group string, game_id string, home_team string, away_team string, status string, "
    "home_elo double, away_elo double, h_gf_ema double, h_ga_ema double, h_pts_ema double, h_played long, "
    "a_gf_ema double, a_ga_ema double, a_pts_ema double, a_played long"
)
_TEAM = "elo double, gf double, ga double, pts double, played long"
_PENDING = "date timestamp, game string, game_id string, home_team string, away_team string, home_goals long, away_goals long"
_FIELDS = ["date", "game", "game_id", "home_team", "away_team", "home_goals", "away_goals"]
_DATE = pa.timestamp("us")
_WAITING = pa.schema(list(zip(_FIELDS, [_DATE, *[pa.large_string()] * 4, pa.int64(), pa.int64()])))
#: Rows that are Python objects at a time.
CHUNK = 10_000
Match = namedtuple("Match", _FIELDS)


def _arrow(rows: pd.DataFrame) -> pa.Table:
    return pa.Table.from_pandas(rows[_FIELDS], _WAITING, preserve_index=False)


def _tuples(rows: pa.Table) -> Iterator[Match]:
    return map(Match._make, zip(*(c.to_pylist() for c in rows.columns)))


class TeamState(StatefulProcessor):
    """Ratings and form of the teams of one group of linked competitions, one state entry per team.

    Rows wait in a buffer until the newest date seen lies ``delay_days`` past them and are then handled
    in (date, game, game_id) order: a played match is emitted with the state before it and folded in, an
    unplayed fixture reads the state and changes nothing. A row older than what has been handled comes
    out with status 'late' for a side table. Each call reads a team's state once and writes it once; rows stay in Arrow until their turn.
    """

    def __init__(self, cfg: FeatureConfig, delay_days: float) -> None:
        self.cfg, self.delay = cfg, timedelta(days=delay_days)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.teams = handle.getMapState("teams", "team string", _TEAM)
        self.pending = handle.getListState("pending", _PENDING)
        self.times = handle.getValueState("times", "newest timestamp, handled timestamp")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        newest, handled = self.times.get() if self.times.exists() else (None, None)
        waiting = [_arrow(pd.DataFrame([tuple(w) for w in self.pending.get()], columns=_FIELDS))]
        for chunk in rows:
            arrived = _arrow(chunk)
            if handled is not None:
                late = pc.fill_null(pc.less_equal(arrived["date"], pa.scalar(handled, _DATE)), False)
                if pc.any(late).as_py():
                    yield self._frame([self._row(key[0], r, "late") for r in _tuples(arrived.filter(late))])
                    arrived = arrived.filter(pc.invert(late))
            waiting.append(arrived)
        rest = pa.concat_tables(waiting).combine_chunks()
        newest = max([t for t in (newest, pc.max(rest["date"]).as_py()) if t is not None], default=None)
        if newest is not None:
            due = pc.fill_null(pc.less_equal(rest["date"], pa.scalar(newest - self.delay, _DATE)), False)
            ready = rest.filter(due)
            if ready.num_rows:
                rest = rest.filter(pc.fill_null(pc.invert(pc.or_(due, pc.is_null(rest["date"]))), False))
                order = pc.sort_indices(ready, sort_keys=[(f, "ascending") for f in _FIELDS])
                handled = ready["date"][order[-1].as_py()].as_py()
                teams: dict[str, tuple] = {}
                changed: set[str] = set()
                for start in range(0, len(order), CHUNK):
                    yield self._frame([self._handle(key[0], r, teams, changed) for r in _tuples(ready.take(order[start:start + CHUNK]))])
                for name in changed:
                    self.teams.updateValue((name,), teams[name])
        if rest.num_rows:
            self.pending.put([tuple(r) for r in _tuples(rest)])
        else:
            self.pending.clear()
        if newest is not None:
            self.times.update((newest, handled))

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[f.split()[0] for f in STATE_OUTPUT.split(", ")])

    def _team(self, name: str) -> tuple:
        return tuple(self.teams.getValue((name,))) if self.teams.containsKey((name,)) else (
            self.cfg.elo_base, None, None, None, 0)

    def _row(self, group: str, r: Match, status: str, home=(None,) * 5, away=(None,) * 5) -> tuple:
        def form(t):
            return [0.0 if v is None else v for v in t[1:4]] if t[0] is not None else [None] * 3

        return (group, r.game_id, r.home_team, r.away_team, status, home[0], away[0],
                *form(home), home[4], *form(away), away[4])

    def _handle(self, group: str, r: Match, teams: dict[str, tuple], changed: set[str]) -> tuple:
        """The row's output; ``teams`` holds the states read so far in this call, ``changed`` those to be written."""
        for name in (r.home_team, r.away_team):
            if name not in teams:
                teams[name] = self._team(name)
        home, away = teams[r.home_team], teams[r.away_team]
        played = r.home_goals is not None and r.away_goals is not None
        if played:
            h, a = r.home_goals, r.away_goals
            score = 1.0 if h > a else 0.5 if h == a else 0.0
            expected = 1.0 / (1.0 + 10.0 ** ((away[0] - home[0]) / 400.0))
            teams[r.home_team] = self._folded(home, self.cfg.elo_k * (score - expected), h, a)
            teams[r.away_team] = self._folded(away, self.cfg.elo_k * ((1.0 - score) - (1.0 - expected)), a, h)
            changed.update((r.home_team, r.away_team))
        return self._row(group, r, "played" if played else "fixture", home, away)

    def _folded(self, old: tuple, change: float, scored: int, conceded: int) -> tuple:
        points = 3.0 if scored > conceded else 1.0 if scored == conceded else 0.0
        q = self.cfg.ema_alpha
        emas = [float(x) if was is None else float(x) * q + was * (1.0 - q)
                for was, x in zip(old[1:4], (scored, conceded, points))]
        return (old[0] + change, *emas, old[4] + 1)

    def close(self) -> None:
        pass


def live_team_state(matches: DataFrame, cfg: FeatureConfig = FeatureConfig(), delay_days: float = 3.0) -> DataFrame:
    """``matches``: group, date (timestamp), game, game_id, home_team, away_team, home_goals, away_goals.

    Needs the RocksDB state store provider in the session configuration.
    """
    return matches.groupBy("group").transformWithStateInPandas(
        statefulProcessor=TeamState(cfg, delay_days), outputStructType=STATE_OUTPUT, outputMode="append",
        timeMode="None")
