"""Declared schemas of the landed collections."""

from __future__ import annotations

from pyspark.sql.types import StructType

_TAGS = "_source string, _league string, _season string"
_CORRUPT = "_corrupt_record string"

COLLECTIONS = {
    "schedule": "league string, season string, game string, game_id string, date string, week double, "
                "home_team string, away_team string, score string",
    "player_standard": "league string, season string, team string, player string, age string, "
                       "Performance_Gls string, `Playing Time_90s` string, `Playing Time_Min` string",
    "player_keeper": "league string, season string, team string, player string, "
                     "`Performance_Save%` string, `Playing Time_Min` string",
    "player_shooting": "league string, season string, team string, player string, Standard_Gls string, "
                       "Standard_Sh string, Standard_SoT string",
    "player_playing_time": "league string, season string, team string, player string, "
                           "`Playing Time_MP` string, `Playing Time_Min` string, `Playing Time_90s` string",
    "player_misc": "league string, season string, team string, player string, Performance_CrdY string, "
                   "Performance_CrdR string, Performance_Fls string",
    "match_events": "game_id string, game string, team string, type string, outcome_type string, "
                    "x double, end_x double",
}


def landed_ddl(kind: str) -> str:
    """Columns of a collection, its provenance tags and the text of a line that cannot be parsed."""
    if kind not in COLLECTIONS:
        raise ValueError(f"unknown collection {kind!r}; known: {sorted(COLLECTIONS)}")
    return f"{COLLECTIONS[kind]}, {_TAGS}, {_CORRUPT}"


def landed_schema(kind: str) -> StructType:
    return StructType.fromDDL(landed_ddl(kind))
