"""Predicates over on-ball events and the per-team counts built from them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Event type names and pitch bands.
ON_TARGET = ["Goal", "SavedShot"]
SHOTS = ["Goal", "SavedShot", "MissedShots", "ShotOnPost"]
CORNER, CARD, PASS, SUCCESSFUL = "CornerAwarded", "Card", "Pass", "Successful"
BOX_X, DEEP_END_X = 83.0, 75.0


def event_flags() -> dict[str, Column]:
    """One boolean per statistic, never null: an absent type, outcome or coordinate counts as no."""
    kind = F.coalesce(F.col("type"), F.lit(""))
    good = F.coalesce(F.col("outcome_type"), F.lit("")) == SUCCESSFUL
    x, end_x = (F.coalesce(F.col(c), F.lit(-1.0)) for c in ("x", "end_x"))
    shot = kind.isin(SHOTS)
    completed = (kind == PASS) & good
    return {
        "sot": kind.isin(ON_TARGET),
        "corners": (kind == CORNER) & good,
        "cards": kind == CARD,
        "shots": shot,
        "box_shots": shot & (x >= BOX_X),
        "deep_comp": completed & (end_x >= DEEP_END_X),
        "passes": kind == PASS,
        "passes_ok": completed,
    }
