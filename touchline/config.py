"""Every numeric default is an explicit field, so a caller can set each one."""

from __future__ import annotations

from dataclasses import dataclass, field

CLASS_NAMES = ("home_win", "draw", "away_win")
UNK_TOKEN, UNK_INDEX = "<unk>", 0

PER_SIDE = (
    "gf_ema", "ga_ema", "sot_ema", "pts_ema", "rest_days", "played",
    "venue_gf_ema", "venue_ga_ema", "venue_pts_ema", "venue_played",
    "congestion14", "new_to_season",
    "shots_ema", "shots_against_ema", "box_shots_ema", "deep_comp_ema", "ws_cov",
)
NUMERIC_FEATURES = (
    *(f"h_{f}" for f in PER_SIDE),
    *(f"a_{f}" for f in PER_SIDE),
    "home_elo", "away_elo",
    "gf_ema_diff", "ga_ema_diff", "pts_ema_diff", "elo_diff", "venue_pts_ema_diff",
    "h2h_played", "h2h_gd_ema",
    "season_progress",
)
CATEGORICAL = ("home_team_idx", "away_team_idx", "league_idx", "season_idx")
GOAL_TARGETS = ("home_goals", "away_goals")
STAT_TARGETS = ("home_sot", "away_sot", "home_corners", "away_corners", "home_cards", "away_cards")
EVENT_STATS = ("sot", "corners", "cards", "shots", "box_shots", "deep_comp", "passes", "passes_ok")


@dataclass(frozen=True)
class FeatureConfig:
    elo_base: float = 1500.0
    elo_k: float = 20.0
    ema_alpha: float = 0.2
    default_rest_days: float = 7.0
    max_rest_days: float = 30.0
    congestion_window_days: int = 14
    congestion_memory: int = 15
    h2h_played_cap: int = 10
    name_threshold: float = 0.40


@dataclass(frozen=True)
class SplitConfig:
    train_fraction: float = 0.70
    val_fraction: float = 0.15


@dataclass(frozen=True)
class LossConfig:
    lambda_outcome: float = 1.0
    lambda_sot: float = 1.0
    lambda_corners: float = 1.0
    lambda_cards: float = 1.0
    huber_delta: float = 1.0


@dataclass(frozen=True)
class ModelConfig:
    reg_param: float = 0.01
    half_life_days: float = 390.0
    class_weight_power: float = 0.0
    max_goals: int = 10
    ensemble: int = 1
    seed: int = 0
    # Most passes of a fit, and the part of the loss's gradient below which it has come to rest.
    iterations: int = 60
    tolerance: float = 1e-8
    features: tuple[str, ...] = field(default=NUMERIC_FEATURES)
