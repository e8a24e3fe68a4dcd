"""Column contracts and neutral fills. The names are fixed values other systems read."""

from __future__ import annotations


def _hda(*stems: str) -> list[str]:
    """home_, away_ and diff_ form of each stem."""
    return [f"{side}_{s}" for s in stems for side in ("home", "away", "diff")]


TEAM_STRENGTHS = ["team_off_strength", "team_def_strength", "team_schedule_strength", "team_split_strength",
                  "team_form_blend"]
GOALIE_STRENGTHS = ["goalie_talent_strength", "goalie_workload", "goalie_fatigue", "goalie_team_adj_strength"]
LINEUP = ["lineup_availability", "top_skater_impact", "deployment_concentration"]
SHARES = ["cf_pct", "xgf_pct", "hdcf_pct", "cf_pct_5v5", "xgf_pct_5v5", "hdcf_pct_5v5"]
TEAM_STATS = ["pp_pctg", "faceoff_winning_pctg", "sog", "hits", "blocked_shots"]
SKATER_STATS = ["goals", "assists", "points", "sog", "plus_minus", "hits", "blocked_shots"]
STANDING_MEASURES = ["games_played", "point_pctg", "win_pctg", "regulation_win_pctg", "goal_for", "goal_against",
                     "goal_differential", "l10_points", "home_wins", "home_losses", "road_wins", "road_losses",
                     "points", "wins", "losses", "ot_losses"]

_SIDE_STANDINGS = ["point_pctg", "win_pctg", "reg_win_pctg", "goal_diff", "l10_points"]
_SIDE_ROLLING = ["goalie_sv_pctg", "goalie_gsax", "rest_days", "is_b2b", "pp_pctg", "faceoff_pctg", "sog", "hits",
                 "blocked_shots"]

# Fixed values. Model inputs: per side, then differences, then strengths, then the rest.
FEATURES = (
    [f"home_{c}" for c in _SIDE_STANDINGS + _SIDE_ROLLING]
    + [f"away_{c}" for c in _SIDE_STANDINGS + _SIDE_ROLLING]
    + [f"diff_{c}" for c in ("point_pctg", "goal_diff", "l10_points", "points", "goalie_sv_pctg", "goalie_gsax")]
    + ["rest_advantage", "diff_pp_pctg", "diff_faceoff_pctg", "diff_sog"]
    + [f"diff_{c}" for c in SHARES]
    + _hda(*TEAM_STRENGTHS, *GOALIE_STRENGTHS, *LINEUP)
    + ["home_home_win_pctg", "away_road_win_pctg", "diff_home_road_pctg",
       "h2h_home_win_pctg", "home_elo", "away_elo", "elo_diff"])

# The lean inputs.
LEAN = ["elo_diff", "diff_goal_diff", "diff_point_pctg", "diff_points", "diff_home_road_pctg", "h2h_home_win_pctg",
        "diff_goalie_sv_pctg", "diff_goalie_gsax", "diff_pp_pctg", "diff_faceoff_pctg", "diff_sog", "diff_xgf_pct",
        "diff_hdcf_pct", "diff_xgf_pct_5v5", "diff_hdcf_pct_5v5"]

SERIES = ["series_game_number", "home_series_wins", "away_series_wins", "seed_diff"]
PLAYOFF_FEATURES = FEATURES + SERIES

EVENT_FEATURES = ["shot_distance", "shot_angle", "is_behind_net", "shot_type_code", "is_rebound", "period", "is_pp",
                  "is_sh", "is_en"]
PLAYER_FEATURES = [f"rolling_{c}" for c in SKATER_STATS] + ["rolling_toi_sec", "is_home", "position_code"]

# Fixed values. Neutral fills; any model input not named here fills with 0.5.
_SIDE_FILLS = {"goalie_gsax": 0.0, "goalie_sv_pctg": 0.90, "rest_days": 2.0, "is_b2b": 0.0, "sog": 30.0,
               "hits": 20.0, "blocked_shots": 14.0, "pp_pctg": 0.20, "faceoff_pctg": 0.50, "goal_diff": 0.0,
               "l10_points": 0.0, "elo": 1500.0}
_DIFF_FILLS = ["goalie_gsax", "goalie_sv_pctg", "sog", "pp_pctg", "faceoff_pctg", "goal_diff", "points", "l10_points"]
NEUTRAL_FILLS = (
    {f"{side}_{c}": v for c, v in _SIDE_FILLS.items() for side in ("home", "away")}
    | {f"diff_{c}": 0.0 for c in _DIFF_FILLS} | {"rest_advantage": 0.0, "elo_diff": 0.0}
    | {c: 0.0 for c in _hda(*TEAM_STRENGTHS, *GOALIE_STRENGTHS, *LINEUP)})

META = {"game_id": "long", "season": "long", "date": "date", "home_team_id": "long", "away_team_id": "long"}
TRAINING_CONTRACT = META | {c: "double" for c in FEATURES} | {"target": "int"}
PLAYOFF_CONTRACT = META | {c: "double" for c in PLAYOFF_FEATURES} | {"target": "int"}
STORE_CONTRACT = {"game_id": "long", "season": "long", "date": "date", "game_type": "int", "home_team_id": "long",
                  "away_team_id": "long", "target": "int", "feature_version": "string",
                  **{c: "double" for c in PLAYOFF_FEATURES}}
STORE_VERSION = "v2.0"

SERVING_KEYS = ["game_id", "prediction_date", "feature_version", "model_version"]
DAILY_KEYS = ["date", "feature_version", "model_version"]
SERVING_REQUIRED = ["game_id", "date", "season", "home_team_id", "away_team_id", "feature_version", "model_version",
                    "run_id", "generated_at", "home_win_probability", "expected_home_goals", "expected_away_goals",
                    "most_likely_home_score", "most_likely_away_score", "is_finalized", "data_source",
                    "prediction_date"]
PREDICTION_REQUIRED = ["game_id", "game_date", "game_type", "home_team_id", "away_team_id", "home_win_prob",
                       "away_win_prob", "pred_home_goals", "pred_away_goals", "model_versions", "input_snapshot",
                       "output_snapshot", "status"]
