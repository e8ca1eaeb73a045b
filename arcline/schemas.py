"""Table contracts: raw-to-clean names, typed schemas, keys, checks. All fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: raw extract column -> table column -------------------------------------
SHOT_NAMES = {
    "GAME_ID": "game_id",
    "GAME_EVENT_ID": "game_event_id",
    "PLAYER_ID": "player_id",
    "TEAM_ID": "team_id",
    "PERIOD": "period",
    "MINUTES_REMAINING": "minutes_remaining",
    "SECONDS_REMAINING": "seconds_remaining",
    "EVENT_TYPE": "event_type",
    "ACTION_TYPE": "action_type",
    "SHOT_TYPE": "shot_type",
    "SHOT_ZONE_BASIC": "shot_zone_basic",
    "SHOT_ZONE_AREA": "shot_zone_area",
    "SHOT_ZONE_RANGE": "shot_zone_range",
    "SHOT_DISTANCE": "shot_distance",
    "LOC_X": "loc_x",
    "LOC_Y": "loc_y",
    "SHOT_ATTEMPTED_FLAG": "shot_attempted_flag",
    "SHOT_MADE_FLAG": "shot_made_flag",
    "GAME_DATE": "game_date",
    "HTM": "home_team_abbreviation",
    "VTM": "away_team_abbreviation",
}
TEAM_LOG_NAMES = {
    "SEASON_YEAR": "season_year",
    "GAME_ID": "game_id",
    "TEAM_ID": "team_id",
    "GAME_DATE": "game_date",
    "MATCHUP": "matchup",
    "WL": "win_loss",
    "MIN": "minutes",
    "FGM": "field_goals_made",
    "FGA": "field_goals_attempted",
    "FG_PCT": "field_goal_pct",
    "FG3M": "three_pointers_made",
    "FG3A": "three_pointers_attempted",
    "FG3_PCT": "three_point_pct",
    "FTM": "free_throws_made",
    "FTA": "free_throws_attempted",
    "FT_PCT": "free_throw_pct",
    "OREB": "offensive_rebounds",
    "DREB": "defensive_rebounds",
    "REB": "rebounds",
    "AST": "assists",
    "TOV": "turnovers",
    "STL": "steals",
    "BLK": "blocks",
    "BLKA": "blocked_att",
    "PF": "personal_fouls",
    "PFD": "fouls_drawn",
    "PTS": "points",
    "PLUS_MINUS": "plus_minus",
}
PLAYER_LOG_NAMES = {**TEAM_LOG_NAMES, "PLAYER_ID": "player_id"}
EVENT_NAMES = {
    "gameId": "game_id",
    "actionNumber": "action_number",
    "actionId": "action_id",
    "clock": "game_clock",
    "period": "period",
    "teamId": "team_id",
    "teamTricode": "team_tricode",
    "personId": "person_id",
    "playerName": "player_name",
    "xLegacy": "x_legacy",
    "yLegacy": "y_legacy",
    "shotDistance": "shot_distance",
    "shotResult": "shot_result",
    "isFieldGoal": "is_field_goal",
    "scoreHome": "score_home",
    "scoreAway": "score_away",
    "pointsTotal": "points_total",
    "location": "court_location",
    "description": "description",
    "actionType": "action_type",
    "subType": "sub_type",
    "videoAvailable": "video_available",
}
TEAM_NAMES = {
    "id": "team_id",
    "abbreviation": "abbreviation",
    "full_name": "full_name",
    "nickname": "nickname",
    "city": "city",
    "state": "state",
    "year_founded": "year_founded",
}

# --- fixed values: column kinds ----------------------------------------------------------
BOX_SCORE_COUNTS = (
    "field_goals_made",
    "field_goals_attempted",
    "three_pointers_made",
    "three_pointers_attempted",
    "free_throws_made",
    "free_throws_attempted",
    "offensive_rebounds",
    "defensive_rebounds",
    "rebounds",
    "assists",
    "turnovers",
    "steals",
    "blocks",
    "blocked_att",
    "personal_fouls",
    "fouls_drawn",
    "points",
    "plus_minus",
)
BOX_SCORE_RATIOS = ("field_goal_pct", "three_point_pct", "free_throw_pct")
LOAD_ORDER = (
    "teams",
    "players",
    "games",
    "shots",
    "player_game_logs",
    "team_game_logs",
    "play_by_play",
)

# --- fixed values: feature columns ---------------------------------------------------------
PLAYER_FORM_COLUMNS = (
    "player_recent_fg_pct_5",
    "player_recent_fg3_pct_5",
    "player_recent_fga_5",
    "player_recent_fg3a_5",
    "player_recent_minutes_5",
    "player_recent_points_5",
)
TEAM_FORM_COLUMNS = (
    "team_recent_off_eff_proxy_5",
    "team_recent_pace_proxy_5",
    "team_recent_fg_pct_5",
    "team_recent_three_point_rate_5",
    "team_recent_fga_5",
    "team_recent_points_5",
    "team_recent_turnovers_5",
)
OPPONENT_FORM_COLUMNS = (
    "opp_recent_points_allowed_5",
    "opp_recent_fg_pct_allowed_5",
    "opp_recent_three_point_rate_allowed_5",
    "opp_recent_pace_proxy_5",
    "opp_recent_fga_allowed_5",
)
FORM_COLUMNS = (*PLAYER_FORM_COLUMNS, *TEAM_FORM_COLUMNS, *OPPONENT_FORM_COLUMNS)
BASE_SHOT_COLUMNS = (
    "shot_id",
    "game_id",
    "game_event_id",
    "player_id",
    "team_id",
    "opponent_team_id",
    "season",
    "game_date",
    "shot_made_flag",
    "shot_value",
    "shot_distance",
    "loc_x",
    "loc_y",
    "abs_loc_x",
    "shot_angle",
    "is_corner_three",
    "is_home",
    "period",
    "seconds_remaining_period",
    "seconds_remaining_game",
    "shot_zone_basic",
    "shot_zone_area",
    "shot_zone_range",
)
MARGIN_COLUMNS = ("score_margin", "score_margin_missing")
GOLD_COLUMNS = (*BASE_SHOT_COLUMNS, *FORM_COLUMNS, *MARGIN_COLUMNS)
TARGET = "shot_made_flag"
TABULAR_FEATURES = (
    "shot_value",
    "shot_distance",
    "loc_x",
    "loc_y",
    "abs_loc_x",
    "shot_angle",
    "is_corner_three",
    "is_home",
    "period",
    "seconds_remaining_period",
    "seconds_remaining_game",
    *MARGIN_COLUMNS,
    *FORM_COLUMNS,
)
PREDICTION_CORE_COLUMNS = (
    "shot_id",
    "game_id",
    "player_id",
    "team_id",
    "shot_value",
    "shot_made_flag",
    "predicted_make_probability",
    "expected_shot_value",
    "actual_points",
    "points_above_expected",
)
PREDICTION_EXTRA_COLUMNS = (
    "game_date",
    "shot_zone_basic",
    "shot_zone_area",
    "shot_zone_range",
    "shot_distance",
)
ZONE_COLUMNS = ("shot_zone_basic", "shot_zone_area", "shot_zone_range")


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


_LONG, _TEXT, _REAL, _FLAG, _DATE = (
    T.LongType(),
    T.StringType(),
    T.DoubleType(),
    T.BooleanType(),
    T.DateType(),
)

_LOG_COUNTS = {name: _LONG for name in BOX_SCORE_COUNTS}
_LOG_RATIOS = {name: _REAL for name in BOX_SCORE_RATIOS}

TEAMS = _fields(
    team_id=_LONG,
    abbreviation=_TEXT,
    full_name=_TEXT,
    nickname=_TEXT,
    city=_TEXT,
    state=_TEXT,
    year_founded=_LONG,
)
PLAYERS = _fields(
    player_id=_LONG, full_name=_TEXT, first_name=_TEXT, last_name=_TEXT, is_active=_FLAG
)
GAMES = _fields(
    game_id=_TEXT,
    season=_TEXT,
    season_type=_TEXT,
    game_date=_DATE,
    home_team_id=_LONG,
    away_team_id=_LONG,
)
SHOTS = _fields(
    game_id=_TEXT,
    game_event_id=_LONG,
    player_id=_LONG,
    team_id=_LONG,
    period=_LONG,
    minutes_remaining=_LONG,
    seconds_remaining=_LONG,
    event_type=_TEXT,
    action_type=_TEXT,
    shot_type=_TEXT,
    shot_zone_basic=_TEXT,
    shot_zone_area=_TEXT,
    shot_zone_range=_TEXT,
    shot_distance=_LONG,
    loc_x=_LONG,
    loc_y=_LONG,
    shot_attempted_flag=_FLAG,
    shot_made_flag=_FLAG,
    game_date=_DATE,
    home_team_abbreviation=_TEXT,
    away_team_abbreviation=_TEXT,
)
TEAM_GAME_LOGS = _fields(
    season_year=_TEXT,
    game_id=_TEXT,
    team_id=_LONG,
    game_date=_DATE,
    matchup=_TEXT,
    win_loss=_TEXT,
    minutes=_REAL,
    **_LOG_COUNTS,
    **_LOG_RATIOS,
)
PLAYER_GAME_LOGS = T.StructType([*TEAM_GAME_LOGS.fields, T.StructField("player_id", _LONG)])
PLAY_BY_PLAY = _fields(
    game_id=_TEXT,
    action_number=_LONG,
    action_id=_LONG,
    game_clock=_TEXT,
    period=_LONG,
    team_id=_LONG,
    team_tricode=_TEXT,
    person_id=_LONG,
    player_name=_TEXT,
    x_legacy=_LONG,
    y_legacy=_LONG,
    shot_distance=_LONG,
    shot_result=_TEXT,
    is_field_goal=_FLAG,
    score_home=_LONG,
    score_away=_LONG,
    points_total=_LONG,
    court_location=_TEXT,
    description=_TEXT,
    action_type=_TEXT,
    sub_type=_TEXT,
    video_available=_FLAG,
)
GOLD = _fields(
    shot_id=_LONG,
    game_id=_TEXT,
    game_event_id=_LONG,
    player_id=_LONG,
    team_id=_LONG,
    opponent_team_id=_LONG,
    season=_TEXT,
    game_date=_DATE,
    shot_made_flag=_FLAG,
    shot_value=T.IntegerType(),
    shot_distance=_LONG,
    loc_x=_LONG,
    loc_y=_LONG,
    abs_loc_x=_LONG,
    shot_angle=_REAL,
    is_corner_three=_FLAG,
    is_home=_FLAG,
    period=_LONG,
    seconds_remaining_period=_REAL,
    seconds_remaining_game=_REAL,
    shot_zone_basic=_TEXT,
    shot_zone_area=_TEXT,
    shot_zone_range=_TEXT,
    **{name: _REAL for name in FORM_COLUMNS},
    score_margin=_LONG,
    score_margin_missing=_FLAG,
    feature_set_version=_TEXT,
)
PREDICTIONS = _fields(
    shot_id=_LONG,
    game_id=_TEXT,
    player_id=_LONG,
    team_id=_LONG,
    shot_value=T.IntegerType(),
    shot_made_flag=_FLAG,
    predicted_make_probability=_REAL,
    expected_shot_value=_REAL,
    actual_points=_REAL,
    points_above_expected=_REAL,
    game_date=_DATE,
    shot_zone_basic=_TEXT,
    shot_zone_area=_TEXT,
    shot_zone_range=_TEXT,
    shot_distance=_REAL,
)
MANIFEST = _fields(
    dataset=_TEXT,
    source=_TEXT,
    season=_TEXT,
    downloaded_at=T.TimestampType(),
    row_count=_LONG,
    csv_path=_TEXT,
    parquet_path=_TEXT,
)
RUN_METRICS = T.StructType(
    [
        T.StructField("auc", _REAL),
        T.StructField("log_loss", _REAL),
        T.StructField("brier_score", _REAL),
        T.StructField("accuracy", _REAL),
    ]
)
RUN_SUMMARY = T.StructType(
    [
        T.StructField("environment", _TEXT),
        T.StructField("model", _TEXT),
        T.StructField("mode", _TEXT),
        T.StructField("season", _TEXT),
        T.StructField("metrics", RUN_METRICS),
        T.StructField("best_config_index", _LONG),
        T.StructField("validation_log_loss", _REAL),
        T.StructField("validation_auc", _REAL),
        T.StructField("test_log_loss", _REAL),
        T.StructField("test_auc", _REAL),
    ]
)
IMPORTANCE = _fields(feature=_TEXT, importance=_REAL)

# Loaded tables that lie in one folder per season; the season is that of the row's game.
SEASON_TABLES = ("shots", "player_game_logs", "team_game_logs", "play_by_play")

NATURAL_KEYS = {
    "teams": ("team_id",),
    "players": ("player_id",),
    "games": ("game_id",),
    "shots": ("game_id", "game_event_id", "player_id"),
    "player_game_logs": ("game_id", "player_id"),
    "team_game_logs": ("game_id", "team_id"),
    "play_by_play": ("game_id", "action_number"),
}

# --- fixed values: season expectations -----------------------------------------------------
SEASON_ROW_COUNTS = {
    "2024-25": {
        "teams": ("exact", 30),
        "games": ("exact", 1230),
        "team_game_logs": ("exact", 2460),
        "shots": ("min", 200_000),
        "player_game_logs": ("min", 20_000),
        "play_by_play": ("min", 500_000),
        "players": ("min", 400),
    },
}
SEASON_DATES = {"2024-25": ("2024-10-01", "2025-06-30")}

# Column rules per table: (column, kind, allowed, nullable). Kinds: plain, isin, range, length.
SHOT_TYPES = ("2PT Field Goal", "3PT Field Goal")
_LOG_RULES = (
    ("season_year", "plain", None, False),
    ("game_id", "plain", None, False),
    ("team_id", "plain", None, False),
    ("game_date", "plain", None, False),
    ("matchup", "plain", None, False),
    ("win_loss", "isin", ("W", "L"), False),
)
COLUMN_RULES = {
    "shots": (
        ("game_id", "plain", None, False),
        ("game_event_id", "plain", None, False),
        ("player_id", "plain", None, False),
        ("team_id", "plain", None, False),
        ("shot_made_flag", "plain", None, False),
        ("shot_type", "isin", SHOT_TYPES, False),
        ("loc_x", "range", (-300, 300), True),
        ("loc_y", "range", (-100, 900), True),
        ("shot_distance", "range", (0, 100), True),
        ("game_date", "plain", None, False),
    ),
    "games": tuple((name, "plain", None, False) for name in GAMES.fieldNames()),
    "player_game_logs": (*_LOG_RULES, ("player_id", "plain", None, False)),
    "team_game_logs": _LOG_RULES,
    "play_by_play": (
        ("game_id", "plain", None, False),
        ("action_number", "plain", None, False),
        ("period", "plain", None, False),
        ("game_clock", "length", 1, False),
        ("team_id", "plain", None, True),
        ("person_id", "plain", None, True),
        ("player_name", "plain", None, True),
        ("description", "plain", None, True),
    ),
    "gold_shot_features": (
        *[
            (name, "plain", None, False)
            for name in (
                "shot_id",
                "game_id",
                "game_event_id",
                "player_id",
                "team_id",
                "opponent_team_id",
                "season",
                "game_date",
                "feature_set_version",
                "shot_made_flag",
                "is_home",
                "score_margin_missing",
            )
        ],
        ("shot_value", "isin", (2, 3), False),
    ),
}
# The other gold columns are declared too: each must be there, may be NULL, and has its type.
COLUMN_RULES["gold_shot_features"] += tuple(
    (name, "plain", None, True)
    for name in GOLD.fieldNames()
    if name not in {rule[0] for rule in COLUMN_RULES["gold_shot_features"]}
)
# Declared types that the contract of a table holds its columns to.
CONTRACT_TYPES = {
    "teams": TEAMS,
    "players": PLAYERS,
    "games": GAMES,
    "shots": SHOTS,
    "player_game_logs": PLAYER_GAME_LOGS,
    "team_game_logs": TEAM_GAME_LOGS,
    "play_by_play": PLAY_BY_PLAY,
    "gold_shot_features": GOLD,
}
GOLD_REQUIRED = (
    "shot_id",
    "shot_made_flag",
    "game_date",
    "team_id",
    "player_id",
    "opponent_team_id",
    "is_home",
)
