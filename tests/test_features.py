import math

import pytest
from pyspark.sql import functions as F

from arcline.functions import shots as X
from arcline.functions.spatial import SPATIAL_COLUMNS, spatial_encodings
from arcline.operators import form as R
from arcline.operators.margin import attach_margin, without_margin
from arcline.operators.models import feature_columns
from arcline.operators.split import split_overlap, split_summary, time_split
from arcline.session import joins_within_keys, written_once

SHOT = "game_id string, game_event_id long, is_home boolean"
SCORES = "game_id string, action_number long, score_home long, score_away long"


@pytest.mark.parametrize(
    ("scores", "shot", "expected"),
    [
        ([("1", 9, 50, 48), ("1", 10, 53, 48)], ("1", 10, True), (2, False)),
        ([("1", 19, 60, 55), ("1", 20, 60, 58)], ("1", 20, False), (-5, False)),
        ([("1", 10, 1, 0)], ("1", 999, True), (None, True)),
        ([("1", 1, 0, 0)], ("1", 1, True), (0, False)),
        ([("1", 1, 5, None), ("1", 2, None, None), ("1", 3, 9, 9)], ("1", 3, True), (5, False)),
    ],
)
def test_margin_before_the_shot(frame, scores, shot, expected):
    got = attach_margin(frame(SHOT, shot), frame(SCORES, *scores)).first()
    assert (got["score_margin"], got["score_margin_missing"]) == expected


def test_margin_columns_without_events(frame):
    got = without_margin(frame(SHOT, ("1", 1, True))).first()
    assert (got["score_margin"], got["score_margin_missing"]) == (None, True)


def test_shot_expressions(frame):
    df = frame(
        "zone string, type string, x long, y long, p int, m int, s int",
        ("Left Corner 3", "3PT Field Goal", 0, 0, 1, 11, 30),
        (None, "3PT Field Goal", -220, 92, 4, 0, 5),
        (None, "2PT Field Goal", -230, 10, 5, 2, 0),
        (None, "3PT Field Goal", None, 10, 5, 2, 0),
    )
    got = df.select(
        X.corner_three("zone", "type", "x", "y"),
        X.attempt_value("type"),
        X.game_clock("p", X.period_clock("m", "s")),
    ).collect()
    assert [tuple(r) for r in got] == [
        (True, 3, 3 * 720 + 690.0),
        (True, 3, 5.0),
        (False, 2, 120.0),
        (False, 3, 120.0),
    ]


def test_buckets(frame):
    feet = frame("d double", 2.0, 7.0, 31.0, 5.0, -1.0, None, float("nan"))
    got = [r[0] for r in feet.select(X.distance_bucket("d")).collect()]
    assert got == ["0-5 ft", "5-10 ft", "30+ ft", "5-10 ft", None, None, None]
    edges = frame("e double", -0.2, -0.1, -0.05, 0.0, 0.05, 0.1, 0.15)
    ranks = [r[0] for r in edges.select(X.edge_rank("e")).collect()]
    assert ranks == [0, 0, 1, 1, 2, 3, 3]


def test_spatial_landmarks(frame):
    df = frame("loc_x double, loc_y double, shot_distance double, shot_angle double",
               (0.0, 0.0, 0.0, 0.0), (-220.0, 92.5, 23.0, 1.0), (None, 1.0, 1.0, 1.0))
    got = df.select(*[c.alias(k) for k, c in spatial_encodings().items()]).collect()
    assert tuple(spatial_encodings()) == SPATIAL_COLUMNS and len(SPATIAL_COLUMNS) == 18
    rim, corner, unknown = got
    assert (rim["sin_shot_angle"], rim["cos_shot_angle"], rim["is_center"], rim["dist_to_rim"]) == (0, 1, 1, 0)
    assert (corner["is_left_side"], corner["dist_to_left_corner"]) == (1, 0)
    assert (unknown["is_left_side"], unknown["is_center"], unknown["dist_to_rim"]) == (0, 0, None)
    assert math.isclose(corner["loc_x_scaled"], -220 / 300)


def test_feature_sets():
    assert [len(feature_columns(s)) for s in ("tabular", "spatial", "pressure")] == [31, 49, 62]
    with pytest.raises(ValueError):
        feature_columns("other")


LOGS = (
    "game_id long, player_id long, team_id long, game_date int, field_goals_made long, field_goals_attempted long, "
    "three_pointers_made long, three_pointers_attempted long, free_throws_attempted long, "
    "offensive_rebounds long, turnovers long, points long, minutes double"
)


def _log(game, player, team, fgm, fga, points, minutes=30.0):
    return (game, player, team, game, fgm, fga, 1, 2, 4, 1, 3, points, minutes)


def test_form_excludes_the_current_game(frame):
    logs = frame(LOGS, *[_log(g, 1, 1, g, 10, 2 * g) for g in range(1, 9)])
    got = {r["game_id"]: r for r in R.player_form(logs).collect()}
    assert got[1]["player_recent_fg_pct_5"] is None and got[1]["player_recent_points_5"] is None
    assert got[2]["player_recent_fg_pct_5"] == 0.1
    assert math.isclose(got[8]["player_recent_fg_pct_5"], (3 + 4 + 5 + 6 + 7) / 50)
    assert got[8]["player_recent_points_5"] == 2 * 5


def test_form_ratio_is_null_without_attempts_and_first_row_wins(frame):
    logs = frame(LOGS, _log(1, 1, 1, 0, 0, 0), _log(2, 1, 1, 1, 1, 2), _log(2, 1, 1, 1, 1, 2))
    got = R.player_form(logs).collect()
    assert sorted(r["game_id"] for r in got) == [1, 2]
    assert [r["player_recent_fg_pct_5"] for r in got if r["game_id"] == 2] == [None]


def test_opponent_form_is_the_other_side(frame):
    logs = frame(
        LOGS,
        _log(1, 0, 1, 5, 10, 20), _log(1, 0, 2, 6, 12, 30),
        _log(2, 0, 1, 5, 10, 22), _log(2, 0, 2, 6, 12, 33), _log(3, 0, 9, 1, 1, 1),
    )
    allowed = {(r["game_id"], r["team_id"]): r["points"] for r in R.opponent_allowed(logs).collect()}
    assert allowed == {(1, 1): 30, (1, 2): 20, (2, 1): 33, (2, 2): 22}
    form = {(r["game_id"], r["team_id"]): r for r in R.opponent_form(logs).collect()}
    assert form[2, 1]["opp_recent_points_allowed_5"] == 30 and form[2, 1]["opp_recent_fg_pct_allowed_5"] == 0.5
    assert math.isclose(form[2, 1]["opp_recent_pace_proxy_5"], 12 + 0.44 * 4 + 3 - 1)


def test_repeated_right_key_fails(spark, frame):
    shots = frame("game_id long, player_id long", (1, 1))
    form = frame("game_id long, player_id long, v double", (1, 1, 0.5), (1, 1, 0.6))
    keys = {"game_id": "game_id", "player_id": "player_id"}
    with pytest.raises(Exception, match="repeated key"):
        R.attach_form(shots, form, keys, check_unique=True).collect()


SPLIT = "shot_id long, game_id long, game_date date"


def _games(spark, count):
    return spark.range(2 * count).select(
        F.col("id").alias("shot_id"),
        F.floor(F.col("id") / 2).alias("game_id"),
        F.date_add(F.lit("2024-10-01").cast("date"), F.floor(F.col("id") / 2).cast("int")).alias("game_date"),
    )


@pytest.mark.parametrize(("count", "train"), [(10, 8), (1, 1), (2, 1), (3, 2)])
@pytest.mark.parametrize("by_day", [True, False])
def test_time_split_sizes(spark, count, train, by_day):
    labelled = time_split(_games(spark, count), one_date_per_game=by_day)
    sizes = {r["split"]: (r["games"], r["shot_rows"]) for r in split_summary(labelled).collect()}
    assert sizes["train"] == (train, 2 * train)
    assert sum(rows for _, rows in sizes.values()) == 2 * count
    assert split_overlap(labelled).first()[0] == 0


def test_time_split_inside_one_day_with_text_ids(spark):
    games = spark.range(100).select(
        F.lpad(F.col("id").cast("string"), 10, "0").alias("game_id"), F.lit("2024-10-01").cast("date").alias("game_date")
    )
    train = time_split(games, 0.8).where("split = 'train'")
    assert train.count() == 80 and train.agg(F.max("game_id")).first()[0] == "0000000079"


def test_time_split_keeps_a_two_day_game_together(frame):
    import datetime as dt

    day = dt.date(2024, 10, 1)
    rows = [(i, i // 2, day + dt.timedelta(days=i)) for i in range(10)]
    assert split_overlap(time_split(frame(SPLIT, *rows), 0.5)).first()[0] == 0


def test_time_split_rejects_bad_fraction(spark):
    with pytest.raises(ValueError):
        time_split(_games(spark, 2), 1.0)


def test_opponent_allowed_deals_rows_once(spark):
    """Game totals less the own rows come from windows of the game, in one exchange and no join."""
    measures = [f"cast(id % 7 as bigint) as {c}" for c in R.ALLOWED_MEASURES]
    logs = spark.range(60).selectExpr("id div 4 as game_id", "id % 3 as team_id", "date'2024-01-01' as game_date", *measures)
    allowed = R.opponent_allowed(logs.repartition(3))
    plan = allowed._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    rows = logs.collect()
    for got in allowed.collect():
        others = [r for r in rows if r["game_id"] == got["game_id"] and r["team_id"] != got["team_id"]]
        assert got["points"] == sum(r["points"] for r in others)


def test_shots_dealt_by_game_stay_for_a_join_by_game_and_team(spark):
    shots = spark.range(400).selectExpr("id % 40 as game_id", "id % 3 as team_id", "id as shot_id").repartition(300, "game_id")
    games = spark.range(40).selectExpr("id as game_id", "id * 2 as season").repartition(300, "game_id")
    form = spark.range(120).selectExpr("id % 40 as game_id", "id div 40 as team_id", "id * 1.0 as form")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joins_within_keys(spark)
        joined = R.attach_form(shots.join(games, "game_id"), form, {"game_id": "game_id", "team_id": "team_id"})
        plan = joined._jdf.queryExecution().executedPlan().toString()
        found = {r["shot_id"]: r["form"] for r in joined.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(game_id" in line]
    assert sum("team_id" in line for line in moved) == 1  # to check the form's keys
    assert sum(", 300)" in line for line in moved) == 3  # shots, games, and the form to where they are
    assert all(found[i] == float(i % 3 * 40 + i % 40) for i in range(400))


def test_rows_written_once_are_read_back(spark):
    rows = spark.range(50).selectExpr("id", "if(id % 7 = 0, null, id / 3) as v", "date'2024-01-01' as d")
    kept = written_once(rows, "test")
    assert "Range" not in kept._jdf.queryExecution().executedPlan().toString()
    assert kept.schema.simpleString() == rows.schema.simpleString() and sorted(kept.collect()) == sorted(rows.collect())
