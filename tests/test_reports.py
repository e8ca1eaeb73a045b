import datetime as dt
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcline.functions.value import value_columns
from arcline.operators import edges as G
from arcline.operators import inspection as I
from arcline.operators import metrics as K
from arcline.operators import quality as Q
from arcline.operators import summaries as A

VALUED = "p double, v int, m boolean"


def test_expected_value_examples(frame):
    df = frame(VALUED, (0.40, 3, True), (0.40, 3, False), (0.55, 2, True), (0.5, 2, None))
    got = [r[0] for r in df.select(value_columns("p", "v", "m")["points_above_expected"]).collect()]
    assert [round(x, 9) for x in got[:3]] == [1.8, -1.2, 0.9] and got[3] is None


@pytest.mark.parametrize(("p", "v"), [(-0.01, 2), (1.01, 2), (0.5, 0), (0.5, 1), (0.5, 4), (0.5, -2)])
def test_domain_errors(frame, p, v):
    with pytest.raises(Exception, match="probability|shot value"):
        frame(VALUED, (p, v, True)).select(value_columns("p", "v", "m")["expected_shot_value"]).collect()


PREDICTIONS = (
    "shot_id long, game_id string, player_id long, team_id long, shot_value int, shot_made_flag boolean, "
    "predicted_make_probability double, expected_shot_value double, actual_points double, points_above_expected double, "
    "shot_zone_basic string, shot_zone_area string, shot_zone_range string, game_date string"
)


def _shot(i, player, value, made, p, zone, day):
    points = float(value) if made else 0.0
    return (i, "g", player, 1, value, made, p, p * value, points, points - p * value, zone, "a", "r", day)


@pytest.fixture
def predictions(frame):
    rows = frame(
        PREDICTIONS,
        _shot(1, 10, 3, True, 0.4, "z", "2025-01-05"),
        _shot(2, 10, 2, False, 0.5, "y", "2025-02-05"),
        _shot(3, 11, 2, True, 0.4, "z", "2025-01-09"),
    )
    return rows.withColumn("game_date", F.col("game_date").cast("date"))


def test_player_summary(predictions):
    got = A.summarize_players(predictions).where("player_id = 10").first()
    expected = {
        "attempts": 2, "made_shots": 1, "actual_fg_pct": 0.5, "expected_fg_pct": 0.45, "actual_points": 3.0,
        "expected_points": 2.2, "points_above_expected": 0.8, "points_above_expected_per_100_shots": 40.0,
        "avg_expected_shot_value": 1.1, "avg_shot_value": 2.5,
    }
    assert {k: round(got[k], 9) for k in expected} == expected


def test_month_and_zone_summaries(predictions):
    months = {(r["player_id"], r["game_month"]): r for r in A.summarize_player_months(predictions).collect()}
    assert len(months) == 3
    assert months[10, "2025-01"]["points_above_expected_per_100_shots"] == pytest.approx(180)
    assert months[10, "2025-02"]["points_above_expected_per_100_shots"] == pytest.approx(-100)
    zones = {r["shot_zone_basic"]: r for r in A.summarize_zones(predictions).collect()}
    assert (zones["z"]["attempts"], zones["z"]["made_shots"]) == (2, 2)
    assert zones["z"]["points_above_expected_per_100_shots"] == pytest.approx(150)
    with pytest.raises(KeyError):
        A.summarize_zones(predictions.drop("shot_zone_area"))


def test_summary_base_equals_direct(predictions, rows):
    base = A.summary_base(predictions)
    for keys in A.SUMMARY_KEYS.values():
        source = A.with_month(predictions)
        assert rows(A.summary_from_base(base, keys), *keys) == rows(A.summarize(source, keys), *keys)


def test_null_keys_are_left_out(predictions):
    mixed = predictions.withColumn("player_id", F.when(F.col("shot_id") < 3, F.col("player_id")))
    assert [r["player_id"] for r in A.summarize_players(mixed).collect()] == [10]


SUMMARY = "player_id long, attempts long, points_above_expected double, points_above_expected_per_100_shots double"


def test_thresholds_and_ties(frame):
    df = frame(SUMMARY, (1, 120, 5.0, 4.0), (2, 100, 5.0, 5.0), (3, 20, 50.0, 250.0), (4, 500, None, None))
    assert [r[0] for r in A.top_players_by_total(df, n=5).collect()] == [1, 2, 4]
    assert [r[0] for r in A.top_players_by_rate(df, n=1).collect()] == [2]


def test_month_changes_skip_small_months(frame):
    schema = "player_id long, game_month string, attempts long, points_above_expected_per_100_shots double"
    df = frame(schema, (1, "2025-01", 50, 1.0), (1, "2025-02", 10, 90.0), (1, "2025-03", 60, 4.0), (2, "2025-01", 99, 1.0))
    got = A.month_changes(df).collect()
    assert [(r["from_month"], r["to_month"], r["delta_per_100"], r["from_attempts"]) for r in got] == [("2025-01", "2025-03", 3.0, 50)]
    assert A.month_changes(df, minimum=1000).count() == 0


SHOTS = "row_id long, shot_value int, shot_distance double, period int, shot_made_flag boolean, predicted_make_probability double"


def test_bucket_summary_keeps_empty_buckets(frame):
    df = frame(SHOTS, (1, 2, 1.0, 1, True, 0.5), (2, 2, 3.0, 1, False, 0.5), (3, 3, 27.0, 1, True, 0.5))
    got = G.distance_bucket_summary(df).orderBy("bucket_rank").collect()
    assert len(got) == 7
    assert (got[0]["shot_count"], got[0]["make_rate"], got[0]["avg_shot_value"], got[0]["avg_expected_points_baseline"]) == (2, 0.5, 2.0, 1.0)
    assert (got[1]["shot_count"], got[1]["make_rate"]) == (0, 0.0)
    assert G.distance_bucket_summary(df.limit(0)).count() == 0


def test_filters_and_quality(frame):
    df = frame(SHOTS, (1, 2, 5.0, 1, True, 0.5), (2, 3, 25.0, 2, False, 0.5), (3, 3, 30.0, 4, True, 0.5))
    assert [r[0] for r in G.filter_shots(df, shot_value=3, periods=[2, 4], max_distance=25).collect()] == [2]
    assert G.filter_shots(df, periods=[]).count() == 0
    empty = G.quality_summary(df.where("row_id > 9")).first()
    assert tuple(empty) == (0, 0.0, 0.0, 0.0, 0.0)


def test_edges_and_backtest(frame):
    df = frame(SHOTS, (1, 2, 3.5, 1, True, 0.9), (2, 2, 4.0, 1, False, 0.3), (3, 3, None, 1, None, 0.2))
    edges = {r["row_id"]: r for r in G.edge_table(df).collect()}
    assert (edges[1]["similar_shot_count"], edges[1]["baseline_make_rate"]) == (2, 0.5)
    assert edges[1]["ev_edge_vs_baseline"] == pytest.approx(0.8)
    assert (edges[3]["similar_shot_count"], edges[3]["baseline_make_rate"], edges[3]["actual_points"]) == (0, 0.0, None)
    alone = {r["row_id"]: r for r in G.edge_table(df, leave_one_out=True).collect()}
    assert (alone[1]["similar_shot_count"], alone[1]["baseline_make_rate"]) == (1, 0.0)
    report = G.edge_backtest(G.edge_table(df)).orderBy("bucket_rank").collect()
    assert [r["shot_count"] for r in report] == [1, 0, 0, 2]
    assert report[3]["actual_make_rate"] == 1.0 and report[3]["avg_actual_points"] == 2.0
    assert G.backtest_verdict(G.edge_backtest(G.edge_table(df))).first()["verdict"] == "expected direction"
    assert G.edge_backtest(G.edge_table(df).limit(0)).count() == 0
    assert [r["row_id"] for r in G.rank_edges(G.edge_table(df), n=1).collect()] == [1]
    with pytest.raises(ValueError):
        G.rank_edges(G.edge_table(df), "period")


def test_samples_are_repeatable(spark):
    ids = spark.range(1000).withColumnRenamed("id", "row_id")
    first = [r[0] for r in G.sample_rows(ids, "row_id", 20).collect()]
    again = [r[0] for r in G.sample_rows(ids.repartition(7), "row_id", 20).collect()]
    assert first == again and len(set(first)) == 20
    assert first != [r[0] for r in G.sample_rows(ids, "row_id", 20, seed=1).collect()]


def test_importance_top(frame):
    df = frame("feature string, importance double", ("a", 1.0), ("b", 3.0), ("c", 2.0))
    assert [r[0] for r in G.top_importance(df, 2).collect()] == ["b", "c"]
    assert G.top_importance(df, 0).count() == 0


def test_metrics_by_hand(frame):
    df = frame("s double, y boolean", (0.9, True), (0.6, False), (0.6, True), (0.2, False))
    got = K.classification_metrics(df, "s", "y").first()
    assert got["auc"] == pytest.approx(3.5 / 4) and got["accuracy"] == 0.75
    assert got["brier_score"] == pytest.approx((0.01 + 0.36 + 0.16 + 0.04) / 4)
    assert got["log_loss"] == pytest.approx(-(2 * math.log(0.6) + math.log(0.9) + math.log(0.8) + math.log(0.4) - math.log(0.6)) / 4)
    certain = K.classification_metrics(frame("s double, y boolean", (1.0, True), (0.0, True)), "s", "y").first()
    assert certain["auc"] is None and certain["log_loss"] == pytest.approx(-math.log(K.EPSILON) / 2)


def test_calibration_and_histogram(spark):
    df = spark.range(1000).select((F.col("id") / 1000).alias("s"), (F.col("id") % 4 == 0).alias("y"))
    got = K.calibration_table(df, "s", "y").orderBy("bin").collect()
    assert [r["shot_count"] for r in got] == [100] * 10
    tied = df.withColumn("s", F.when(F.col("s") < 0.5, 0.1).otherwise(F.col("s")))
    assert K.calibration_table(tied, "s", "y").count() < 10
    bars = K.score_histogram(df, "s", 50).collect()
    assert sum(r["shot_count"] for r in bars) == 1000 and max(r["bin"] for r in bars) == 50
    assert K.score_histogram(df.withColumn("s", F.lit(0.3)), "s").collect()[0]["shot_count"] == 1000


GAMES = "game_id string, season string, season_type string, game_date date, home_team_id long, away_team_id long"


def test_quality_report(frame, rows):
    import datetime as dt

    good = ("0000000001", "2023-24", "R", dt.date(2024, 1, 1), 1, 2)
    bad = ("0000000001", "2023-24", None, None, 3, 3)
    teams = frame("team_id long, abbreviation string, full_name string", (1, "AAA", "A"), (2, "BBBB", " "))
    report = Q.check_table("games", frame(GAMES, good, bad), season="2023-24", tables={"teams": teams})
    found = {(r["check"], r["count"]) for r in report.collect()}
    assert found == {
        ("contract_not_null", 1), ("missing_game_date", 1), ("home_equals_away", 1),
        ("duplicate_natural_key", 1), ("orphan_home_team_id", 1), ("orphan_away_team_id", 1),
    }
    team_report = {(r["check"], r["count"]) for r in Q.check_table("teams", teams, season="2023-24").collect()}
    assert team_report == {("abbreviation_length", 1), ("missing_full_name", 1)}
    with pytest.raises(Q.QualityError, match=r"7 critical issue|critical issue\(s\)"):
        Q.raise_if_critical(report)
    Q.raise_if_critical(Q.check_table("games", frame(GAMES, good), season="2023-24"))
    exact = Q.check_table("games", frame(GAMES, good), season="2024-25").collect()
    assert {r["check"] for r in exact} == {"row_count_exact", "date_range"}


def test_empty_table_and_absent_columns(spark, frame):
    empty = Q.check_rows(frame("a long", (1,)).limit(0), "t", [])
    assert [r["check"] for r in empty.collect()] == ["empty"]
    df = frame("a string", ("x",), (" ",), (None,))
    report = Q.check_rows(df, "t", Q.required_rules(df, ("a", "b")))
    assert {(r["check"], r["count"]) for r in report.collect()} == {("missing_a", 2), ("missing_b", 3)}
    with pytest.raises(KeyError):
        Q.require_columns(df, ("b",))


def test_gold_inspection(frame):
    gold = frame(
        "shot_id long, game_id string, team_id long, opponent_team_id long, shot_value int, shot_made_flag boolean, is_home boolean",
        (1, "g", 1, 2, 2, True, True), (1, "g", 2, None, 5, None, True),
    )
    games = frame("game_id string, home_team_id long, away_team_id long", ("g", 1, 2))
    got = I.inspect_gold(gold, frame("game_id string", "g", "g", "other"), games).first().asDict()
    assert got == {
        "shots_row_count": 2, "gold_row_count": 2, "duplicate_shot_ids": 1, "invalid_shot_value_rows": 1,
        "missing_shot_made_flag": 1, "missing_opponent_team_id": 1, "is_home_mismatches": 1, "row_count_delta": 0, "passed": False,
    }
    fine = I.inspect_gold(gold.limit(1), frame("game_id string", "g"), games).first()
    assert fine["passed"]


def test_typed_rows_reject_what_cannot_be_read(spark, frame):
    schema = T.StructType.fromDDL("a bigint not null, b date, c double, d boolean, e bigint")
    df = frame(
        "a string, b string, c string, d string, e double, other string",
        ("1", "2024-01-31", "1.5", "true", 2.0, "x"),
        ("2.0", None, None, "0", None, "x"),
        ("2.5", "2024-02-30", "one", "maybe", 2.5, "x"),
        (None, "", "", "", float("nan"), "x"),
        ("9007199254740993", None, None, None, 1e300, None),
    )
    good, rejected = Q.typed_rows(df, schema)
    assert good.schema.simpleString() == "struct<a:bigint,b:date,c:double,d:boolean,e:bigint>"
    assert [tuple(r) for r in good.orderBy("a").collect()] == [
        (1, dt.date(2024, 1, 31), 1.5, True, 2),
        (2, None, None, False, None),
    ]
    found = {r["a"]: sorted(r["reasons"]) for r in rejected.collect()}
    assert found == {
        "2.5": ["a: not bigint", "b: not date", "c: not double", "d: not boolean", "e: not bigint"],
        None: ["a: missing", "b: not date", "c: not double", "d: not boolean", "e: not bigint"],
        "9007199254740993": ["e: not bigint"],
    }
    counts = {(r["column"], r["problem"]): r["count"] for r in Q.reason_counts(rejected).collect()}
    assert counts["e", "not bigint"] == 3 and counts["a", "missing"] == 1 and len(counts) == 6
    with pytest.raises(KeyError, match="b"):
        Q.typed_rows(df.drop("b"), schema)
    empty, none = Q.typed_rows(df.limit(0), schema)
    assert empty.count() == none.count() == 0


def test_type_rules_judge_values_as_declared(frame):
    df = frame("day date, n array<int>, v int", (None, [1], 2), (None, None, 3))
    schema = T.StructType.fromDDL("day date, n bigint, v bigint, gone string")
    found = {(r["check"], r["count"]) for r in Q.check_rows(df, "t", Q.contract_rules(df, (("v", "isin", (2,), False),), schema)).collect()}
    assert found == {("contract_isin", 1), ("contract_type", 1)}
