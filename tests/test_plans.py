"""Sources, sinks and whole jobs on a small hand-made season."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from arcline import schemas as S
from arcline.operators import models as M
from arcline.operators.quality import QualityError
from arcline.plans import evaluate, gold, tables, training
from arcline.sources import sinks
from arcline.sources import tables as read
from arcline.sources.layout import Layout

SEASON = "2023-24"
TEAMS = [(1, "AAA", "Team A"), (2, "BBB", "Team B"), (3, "CCC", "Team C")]


def raw_season(spark):
    shots, players, teams, events = [], [], [], []
    for g in range(1, 31):
        day = (dt.date(2023, 11, 1) + dt.timedelta(days=g)).isoformat()
        home, away = 1 + g % 3, 1 + (g + 1) % 3
        code = {i: c for i, c, _ in TEAMS}
        for team, text in ((home, f"{code[home]} vs. {code[away]}"), (away, f"{code[away]} @ {code[home]}")):
            box = (str(g), str(team), day, text, "W" if team == home else "L", "240", str(30 + g % 7), "80.0", "9", "30", "20", "8", "12", str(90 + g))
            teams.append((SEASON, *box, code[team]))
            for p in (1, 2):
                player = 10 * team + p
                players.append((SEASON, *box, str(player), f"First{player} Last"))
                for k in range(6):
                    number = 1 + 20 * (team == away) + 3 * k + p
                    made = (g * 7 + k * 3 + player) % 5 < 2 + (k < 2)
                    shots.append((
                        str(g), str(number), str(player), f"First{player} Last", str(team), str(1 + k % 4), str(11 - k), "30",
                        "3PT Field Goal" if k >= 4 else "2PT Field Goal", "Mid-Range" if k < 4 else "Above the Break 3",
                        "Center(C)", "8-16 ft.", str(2 + 5 * k), str(-200 + 80 * k), str(10 * k), "1", str(int(made)), day.replace("-", ""), code[home], code[away],
                    ))
        for n in range(1, 45):
            scored = n % 6 == 0
            events.append((
                str(g), str(n), str(n), "PT%02dM%02d.00S" % (11 - n % 11, n % 60), str(1 + n % 4), str(home if n % 2 else 0), str(10 * home + 1), "nan",
                str(n // 6 * 2) if scored else None, str(n // 9) if scored else None, "1" if scored else "0", "Made" if scored else None,
                "Made Shot" if scored else "Rebound", None if scored else "Defensive", "text",
            ))
    log = "SEASON_YEAR string, GAME_ID string, TEAM_ID string, GAME_DATE string, MATCHUP string, WL string, MIN string, FGM string, FGA string, FG3M string, FG3A string, FTA string, OREB string, TOV string, PTS string"
    return {
        "shot_chart": spark.createDataFrame(shots, "GAME_ID string, GAME_EVENT_ID string, PLAYER_ID string, PLAYER_NAME string, TEAM_ID string, PERIOD string, MINUTES_REMAINING string, SECONDS_REMAINING string, SHOT_TYPE string, SHOT_ZONE_BASIC string, SHOT_ZONE_AREA string, SHOT_ZONE_RANGE string, SHOT_DISTANCE string, LOC_X string, LOC_Y string, SHOT_ATTEMPTED_FLAG string, SHOT_MADE_FLAG string, GAME_DATE string, HTM string, VTM string"),
        "player_game_logs": spark.createDataFrame(players, log + ", PLAYER_ID string, PLAYER_NAME string"),
        "team_game_logs": spark.createDataFrame(teams, log + ", TEAM_ABBREVIATION string"),
        "play_by_play": spark.createDataFrame(events, "gameId string, actionNumber string, actionId string, clock string, period string, teamId string, personId string, playerName string, scoreHome string, scoreAway string, isFieldGoal string, shotResult string, actionType string, subType string, description string"),
    }


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    layout = Layout(str(tmp_path_factory.mktemp("season")))
    for name, df in raw_season(spark).items():
        sinks.write_twin(df.coalesce(1), layout, name, SEASON)
    teams = spark.createDataFrame(TEAMS, "id long, abbreviation string, full_name string")
    written = tables.load_season(spark, layout, SEASON, teams)
    return layout, written


@pytest.fixture(scope="module")
def scored(spark, loaded):
    layout, _ = loaded
    inspection = gold.build_gold(spark, layout, SEASON).first()
    split = {r["split"]: r for r in gold.export_splits(spark, layout, SEASON).collect()}
    record = training.train_model(spark, layout, SEASON, kind="logistic", max_iter=5).first()
    predictions = evaluate.predict_split(spark, layout, SEASON)
    return inspection, split, record, predictions


def test_load_season(loaded):
    _, written = loaded
    counts = {name: df.count() for name, df in written.items()}
    assert counts == {
        "teams": 3, "players": 6, "games": 30, "shots": 720, "player_game_logs": 120, "team_game_logs": 60, "play_by_play": 1320,
    }
    shots = written["shots"]
    assert shots.agg(F.min("shot_id"), F.max("shot_id"), F.countDistinct("shot_id")).first()[:3] == (1, 720, 720)
    first = written["games"].where("game_id = '0000000001'").first()
    assert (first["home_team_id"], first["away_team_id"], first["season"]) == (2, 3, SEASON)
    assert written["play_by_play"].where("team_id is null").count() > 0


def test_missing_raw_dataset(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="shot_chart"):
        read.read_raw(spark, Layout(str(tmp_path)), SEASON)


def test_gold_and_split(spark, loaded, scored):
    layout, _ = loaded
    inspection, split, _, _ = scored
    assert inspection["passed"] and inspection["gold_row_count"] == 720
    assert (split["train"]["games"], split["test"]["games"]) == (24, 6)
    rows = read.read_gold(spark, layout, season=SEASON, version="base_v1")
    assert rows.columns == list(S.GOLD_COLUMNS)
    assert rows.where("score_margin_missing").count() == 0
    assert rows.where("player_recent_fg_pct_5 is null").select("game_id").distinct().count() <= 3


def test_pressure_model_round_trip(spark, loaded, scored):
    layout, _ = loaded
    training.train_model(spark, layout, SEASON, kind="logistic", feature_set="pressure", max_iter=3, version="9", alias="pressed")
    found = evaluate.predict_split(spark, layout, SEASON, model="pressed", feature_set="pressure")
    split = read.read_split(spark, layout, SEASON, "test")
    assert found.count() == split.count() and found.where("predicted_make_probability not between 0 and 1").count() == 0


def test_append_keeps_keys_and_ids_unique(spark, loaded, tmp_path):
    layout, written = loaded
    copy = Layout(str(tmp_path))
    staged = {name: df for name, df in written.items()}
    sinks.load_tables(staged, copy)
    again = tables.new_rows(spark, copy, "shots", staged["shots"])
    assert again.count() == 0
    later = staged["shots"].withColumn("game_id", F.concat(F.lit("1"), F.substring("game_id", 2, 9)))
    ids = tables.new_rows(spark, copy, "shots", later).agg(F.min("shot_id"), F.countDistinct("shot_id")).first()
    assert tuple(ids) == (721, 720)


def test_gold_slice_is_replaced_not_appended(spark, loaded, scored):
    layout, _ = loaded
    other = spark.read.parquet(layout.gold).limit(5).withColumn("feature_set_version", F.lit("v2"))
    sinks.write_gold(other, layout)
    sinks.write_gold(spark.read.parquet(layout.gold).where("feature_set_version = 'v2'").limit(3).coalesce(1), layout)
    counts = {r["feature_set_version"]: r["count"] for r in spark.read.parquet(layout.gold).groupBy("feature_set_version").count().collect()}
    assert counts == {"base_v1": 720, "v2": 3}


def test_predictions_and_summaries(spark, loaded, scored):
    layout, _ = loaded
    _, _, record, predictions = scored
    assert record["metrics"]["auc"] is not None and record["mode"] == "default"
    assert predictions.count() == 144
    assert predictions.columns[:10] == list(S.PREDICTION_CORE_COLUMNS)
    summaries = evaluate.run_summaries(spark, layout, SEASON)
    assert summaries["players"].agg(F.sum("attempts")).first()[0] == 144
    names = read.player_names(spark, layout.raw_season("player_game_logs", SEASON))
    found = evaluate.build_findings(spark, layout, SEASON, player_names=names, min_players=10, min_zones=10, min_months=5)
    assert {"top players by total", "best zones", "evaluation volume"} <= {r["finding"] for r in found.collect()}
    assert found.where("subject like 'First%'").count() > 0
    edges, backtest = evaluate.edge_report(predictions)
    assert edges.count() == 144 and backtest.agg(F.sum("shot_count")).first()[0] == 144


def test_sequences_cover_the_season(spark, loaded, scored):
    layout, _ = loaded
    sequences = evaluate.build_season_sequences(spark, layout, SEASON)
    shots = read.read_gold(spark, layout, season=SEASON, version="base_v1")
    ready = evaluate.checked_sequences(shots, sequences)
    assert ready.count() == 720 and {"seq", "late_clock_proxy"} <= set(ready.columns)
    with pytest.raises(QualityError, match="cover"):
        evaluate.checked_sequences(shots, sequences.where("shot_id > 5"))


def test_trees_search_and_challenger(spark, loaded, scored):
    layout, _ = loaded
    train, test, features = training.split_frames(spark, layout, SEASON, "tabular")
    configs = [{"num_leaves": 3, "n_estimators": 2, "min_child_samples": 5}, {"num_leaves": 7, "n_estimators": 2, "min_child_samples": 5}]
    record = training.train_model(spark, layout, SEASON, mode="search", version="s1", alias="searched", configs=configs).first()
    assert record["best_config_index"] in (0, 1) and record["test_auc"] is not None
    model = M.load_model(spark, layout.aliases, "searched")
    assert 0 <= M.score(model, test).agg(F.max(M.PROBABILITY)).first()[0] <= 1
    importance = read.read_importance(spark, f"{layout.importance}/s1")
    assert importance.count() == 31
    holed = test.withColumn("loc_x", F.when(F.col("shot_id") % 2 == 0, F.col("loc_x")))
    good, bad = M.score_with_errors(model, holed, ["loc_x"], "shot_id")
    assert good.count() + bad.count() == 144 and bad.first()["reason"] == "missing: loc_x"
    with pytest.raises(KeyError):
        M.load_model(spark, layout.aliases, "nobody")
    good_runs, _ = read.read_run_summaries(spark, layout.runs)
    assert {r["mode"] for r in good_runs.collect()} >= {"search"}
    assert train.columns[-1] == S.TARGET and features == list(S.TABULAR_FEATURES)


def test_exact_medians(frame):
    df = frame("a double, b double", (1.0, None), (2.0, None), (3.0, None), (10.0, None))
    assert M.column_medians(df, ["a", "b"], exact=True) == {"a": 2.5, "b": 0.0}


def test_manifest_upsert(spark, tmp_path):
    layout = Layout(str(tmp_path))
    assert sinks.current_manifest(spark, layout).count() == 0
    at = dt.datetime(2025, 1, 1)
    for days, count in ((0, 5), (2, 7), (1, 6)):
        entry = [("shot_chart", "api", SEASON, at + dt.timedelta(days=days), count, "c", "p"), (None, "PlayByPlayV3", SEASON, at, 1, "c", "p")]
        sinks.upsert_manifest(layout, spark.createDataFrame(entry, S.MANIFEST))
    got = {r["dataset"]: r["row_count"] for r in sinks.current_manifest(spark, layout).collect()}
    assert got == {"shot_chart": 7, "play_by_play": 1}


def test_append_skips_empty(spark, tmp_path, frame):
    layout = Layout(str(tmp_path))
    df = frame("a long", (1,))
    assert not sinks.append_table(df.limit(0), layout, "t")
    assert sinks.append_table(df, layout, "t") and sinks.append_table(df, layout, "t")
    assert spark.read.parquet(layout.table("t")).count() == 2


def test_predictions_csv(spark, tmp_path, frame):
    columns = ", ".join(f"{c} string" for c in S.PREDICTION_CORE_COLUMNS)
    df = frame(columns + ", extra string, game_date string",
               ("1", "g", "2", "3", "2", "True", "0.5", "1.0", "2.0", "1.0", "x", "2025-01-01"))
    path = sinks.write_frame(df, str(tmp_path / "p"), kind="csv")
    got = read.read_predictions_csv(spark, path).first()
    assert got["shot_made_flag"] is True and got["game_date"] == dt.date(2025, 1, 1) and "extra" not in got
    sinks.write_frame(df.drop("team_id"), path, kind="csv")
    with pytest.raises(KeyError, match="team_id"):
        read.read_predictions_csv(spark, path)


def test_run_summaries_are_checked(spark, tmp_path):
    head = {"environment": "e", "model": "m", "season": SEASON}
    metrics = {"auc": 0.6, "log_loss": 0.6, "brier_score": 0.2, "accuracy": 0.6}
    bodies = {
        "ok": {**head, "mode": "default", "metrics": metrics},
        "search": {**head, "mode": "search", "test_auc": 0.7, "test_log_loss": 0.5, "best_config_index": 3},
        "nometric": {**head, "mode": "default", "metrics": {"auc": 0.6}},
        "nomode": head,
        "odd": {**head, "mode": "other"},
        "notest": {**head, "mode": "search", "test_auc": 0.7},
    }
    for name, body in bodies.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=1))
    (tmp_path / "broken.json").write_text("{")
    good, bad = read.read_run_summaries(spark, str(tmp_path))
    assert {(r["mode"], r["auc"]) for r in good.collect()} == {("default", 0.6), ("search", 0.7)}
    reasons = {r["source_file"].rsplit("/", 1)[1]: r["reason"] for r in bad.collect()}
    assert reasons == {
        "nometric.json": "missing metric: log_loss, brier_score, accuracy",
        "nomode.json": "missing required field: mode",
        "odd.json": "unsupported mode: other",
        "notest.json": "missing search field: test_log_loss",
        "broken.json": "malformed JSON",
    }


def test_read_importance_errors(spark, tmp_path, frame):
    df = frame("feature string, importance double", ("a", 1.0), ("b", 2.0))
    path = sinks.write_frame(df, str(tmp_path / "i"), kind="csv")
    assert [r[0] for r in read.read_importance(spark, path).collect()] == ["b", "a"]
    sinks.write_frame(df.drop("importance"), path, kind="csv")
    with pytest.raises(KeyError):
        read.read_importance(spark, path)


def test_nan_becomes_null(spark, frame):
    got = read.nan_to_null(frame("a double", float("nan"), 1.0)).collect()
    assert [r[0] for r in got] == [None, 1.0]


def test_layout_rejects_unknown_names():
    layout = Layout("/x")
    assert layout.split(SEASON, "train") == f"/x/features/season={SEASON}/split=train"
    for call in (lambda: layout.raw("other"), lambda: layout.summary(SEASON, "other")):
        with pytest.raises(ValueError):
            call()


def test_challenger_is_saved_promoted_and_scored_by_the_job(spark, loaded, scored):
    layout, _ = loaded
    training.train_model(spark, layout, SEASON, kind="challenger", version="c1", alias="challenger", hidden=(4,), epochs=2, steps=2)
    train, test, features = training.split_frames(spark, layout, SEASON, "sequence")
    assert len(features) == 62 and "seq" in train.columns
    model = M.load_model(spark, layout.aliases, "challenger")
    assert isinstance(model, M.Challenger) and model.network.features == [*features, *M.EVENT_INPUTS] and len(M.EVENT_INPUTS) == 145
    again = M.load_model(spark, layout.aliases, "challenger")
    wanted = {r["shot_id"]: r[M.PROBABILITY] for r in M.score(again, test).collect()}
    found = {r["shot_id"]: r[M.PROBABILITY] for r in evaluate.predict_split(spark, layout, SEASON, model="challenger").collect()}
    assert len(found) == 144 and found == wanted
    assert len(set(found.values())) > 10


def test_event_inputs_are_slots_in_order(spark, loaded, scored):
    layout, _ = loaded
    train, _, _ = training.split_frames(spark, layout, SEASON, "sequence")
    rows = M.event_inputs(train.select("shot_id", "seq")).collect()
    for row in rows:
        records = [list(e) for e in row["seq"]]
        padded = [[0.0] * 29] * (5 - len(records)) + records
        assert [row[c] for c in M.EVENT_INPUTS] == [v or 0.0 for e in padded for v in e]
    lacking = M.event_inputs(train.select("shot_id", F.when(F.lit(False), F.col("seq")).alias("seq"))).first()
    assert {lacking[c] for c in M.EVENT_INPUTS} == {0.0}


def test_scoring_input_with_other_columns_fails(spark, loaded, scored):
    layout, _ = loaded
    model = M.load_model(spark, layout.aliases, "candidate")
    _, test, features = training.split_frames(spark, layout, SEASON, "tabular")
    rows = test.select("shot_id", *features)
    good, _ = M.score_with_errors(model, rows, features, "shot_id", only=())
    assert good.count() > 0
    with pytest.raises(ValueError, match="surprise"):
        M.score_with_errors(model, rows.withColumn("surprise", F.lit(1)), features, "shot_id", only=())


@pytest.fixture(scope="module")
def two_seasons(spark, loaded, tmp_path_factory):
    """The season and a copy of it four years later, appended."""
    _, written = loaded
    layout = Layout(str(tmp_path_factory.mktemp("two")))
    sinks.load_tables(written, layout)
    later = {name: df for name, df in written.items() if name not in ("teams", "players")}
    for name, df in later.items():
        df = df.withColumn("game_id", F.concat(F.lit("9"), F.substring("game_id", 2, 9)))
        moved = {c: F.lit("2027-28") for c in ("season", "season_year") if c in df.columns}
        if "game_date" in df.columns:
            moved["game_date"] = F.add_months("game_date", 48)
        later[name] = df.withColumns(moved).select(*written[name].columns)
    empty = {name: written[name].limit(0) for name in ("teams", "players")}
    sinks.load_tables({**later, **empty}, layout, replace=False)
    return layout


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_base_tables_are_read_by_season(spark, two_seasons):
    layout = two_seasons
    assert read.read_table(spark, layout, "shots").count() == 1440
    reads = {
        "shots": read.shot_sources(spark, layout, season=SEASON),
        "scores": read.event_scores(spark, layout, season=SEASON),
        "sequence shots": read.sequence_shots(spark, layout, SEASON),
        "events": read.sequence_events(spark, layout, SEASON),
    }
    counts = {name: df.count() for name, df in reads.items()}
    assert counts == {"shots": 720, "scores": 1320, "sequence shots": 720, "events": 1320}
    for name, df in reads.items():
        assert "season#" in plan_of(df).split("PartitionFilters: [", 1)[1].split("]", 1)[0], name
    assert set(reads["shots"].select("season").distinct().toPandas()["season"]) == {SEASON}
    assert read.game_logs(spark, layout, "player").count() == 240
    plain = Layout(layout.root + "-plain")
    for name in S.LOAD_ORDER:
        table = read.read_table(spark, layout, name)
        (table.drop("season") if name in S.SEASON_TABLES else table).write.parquet(plain.table(name))
    for found, wanted in (
        (read.shot_sources(spark, plain, season=SEASON), reads["shots"]),
        (read.sequence_events(spark, plain, SEASON), reads["events"]),
    ):
        columns = sorted(wanted.columns)
        assert sorted(found.columns) == columns
        assert found.select(*columns).exceptAll(wanted.select(*columns)).isEmpty() and found.count() == wanted.count()


def test_games_prune_the_seasons_at_run_time(spark, two_seasons):
    """A filter on the days of games reaches the folders of shots and events through the join."""
    days = ("2027-01-01", "2028-12-31")
    for df, rows in (
        (read.shot_sources(spark, two_seasons, days=days), 720),
        (read.event_scores(spark, two_seasons, days=days), 1320),
    ):
        assert "dynamicpruning" in plan_of(df)
        assert df.count() == rows


def test_a_season_from_the_state_of_the_one_before(spark, two_seasons):
    layout = two_seasons
    one_go = gold.build_gold(spark, layout, "2027-28", version="all").first()
    early = Layout(layout.root + "-early")
    for name in S.LOAD_ORDER:
        table = read.read_table(spark, layout, name)
        keep = table.where(F.col("season") == SEASON) if name in S.SEASON_TABLES else table
        keep.write.partitionBy(*(["season"] if name in S.SEASON_TABLES else [])).parquet(early.table(name))
    gold.write_form_states(spark, early, SEASON)
    states = read.form_states(spark, early, SEASON)
    assert {k: df.count() for k, df in states.items()} == {"player": 30, "team": 15, "opponent": 15}
    for kind, df in states.items():
        sinks.write_frame(df, layout.form_state(kind, SEASON))
    carried = gold.build_gold(spark, layout, "2027-28", version="state", after=SEASON).first()
    assert one_go["passed"] and carried["passed"]
    rows = [read.read_gold(spark, layout, season="2027-28", version=v) for v in ("all", "state")]
    assert rows[0].count() == rows[1].count() == 720
    assert rows[0].exceptAll(rows[1]).isEmpty()
    assert rows[0].where("player_recent_fg_pct_5 is null").isEmpty()
    gold.write_form_states(spark, layout, "2027-28", after=SEASON)
    again = read.form_states(spark, layout, "2027-28")
    for kind in again:
        logs = read.game_logs(spark, layout, "player" if kind == "player" else "team")
        assert again[kind].exceptAll(gold.R.form_state(kind, logs)).isEmpty() and again[kind].count() == states[kind].count()
    with pytest.raises(FileNotFoundError, match="form state"):
        gold.build_gold(spark, layout, "2027-28", version="none", after="1900-01")
