"""Raw files to validated, loaded tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcline import schemas as S
from arcline.operators import clean as C
from arcline.operators import quality as Q
from arcline.operators.windows import number_rows
from arcline.sources.layout import Layout
from arcline.sources.sinks import load_tables
from arcline.sources.tables import read_raw, read_table


def build_tables(
    raw: dict[str, DataFrame],
    teams_raw: DataFrame,
    *,
    season_type: str = "Regular Season",
    column_formats: bool = False,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """(seven cleaned tables, games whose sides could not be resolved).

    Every date and minute value is read in its own format. ``column_formats`` decides the
    format once per column instead, in one narrow pass each; values in the other format are
    then missing, and rows that need them are dropped.
    """
    shots, players, teams_log, events = (
        raw[n] for n in ("shot_chart", "player_game_logs", "team_game_logs", "play_by_play")
    )
    teams = C.team_dimension(teams_raw)
    games, unresolved = C.game_dimension(teams_log, teams, shots=shots, season_type=season_type)

    def formats(df: DataFrame, **columns: str) -> dict[str, str]:
        return C.column_formats(df, **columns) if column_formats else dict.fromkeys(columns, "row")

    def logs(df: DataFrame, is_players: bool) -> DataFrame:
        found = formats(df, minutes="MIN", date="GAME_DATE")
        return C.clean_game_logs(
            df, players=is_players, minutes_format=found["minutes"], date_format=found["date"]
        )

    shot_dates = formats(shots, date="GAME_DATE")["date"]
    tables = {
        "teams": teams,
        "players": C.player_dimension(shots, players),
        "games": games,
        "shots": C.clean_shots(shots, date_format=shot_dates),
        "player_game_logs": logs(players, True),
        "team_game_logs": logs(teams_log, False),
        "play_by_play": C.clean_events(events),
    }
    return tables, unresolved


def with_shot_ids(shots: DataFrame) -> DataFrame:
    """Surrogate shot_id: position in (game, event, player) order, stable across reruns."""
    digits = F.col("game_id").try_cast("bigint")
    message = F.concat(F.lit("game id is not a number: "), "game_id")
    numeric = shots.withColumn("_game", F.coalesce(digits, F.raise_error(message)))
    order = ["game_event_id", "player_id"]
    return number_rows(numeric, "_game", order, "shot_id").drop("_game")


def with_season(rows: DataFrame, games: DataFrame) -> DataFrame:
    """``rows`` with the season of their game; a game that is not known gives none."""
    return rows.join(games.select("game_id", "season"), "game_id", "left").select(*rows.columns, "season")


def new_rows(spark: SparkSession, layout: Layout, name: str, staged: DataFrame) -> DataFrame:
    """Staged rows of a table whose natural key is not loaded yet, shot ids moved behind the loaded."""
    try:
        loaded = spark.read.parquet(layout.table(name))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return staged
        raise
    fresh = staged.join(loaded.select(*S.NATURAL_KEYS[name]), list(S.NATURAL_KEYS[name]), "left_anti")
    if name != "shots":
        return fresh
    last = loaded.agg(F.coalesce(F.max("shot_id"), F.lit(0))).first()[0]
    return fresh.withColumn("shot_id", F.col("shot_id") + F.lit(last)).select(*staged.columns)


def load_season(
    spark: SparkSession,
    layout: Layout,
    season: str,
    teams_raw: DataFrame,
    *,
    replace: bool = True,
) -> dict[str, DataFrame]:
    """Read, clean, write, check; fails after listing critical issues.

    Shots, logs and events are laid out by the season of their game, so that later jobs read the
    folders of their season only. Tables are written once to a staging root and checked there, so cleaning runs once; the
    checked files are then loaded parents first. Without ``replace`` rows whose natural key is
    loaded already stay out, and shot ids go on after the largest loaded one.
    """
    tables, unresolved = build_tables(read_raw(spark, layout, season), teams_raw)
    problems = unresolved.limit(5).collect()
    if problems:
        raise Q.QualityError(f"home/away unresolved, for example {[tuple(r) for r in problems]}")
    tables["shots"] = with_shot_ids(tables["shots"])
    for name in S.SEASON_TABLES:
        tables[name] = with_season(tables[name], tables["games"])
    staging = Layout(f"{layout.root}/staging/{season}")
    load_tables(tables, staging, replace=True)
    staged = {name: read_table(spark, staging, name) for name in tables}
    Q.raise_if_critical(Q.check_cleaned(staged, season=season))
    load_tables(staged if replace else {n: new_rows(spark, layout, n, df) for n, df in staged.items()}, layout, replace=replace)
    return {name: read_table(spark, layout, name) for name in tables}
