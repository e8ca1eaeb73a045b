"""Leakage-safe shot features: base columns, recent form, prior margin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcline import schemas as S
from arcline.functions import shots as X
from arcline.operators import form as R
from arcline.operators import quality as Q
from arcline.operators.inspection import inspect_gold
from arcline.operators.margin import attach_margin, without_margin
from arcline.operators.skew import Slices
from arcline.operators.split import split_summary, time_split
from arcline.session import joins_within_keys
from arcline.sources import tables as read
from arcline.sources.layout import Layout
from arcline.sources.sinks import write_frame, write_gold, write_splits

DEFAULT_VERSION = "base_v1"  # fixed value


def base_features(sources: DataFrame) -> DataFrame:
    """23 typed columns from shots joined to their game."""
    clock = X.period_clock("minutes_remaining", "seconds_remaining")
    values = {
        "opponent_team_id": X.opponent_id("team_id", "home_team_id", "away_team_id"),
        "shot_value": X.attempt_value("shot_type"),
        "abs_loc_x": F.abs("loc_x"),
        "shot_angle": X.chart_angle("loc_x", "loc_y"),
        "is_corner_three": X.corner_three("shot_zone_basic", "shot_type", "loc_x", "loc_y"),
        "is_home": F.col("team_id") == F.col("home_team_id"),
        "seconds_remaining_period": clock,
        "seconds_remaining_game": X.game_clock("period", clock),
    }
    return sources.select(
        *[values[c].alias(c) if c in values else F.col(c) for c in S.BASE_SHOT_COLUMNS]
    )


def gold_features(
    base: DataFrame,
    player_logs: DataFrame,
    team_logs: DataFrame,
    events: DataFrame | None,
    *,
    unique_logs: bool = True,
    states: dict[str, DataFrame] | None = None,
    slices: dict[str, Slices] | None = None,
) -> DataFrame:
    """Base columns, 18 form columns, two margin columns. ``events=None`` leaves margins NULL.

    ``states`` (by kind of form) stand for all logs before those given. ``slices`` ('player', 'team') are
    plans made on cheaper frames of the same logs.

    All joins are by game and one more key. Shots that are dealt by game already stay where they
    are (:func:`arcline.session.joins_within_keys`): only the narrow forms and scores move.
    """
    options = {"unique_key": unique_logs}
    if states is None:
        slices = slices or {"player": R.player_slices(player_logs), "team": R.team_slices(team_logs)}
        teams = {**options, "slices": slices["team"]}
        players = R.player_form(player_logs, slices=slices["player"], **options)
        own, allowed = R.team_form(team_logs, **teams), R.opponent_form(team_logs, **teams)
    else:
        players = R.form_since("player", player_logs, states["player"], **options)
        own = R.form_since("team", team_logs, states["team"], **options)
        allowed = R.form_since("opponent", team_logs, states["opponent"], **options)
    joins_within_keys(base.sparkSession)
    rows = R.attach_form(base, players, {"game_id": "game_id", "player_id": "player_id"})
    rows = R.attach_form(rows, own, {"game_id": "game_id", "team_id": "team_id"})
    rows = R.attach_form(rows, allowed, {"game_id": "game_id", "opponent_team_id": "team_id"})
    rows = without_margin(rows) if events is None else attach_margin(rows, events)
    return rows.select(*S.GOLD_COLUMNS)


def versioned(features: DataFrame, version: str = DEFAULT_VERSION) -> DataFrame:
    return features.withColumn("feature_set_version", F.lit(version))


def build_gold(
    spark: SparkSession,
    layout: Layout,
    season: str,
    *,
    version: str = DEFAULT_VERSION,
    include_margin: bool = True,
    replace: bool = True,
    after: str | None = None,
) -> DataFrame:
    """Build, stage, check, inspect and load one (season, version) slice; returns the inspection.

    The season filter applies to shots only: form looks back across seasons. With ``after``, the
    season before, whose form state was written by :func:`write_form_states`, only the logs of
    this season are read and form looks back into that state.
    """
    base = base_features(read.shot_sources(spark, layout, season=season))
    events = read.event_scores(spark, layout, season=season) if include_margin else None
    only = season if after is not None else None
    features = gold_features(
        base,
        read.game_logs(spark, layout, "player", season=only),
        read.game_logs(spark, layout, "team", season=only),
        events,
        states=read.form_states(spark, layout, after) if after is not None else None,
    )
    # Checked where it is staged; a slice that fails leaves the loaded one in place.
    staging = Layout(f"{layout.root}/staging/gold/{season}/{version}")
    write_gold(versioned(features, version), staging, replace=True)
    gold = spark.read.parquet(staging.gold).where(
        (F.col("season") == season) & (F.col("feature_set_version") == version)
    )
    Q.raise_if_critical(Q.check_gold(gold, season=season))
    games = read.season_games(spark, layout, season)
    inspection = inspect_gold(gold, read.read_table(spark, layout, "shots", ["game_id"], season=season), games)
    if not inspection.first()["passed"]:
        raise Q.QualityError(f"gold inspection failed: {inspection.first().asDict()}")
    write_gold(gold, layout, replace=replace)
    return inspection


def write_form_states(
    spark: SparkSession, layout: Layout, season: str, *, after: str | None = None
) -> None:
    """Write the last games per player and team as of the end of a season.

    Made from the state of the season ``after`` and this season's logs; without it, from the
    logs of all loaded seasons, of which this must be the last.
    """
    only = season if after is not None else None
    earlier = read.form_states(spark, layout, after) if after is not None else {}
    for kind in R.FORM_KINDS:
        logs = read.game_logs(spark, layout, "player" if kind == "player" else "team", season=only)
        write_frame(R.form_state(kind, logs, earlier.get(kind)), layout.form_state(kind, season))


def export_splits(
    spark: SparkSession,
    layout: Layout,
    season: str,
    *,
    version: str = DEFAULT_VERSION,
    fraction: float = 0.8,
) -> DataFrame:
    """Write train and test folders; returns sizes and date ranges.

    A game's date comes from the game dimension, so labels need no shuffle of the features.
    """
    gold = read.read_gold(spark, layout, season=season, version=version)
    if gold.isEmpty():
        raise ValueError(f"no gold features for season={season!r}, version={version!r}")
    write_splits(time_split(gold, fraction, one_date_per_game=True), layout, season)
    return split_summary(read.read_splits(spark, layout, season))
