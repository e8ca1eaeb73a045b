"""Reads with declared schemas; filters and column lists reach the files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcline import schemas as S
from arcline.operators.form import FORM_KINDS
from arcline.operators.quality import require_columns

from .layout import RAW_DATASETS, SUMMARIES, Layout


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and NULL both mean missing; only NULL is used after reading."""
    reals = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in reals})


def read_files(spark: SparkSession, path: str, what: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"{what} not found: {path}") from None
        raise


def read_raw(spark: SparkSession, layout: Layout, season: str) -> dict[str, DataFrame]:
    """The four raw datasets of one season; a missing one is named in the error."""
    return {
        name: read_files(spark, layout.raw_season(name, season), f"raw dataset {name} of {season}")
        for name in RAW_DATASETS
    }


def read_table(
    spark: SparkSession,
    layout: Layout,
    name: str,
    columns: list[str] | None = None,
    *,
    season: str | None = None,
) -> DataFrame:
    """A loaded table; ``season`` prunes the folders of a table laid out by season."""
    df = read_files(spark, layout.table(name), f"table {name}")
    if name in S.SEASON_TABLES and "season" in df.columns and dict(df.dtypes)["season"] != "string":
        # A season such as 2024 is read from the folder's name as a number.
        df = df.withColumn("season", F.col("season").cast("string"))
    if season is not None and "season" in df.columns:
        df = df.where(F.col("season") == season)
    return df.select(*columns) if columns else df


def season_games(
    spark: SparkSession, layout: Layout, season: str | None, days: tuple[str, str] | None = None
) -> DataFrame:
    """Games of a season, or of the days from the first to the last one given."""
    games = read_table(
        spark, layout, "games", ["game_id", "season", "game_date", "home_team_id", "away_team_id"]
    )
    if days is not None:
        first, last = (F.lit(day).cast("date") for day in days)
        games = games.where(F.col("game_date").between(first, last))
    return games if season is None else games.where(F.col("season") == season)


def rows_of_games(
    spark: SparkSession,
    layout: Layout,
    name: str,
    games: DataFrame,
    columns: list[str] | None = None,
    *,
    season: str | None = None,
    how: str = "inner",
) -> DataFrame:
    """Rows of a table that belong to ``games`` (with game_id and season), read by season.

    The join also matches the season, so that the seasons of the games found prune the folders
    of the table at run time, also where games were chosen by another column. The season of
    the result, if asked for, is that of the game. A table without seasons joins by game alone.
    """
    df = read_table(spark, layout, name, season=season)
    keys = ["game_id", "season"] if "season" in df.columns else ["game_id"]
    wanted = [c for c in columns or df.columns if c not in keys]
    joined = df.select(*keys, *wanted).join(games, keys, how)
    order = [*(columns or df.columns), *([] if how == "left_semi" else games.columns)]
    return joined.select(*dict.fromkeys(order))


def shot_sources(
    spark: SparkSession, layout: Layout, *, season: str | None = None, days: tuple[str, str] | None = None
) -> DataFrame:
    """Shots with their game's sides and season and their known team."""
    games = season_games(spark, layout, season, days).drop("game_date")
    teams = read_table(spark, layout, "teams", ["team_id"])
    return rows_of_games(spark, layout, "shots", games, season=season).join(teams, "team_id", "left_semi")


def event_scores(
    spark: SparkSession, layout: Layout, *, season: str | None = None, days: tuple[str, str] | None = None
) -> DataFrame:
    columns = ["game_id", "action_number", "score_home", "score_away"]
    known = season_games(spark, layout, season, days).select("game_id", "season")
    return rows_of_games(spark, layout, "play_by_play", known, columns, season=season, how="left_semi")


def game_logs(spark: SparkSession, layout: Layout, kind: str, *, season: str | None = None) -> DataFrame:
    """Player or team logs of every season, since form may look back, or of the one given."""
    known = season_games(spark, layout, season).select("game_id", "season")
    logs = rows_of_games(spark, layout, f"{kind}_game_logs", known, season=season, how="left_semi")
    return logs.drop("season")


def form_states(spark: SparkSession, layout: Layout, season: str) -> dict[str, DataFrame]:
    """The states that the build of a season left."""
    return {
        kind: read_files(spark, layout.form_state(kind, season), f"{kind} form state of {season}")
        for kind in FORM_KINDS
    }


def sequence_shots(spark: SparkSession, layout: Layout, season: str) -> DataFrame:
    games = season_games(spark, layout, season).drop("game_date")
    columns = ["shot_id", "game_id", "game_event_id", "team_id", "period", "minutes_remaining", "seconds_remaining"]
    return rows_of_games(spark, layout, "shots", games, columns, season=season).drop("season")


def sequence_events(spark: SparkSession, layout: Layout, season: str) -> DataFrame:
    columns = [
        "game_id",
        "action_number",
        "period",
        "game_clock",
        "team_id",
        "is_field_goal",
        "shot_result",
        "score_home",
        "score_away",
        "action_type",
        "sub_type",
    ]
    known = season_games(spark, layout, season).select("game_id", "season")
    return rows_of_games(spark, layout, "play_by_play", known, columns, season=season, how="left_semi")


def read_gold(spark: SparkSession, layout: Layout, *, season: str, version: str) -> DataFrame:
    gold = read_files(spark, layout.gold, "gold features")
    kept = gold.where((F.col("season") == season) & (F.col("feature_set_version") == version))
    return kept.select(*S.GOLD_COLUMNS)


def read_splits(spark: SparkSession, layout: Layout, season: str) -> DataFrame:
    """Train and test together; ``where(split == …)`` prunes to one folder."""
    return read_files(spark, layout.splits(season), f"splits of {season}")


def read_split(spark: SparkSession, layout: Layout, season: str, name: str) -> DataFrame:
    return read_splits(spark, layout, season).where(F.col("split") == name).drop("split")


def read_predictions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Predictions from CSV with header: core columns required, extras kept when present."""
    text = require_columns(
        spark.read.option("header", True).csv(path), S.PREDICTION_CORE_COLUMNS
    )
    extras = [c for c in S.PREDICTION_EXTRA_COLUMNS if c in text.columns]
    kept = [*S.PREDICTION_CORE_COLUMNS, *extras]
    return nan_to_null(
        text.select(*[F.col(c).try_cast(S.PREDICTIONS[c].dataType).alias(c) for c in kept])
    )


def read_predictions(spark: SparkSession, layout: Layout, season: str, model: str) -> DataFrame:
    df = read_files(spark, layout.predictions(season, model), f"predictions of {season}/{model}")
    return require_columns(df, S.PREDICTION_CORE_COLUMNS)


def read_summaries(spark: SparkSession, layout: Layout, season: str) -> dict[str, DataFrame]:
    return {
        name: read_files(spark, layout.summary(season, name), f"summary {name} of {season}")
        for name in SUMMARIES
    }


def player_names(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (player_id, full_name): two columns are read."""
    pairs = read_files(spark, path, "player logs").select(
        F.col("PLAYER_ID").cast("bigint").alias("player_id"),
        F.col("PLAYER_NAME").alias("full_name"),
    )
    return pairs.na.drop().distinct()


def read_importance(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("header", True).csv(path)
    require_columns(text, S.IMPORTANCE.fieldNames())
    kept = text.select("feature", F.col("importance").cast("double").alias("importance"))
    if kept.isEmpty():
        raise ValueError(f"feature importance is empty: {path}")
    return kept.orderBy(F.desc("importance"), "feature")


def read_run_summaries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(metrics table, rejected files with reasons) from any number of run records.

    Two layouts exist: 'default' holds its metrics nested, 'search' holds test and
    validation scores at the top level.
    """
    schema = T.StructType([*S.RUN_SUMMARY.fields, T.StructField("_corrupt_record", T.StringType())])
    runs = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
        .withColumn("source_file", F.input_file_name())
    )
    lacking = F.array_compact(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("environment", "model", "mode", "season")])
    )
    metrics = F.array_compact(
        F.array(
            *[
                F.when(F.col(f"metrics.{c}").isNull(), F.lit(c))
                for c in ("auc", "log_loss", "brier_score", "accuracy")
            ]
        )
    )
    search = F.array_compact(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("test_auc", "test_log_loss")])
    )
    def names(prefix: str, missing):
        return F.when(F.size(missing) > 0, F.concat(F.lit(prefix), F.array_join(missing, ", ")))

    is_search = F.col("mode") == "search"
    reason = F.coalesce(
        F.when(F.col("_corrupt_record").isNotNull(), F.lit("malformed JSON")),
        names("missing required field: ", lacking),
        F.when(~F.col("mode").isin("default", "search"), F.concat(F.lit("unsupported mode: "), "mode")),
        F.when(is_search, names("missing search field: ", search)).otherwise(
            names("missing metric: ", metrics)
        ),
    )
    checked = runs.withColumn("reason", reason)
    good = checked.where(F.col("reason").isNull()).select(
        "environment",
        "model",
        "mode",
        "season",
        F.when(is_search, F.col("test_auc")).otherwise(F.col("metrics.auc")).alias("auc"),
        F.when(is_search, F.col("test_log_loss")).otherwise(F.col("metrics.log_loss")).alias("log_loss"),
        F.col("metrics.brier_score").alias("brier_score"),
        F.col("metrics.accuracy").alias("accuracy"),
        "validation_auc",
        "validation_log_loss",
        "best_config_index",
        "source_file",
    )
    return good, checked.where(F.col("reason").isNotNull()).select("source_file", "reason")
