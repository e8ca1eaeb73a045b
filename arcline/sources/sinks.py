"""Writes. Slices are replaced by dynamic partition overwrite, never by rewriting a table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcline import schemas as S

from .layout import Layout


def write_twin(df: DataFrame, layout: Layout, dataset: str, season: str) -> dict[str, str]:
    """The same frame as CSV and Parquet under one season folder."""
    paths = {kind: layout.raw_season(dataset, season, kind) for kind in ("csv", "parquet")}
    df.write.mode("overwrite").parquet(paths["parquet"])
    written = df.sparkSession.read.schema(df.schema).parquet(paths["parquet"])
    written.write.mode("overwrite").option("header", True).csv(paths["csv"])
    return paths


def read_manifest(spark: SparkSession, layout: Layout) -> DataFrame:
    try:
        return spark.read.schema(S.MANIFEST).parquet(layout.manifest)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], S.MANIFEST)
        raise


def newest_entries(entries: DataFrame) -> DataFrame:
    """One entry per (dataset, season), the most recent one."""
    others = [c for c in entries.columns if c not in ("dataset", "season")]
    newest = F.max_by(F.struct(*others), F.struct("downloaded_at", "source", "row_count"))
    latest = entries.groupBy("dataset", "season").agg(newest.alias("_e"))
    return latest.select("dataset", "season", "_e.*").select(*entries.columns)


def infer_dataset(source: str = "source"):
    """Dataset name from a source text when an entry has none (fixed values)."""
    text = F.lower(F.col(source))
    return (
        F.when(text.contains("shotchartdetail"), "shot_chart")
        .when(text.contains("playergamelogs"), "player_game_logs")
        .when(text.contains("teamgamelogs"), "team_game_logs")
        .when(text.contains("playbyplay"), "play_by_play")
        .otherwise("unknown")
    )


def upsert_manifest(layout: Layout, entries: DataFrame) -> None:
    """Add entries; for a repeated (dataset, season) the newest stays.

    Every write appends, so an interrupted one loses nothing; readers apply
    :func:`newest_entries`.
    """
    named = entries.withColumn("dataset", F.coalesce("dataset", infer_dataset()))
    named.select(*S.MANIFEST.fieldNames()).write.mode("append").parquet(layout.manifest)


def current_manifest(spark: SparkSession, layout: Layout) -> DataFrame:
    return newest_entries(read_manifest(spark, layout))


def append_table(df: DataFrame, layout: Layout, name: str, *, partition_by: list[str] | None = None) -> bool:
    """Append rows; an empty frame writes nothing and returns False."""
    if df.isEmpty():
        return False
    df.write.mode("append").partitionBy(*(partition_by or [])).parquet(layout.table(name))
    return True


def load_tables(
    tables: dict[str, DataFrame], layout: Layout, *, replace: bool = True, partitions: dict[str, list[str]] | None = None
) -> list[str]:
    """Write all cleaned tables parents first; ``replace`` reloads them in full.

    Tables that name the season of their rows lie in one folder per season unless ``partitions``
    says otherwise.
    """
    written = []
    for name in S.LOAD_ORDER:
        by_season = name in S.SEASON_TABLES and "season" in tables[name].columns
        keys = (partitions or {}).get(name, ["season"] if by_season else [])
        writer = tables[name].write.partitionBy(*keys)
        if replace:
            writer = writer.option("partitionOverwriteMode", "static")
        writer.mode("overwrite" if replace else "append").parquet(layout.table(name))
        written.append(name)
    return written


def write_gold(gold: DataFrame, layout: Layout, *, replace: bool = True) -> None:
    """Replace the (season, version) slices present in ``gold``, or append to them.

    Rows are laid out by season and version on disk, and each file holds a range of games in
    order, so a game filter skips files and row groups.
    """
    keys = ["season", "feature_set_version"]
    (
        gold.repartitionByRange(*keys, "game_id", "game_event_id")
        .sortWithinPartitions(*keys, "game_id")
        .write.mode("overwrite" if replace else "append")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(layout.gold)
    )


def write_splits(labelled: DataFrame, layout: Layout, season: str) -> None:
    (
        labelled.repartitionByRange("split", "game_date", "game_id", "shot_id")
        .sortWithinPartitions("split", "game_date", "game_id", "shot_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("split")
        .parquet(layout.splits(season))
    )


def write_frame(df: DataFrame, path: str, *, kind: str = "parquet") -> str:
    """Predictions, summaries, importance, edge and backtest downloads."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
    return path


def write_jdbc(df: DataFrame, url: str, table: str, *, batch_rows: int = 5_000, mode: str = "append") -> bool:
    """Append to a database table in batches; skipped when empty."""
    if df.isEmpty():
        return False
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=batch_rows).mode(mode).save()
    return True
