"""Model inputs of a season: gold rows with the columns a feature set adds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arcline.operators import models as M
from arcline.operators import sequences as Q
from arcline.operators.quality import QualityError
from arcline.sources import tables as read
from arcline.sources.layout import Layout
from arcline.sources.sinks import write_frame


def build_season_sequences(spark: SparkSession, layout: Layout, season: str) -> DataFrame:
    """Sequences of every shot of a season, written once; checks and models read the files."""
    path = f"{layout.table('shot_sequences')}/season={season}"
    built = Q.build_sequences(
        read.sequence_shots(spark, layout, season), read.sequence_events(spark, layout, season)
    )
    write_frame(built, path)
    return read.read_files(spark, path, f"sequences of {season}")


def season_sequences(spark: SparkSession, layout: Layout, season: str) -> DataFrame:
    """Written sequences of a season, built if there are none; none may hold a later event."""
    path = f"{layout.table('shot_sequences')}/season={season}"
    try:
        sequences = read.read_files(spark, path, f"sequences of {season}")
    except FileNotFoundError:
        sequences = build_season_sequences(spark, layout, season)
    if not Q.sequence_quality(sequences).first()["leakage_check_passed"]:
        raise QualityError("a sequence holds an event at or after its shot")
    return sequences


def require_coverage(shots: DataFrame, sequences: DataFrame) -> None:
    """Fail unless every shot has exactly one sequence."""
    gaps = {row["check"]: row["count"] for row in Q.sequence_coverage(shots, sequences).collect()}
    if any(gaps.values()):
        raise QualityError(f"sequences do not cover the shots: {gaps}")


def feature_rows(
    spark: SparkSession, layout: Layout, season: str, rows: DataFrame, feature_set: str
) -> DataFrame:
    """``rows`` of a season with all columns of a feature set; 'sequence' rows hold ``seq`` too."""
    M.feature_columns(feature_set)
    if feature_set == "tabular":
        return rows
    rows = M.add_spatial(rows)
    if feature_set == "spatial":
        return rows
    sequences = season_sequences(spark, layout, season)
    if feature_set == "sequence":
        require_coverage(rows, sequences)
    return Q.attach_pressure(rows, sequences, keep_seq=feature_set == "sequence")
