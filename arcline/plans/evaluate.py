"""Score a split, value it, summarise it, rank it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcline import schemas as S
from arcline.operators import models as M
from arcline.operators import sequences as Q
from arcline.operators import summaries as A
from arcline.operators.edges import edge_backtest, edge_table
from arcline.operators.quality import QualityError
from arcline.sources import tables as read
from arcline.sources.layout import Layout
from arcline.sources.sinks import write_frame

from .features import build_season_sequences, feature_rows, require_coverage


def checked_sequences(shots: DataFrame, sequences: DataFrame) -> DataFrame:
    """Shots with ``seq`` and pressure columns; fails on leakage or missing coverage."""
    quality = Q.sequence_quality(sequences).first()
    if not quality["leakage_check_passed"]:
        raise QualityError("a sequence holds an event at or after its shot")
    require_coverage(shots, sequences)
    return Q.attach_pressure(shots, sequences, keep_seq=True)


def predict_split(
    spark: SparkSession,
    layout: Layout,
    season: str,
    *,
    model: str = "candidate",
    split: str = "test",
    feature_set: str = "tabular",
) -> DataFrame:
    """Score a split with a promoted model and write the prediction table.

    A challenger takes 'sequence' rows, whatever ``feature_set`` says.
    """
    fitted = M.load_model(spark, layout.aliases, model)
    if isinstance(fitted, M.Challenger):
        feature_set = "sequence"
    shots = read.read_split(spark, layout, season, split)
    shots = feature_rows(spark, layout, season, shots, feature_set)
    scored = M.score(fitted, M.model_frame(shots, M.feature_columns(feature_set)))
    write_frame(M.prediction_table(scored), layout.predictions(season, model))
    return read.read_predictions(spark, layout, season, model)


def run_summaries(
    spark: SparkSession, layout: Layout, season: str, *, model: str = "candidate"
) -> dict[str, DataFrame]:
    """Write all four summaries from one scan: additive parts are written once and re-read."""
    predictions = read.read_predictions(spark, layout, season, model)
    base_path = f"{layout.root}/summaries/base/season={season}"
    write_frame(A.summary_base(predictions), base_path)
    base = spark.read.parquet(base_path)
    for name, keys in A.SUMMARY_KEYS.items():
        write_frame(A.summary_from_base(base, keys), layout.summary(season, name))
    return read.read_summaries(spark, layout, season)


def build_findings(spark: SparkSession, layout: Layout, season: str, **options) -> DataFrame:
    return A.findings(read.read_summaries(spark, layout, season), **options)


def edge_report(predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edge table, backtest by edge bucket) of scored shots."""
    rows = predictions.withColumn("row_id", F.col("shot_id"))
    if "period" not in rows.columns:
        rows = rows.withColumn("period", F.lit(None).cast("bigint"))
    edges = edge_table(rows, made=S.TARGET)
    return edges, edge_backtest(edges)


__all__ = [
    "build_season_sequences",
    "checked_sequences",
    "predict_split",
    "run_summaries",
    "build_findings",
    "edge_report",
]
