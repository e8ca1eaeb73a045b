"""Fit models on a season's splits, record the run, promote the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arcline import schemas as S
from arcline.operators import models as M
from arcline.operators.metrics import classification_metrics
from arcline.sources import tables as read
from arcline.session import written_once
from arcline.sources.layout import Layout
from arcline.sources.sinks import write_frame

from .features import feature_rows

KINDS = ("logistic", "trees", "network", "challenger")


def split_frames(
    spark: SparkSession, layout: Layout, season: str, feature_set: str
) -> tuple[DataFrame, DataFrame, list[str]]:
    features = M.feature_columns(feature_set)
    sides = []
    for name in ("train", "test"):
        rows = read.read_split(spark, layout, season, name)
        rows = feature_rows(spark, layout, season, rows, feature_set)
        frame = M.model_frame(rows, features)
        # Fitting reads its rows several times, so joined ones are derived once.
        sides.append(written_once(frame, "modelling") if feature_set in ("pressure", "sequence") else frame)
    return sides[0], sides[1], features


def train_model(
    spark: SparkSession,
    layout: Layout,
    season: str,
    *,
    kind: str = "trees",
    mode: str = "default",
    feature_set: str = "tabular",
    environment: str = "batch",
    version: str = "1",
    alias: str | None = "candidate",
    **options,
) -> DataFrame:
    """Fit, evaluate on test, save, record and promote; returns the run record.

    ``mode='search'`` (trees only) chooses a configuration on later training games first. A
    challenger always takes the 'sequence' feature set.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}, got {kind!r}")
    if kind == "challenger":
        feature_set = "sequence"
    train, test, features = split_frames(spark, layout, season, feature_set)
    if mode == "search":
        if kind != "trees":
            raise ValueError("search mode is for trees")
        model, leaderboard, result = M.search_trees(train, test, features, **options)
        write_frame(leaderboard, f"{layout.model(kind, version)}-leaderboard")
    elif kind == "challenger":
        model = M.fit_challenger(train, features=features, **options)
        metrics = classification_metrics(M.score(model, test), M.PROBABILITY, S.TARGET)
        result = metrics.first().asDict()
    else:
        fit = {"logistic": M.fit_logistic, "trees": M.fit_trees, "network": M.fit_network}[kind]
        model = fit(train, features, **options)
        metrics = classification_metrics(M.score(model, test), M.PROBABILITY, S.TARGET)
        result = metrics.first().asDict()
    path = M.save_model(model, layout.model(kind, version))
    if kind == "trees":
        importance = M.feature_importance(model, features)
        write_frame(importance, f"{layout.importance}/{version}", kind="csv")
    record = M.run_record(
        spark, environment=environment, model=kind, mode=mode, season=season, result=result
    )
    record.write.mode("append").json(layout.runs)
    if alias is not None:
        M.promote(spark, layout.aliases, alias, path)
    return record
