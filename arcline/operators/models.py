"""Make-probability models on Spark ML and their bookkeeping."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcline import schemas as S
from arcline.functions.spatial import SPATIAL_COLUMNS, spatial_encodings
from arcline.functions.value import value_columns

from . import network
from .boosting import BoostedTrees, fit_many, fit_single_features, importances, probabilities
from .metrics import SUSPICIOUS_AUC, classification_metrics, metrics_by_model
from .network import Network
from .quality import require_columns
from .ranks import exact_medians
from .sequences import EVENT_FIELDS, PRESSURE_COLUMNS, SEQUENCE_LENGTH, flat_sequence
from .split import time_split

PROBABILITY = "predicted_make_probability"
# Inputs of the challenger beside its features: every field of every slot, oldest slot first.
EVENT_INPUTS = [f"slot_{slot}_{name}" for slot in range(1, SEQUENCE_LENGTH + 1) for name in EVENT_FIELDS]
SPATIAL_FEATURES = SPATIAL_COLUMNS

# The boosted-tree defaults and the hand-picked search grid.
TREE_DEFAULTS = {
    "num_leaves": 31,
    "learning_rate": 0.05,
    "n_estimators": 300,
    "min_child_samples": 50,
    "subsample": 0.8,
    "colsample_bytree": 0.8,
    "reg_lambda": 0.0,
}
# (num_leaves, learning_rate, n_estimators, min_child_samples, reg_lambda)
TREE_GRID = (
    (15, 0.05, 300, 50, 0.0),
    (31, 0.05, 300, 50, 0.0),
    (63, 0.05, 300, 50, 0.0),
    (31, 0.03, 300, 50, 0.0),
    (31, 0.03, 600, 50, 0.0),
    (31, 0.05, 600, 50, 0.0),
    (63, 0.03, 600, 50, 0.0),
    (31, 0.05, 300, 100, 0.0),
    (63, 0.05, 300, 100, 1.0),
    (31, 0.05, 600, 100, 1.0),
)
HIDDEN_LAYERS = (128, 64, 32)  # fixed value
NETWORK_DEFAULTS = {
    "hidden": HIDDEN_LAYERS,
    "epochs": 50,
    "patience": 5,
    "steps": 8,
    "learning_rate": 1e-3,
    "weight_decay": 1e-4,
    "dropout": 0.2,
}
SEED = 42  # fixed value


def grid_configs() -> list[dict]:
    names = ("num_leaves", "learning_rate", "n_estimators", "min_child_samples", "reg_lambda")
    return [{**TREE_DEFAULTS, **dict(zip(names, row))} for row in TREE_GRID]


@dataclass
class Challenger:
    """A network over features and event inputs; scores rows that hold ``seq``."""

    network: Network


Model = PipelineModel | BoostedTrees | Network | Challenger


def feature_columns(feature_set: str) -> list[str]:
    """'tabular' 31, 'spatial' 49, 'pressure' 62 columns, in model order.

    'sequence' has the same 62 and stands for rows that hold ``seq`` too.
    """
    pressure = (*SPATIAL_FEATURES, *PRESSURE_COLUMNS)
    sets = {"tabular": (), "spatial": SPATIAL_FEATURES, "pressure": pressure, "sequence": pressure}
    if feature_set not in sets:
        raise ValueError(f"feature set must be one of {tuple(sets)}, got {feature_set!r}")
    return [*S.TABULAR_FEATURES, *sets[feature_set]]


def add_spatial(df: DataFrame) -> DataFrame:
    require_columns(df, ("loc_x", "loc_y", "shot_distance", "shot_angle"))
    return df.withColumns(spatial_encodings())


def model_frame(df: DataFrame, features: list[str], label: str = S.TARGET) -> DataFrame:
    """Features as doubles plus a 0/1 label; errors name what is missing."""
    require_columns(df, [*features, label])
    kept = [c for c in df.columns if c not in features and c != label]
    return df.select(
        *kept,
        *[F.col(c).cast("double").alias(c) for c in features],
        F.col(label).cast("boolean").cast("double").alias(label),
    )


def column_medians(df: DataFrame, columns: list[str], *, exact: bool = True) -> dict[str, float]:
    """Median per column; a column without values gets 0.

    The default interpolates like a textbook median, in one counting pass over all columns;
    ``exact=False`` takes a mergeable sketch instead.
    """
    if exact:
        return {c: 0.0 for c in columns} | exact_medians(df, columns)
    row = df.agg(*[F.percentile_approx(c, 0.5, 100_000).alias(c) for c in columns]).first()
    return {c: float(row[c]) if row[c] is not None else 0.0 for c in columns}


def _fill_stage(medians: dict[str, float], flags: bool) -> tuple[SQLTransformer, list[str]]:
    filled = [f"coalesce(`{c}`, {value!r}D) AS `{c}_filled`" for c, value in medians.items()]
    names = [f"{c}_filled" for c in medians]
    if flags:
        filled += [f"CAST(`{c}` IS NULL AS DOUBLE) AS `{c}_absent`" for c in medians]
        names += [f"{c}_absent" for c in medians]
    return SQLTransformer(statement=f"SELECT *, {', '.join(filled)} FROM __THIS__"), names


def preprocessor(
    train: DataFrame, features: list[str], *, scale: bool, flags: bool = False, exact: bool = True
) -> list:
    """Fill, assemble and optionally standardise; statistics come from ``train`` only."""
    fill, names = _fill_stage(column_medians(train, features, exact=exact), flags)
    stages = [fill, VectorAssembler(inputCols=names, outputCol="_raw" if scale else "_features")]
    if scale:
        stages.append(
            StandardScaler(inputCol="_raw", outputCol="_features", withMean=True, withStd=True)
        )
    return stages


def fit_logistic(
    train: DataFrame,
    features: list[str],
    label: str = S.TARGET,
    *,
    max_iter: int = 1000,
    exact: bool = True,
) -> PipelineModel:
    """Median fill, standardise, L2 logistic regression (unit penalty over all rows)."""
    classifier = LogisticRegression(
        featuresCol="_features",
        labelCol=label,
        maxIter=max_iter,
        regParam=1.0 / max(train.count(), 1),
        standardization=False,
    )
    stages = preprocessor(train, features, scale=True, exact=exact)
    return Pipeline(stages=[*stages, classifier]).fit(train)


def tree_config(**overrides) -> dict:
    return {**TREE_DEFAULTS, "seed": SEED, **overrides}


def fit_trees(train: DataFrame, features: list[str], label: str = S.TARGET, **overrides) -> BoostedTrees:
    """Boosted trees grown leaf by leaf; missing values stay missing (see ``boosting.fit_many``)."""
    return fit_many(train, features, label, [tree_config(**overrides)])[0]


def fit_network(
    train: DataFrame,
    features: list[str],
    label: str = S.TARGET,
    *,
    inner_fraction: float = 0.8,
    exact: bool = True,
    **overrides,
) -> Network:
    """Feed-forward network with early stopping on the later games of ``train``.

    ``train`` needs game_id and game_date, from which the held-out games follow; fill values and
    scales come from the earlier games. ``train`` is read several times.
    """
    return _fit_on_earlier_games(train, features, label, inner_fraction, exact, False, overrides)


def _fit_on_earlier_games(
    train: DataFrame,
    features: list[str],
    label: str,
    inner_fraction: float,
    exact: bool,
    with_events: bool,
    overrides: dict,
) -> Network:
    known = train.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in features})
    labelled = _sides(known, inner_fraction)
    try:
        inner = labelled.where(F.col("_side") == "train")
        fill = column_medians(inner, features, exact=exact)
        held_out = F.col("_side") == "test"
        options = {**NETWORK_DEFAULTS, "seed": SEED, **overrides}
        if not with_events:
            return network.fit_network(labelled, features, label, held_out, fill, **options)
        statistics = sequence_statistics(inner)
        scales = dict(zip(EVENT_INPUTS, [statistics[name] for name in EVENT_FIELDS] * SEQUENCE_LENGTH))
        fill |= dict.fromkeys(EVENT_INPUTS, 0.0)
        rows, inputs = event_inputs(labelled), [*features, *EVENT_INPUTS]
        return network.fit_network(rows, inputs, label, held_out, fill, scales=scales, **options)
    finally:
        labelled.unpersist()


def _sides(rows: DataFrame, fraction: float) -> DataFrame:
    """``rows`` with the side of an inner split.

    Where all rows of every game have its date, the label is an expression on the row and rows are neither
    shuffled nor kept. Otherwise games are joined, and rows kept for the passes that follow.
    """
    same = F.min("game_date").eqNullSafe(F.max("game_date")) & F.count("game_date").isin(F.lit(0), F.count(F.lit(1)))
    games = rows.groupBy("game_id").agg((same & F.col("game_id").isNotNull()).alias("_same"))
    plain = bool(games.agg(F.bool_and("_same")).first()[0])
    labelled = time_split(rows, fraction, one_date_per_game=plain, name="_side")
    return labelled if plain else labelled.persist()


def score(model: Model, df: DataFrame, name: str = PROBABILITY) -> DataFrame:
    """Add the make probability; helper columns of the pipeline are dropped."""
    if isinstance(model, Challenger):
        scored = event_inputs(df).withColumn(name, model.network.probability())
        return scored.select(*[c for c in df.columns if c != name], name)
    if isinstance(model, Network):
        return df.select("*", model.probability().alias(name))
    if isinstance(model, BoostedTrees):
        return df.select("*", probabilities([model], name)[0].alias(name))
    scored = model.transform(df)
    return scored.select(*df.columns, F.get(vector_to_array("probability"), F.lit(1)).alias(name))


def prediction_table(scored: DataFrame) -> DataFrame:
    """Ten core columns, then the extras that exist. Alignment is by row, never by position."""
    require_columns(scored, ("shot_id", "game_id", "player_id", "team_id", "shot_value", S.TARGET))
    values = value_columns(PROBABILITY, "shot_value", "_made")
    typed = scored.withColumn("_made", F.col(S.TARGET).cast("boolean"))
    core = {
        "shot_value": F.col("shot_value").cast("int"),
        S.TARGET: F.col("_made"),
        **values,
    }
    extras = [c for c in S.PREDICTION_EXTRA_COLUMNS if c in scored.columns]
    return typed.select(
        *[core[c].alias(c) if c in core else F.col(c) for c in S.PREDICTION_CORE_COLUMNS], *extras
    )


def score_with_errors(
    model: Model,
    df: DataFrame,
    features: list[str],
    row_id: str,
    *,
    only: tuple[str, ...] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(scored rows, rejected rows with a reason): bad rows never stop the good ones.

    A row is rejected for a shot value other than 2 or 3 or for features that are missing. With
    ``only`` the input may hold the features, ``row_id``, the shot value and these columns; any
    other one fails the call and is named.
    """
    require_columns(df, [*features, "shot_value"])
    if only is not None:
        extra = sorted(set(df.columns) - {*features, "shot_value", row_id, *only})
        if extra:
            raise ValueError(f"columns that are no features: {extra}")
    absent = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in features]))
    reason = F.when(
        ~F.coalesce(F.col("shot_value").cast("int").isin(2, 3), F.lit(False)), "invalid shot value"
    ).when(F.size(absent) > 0, F.concat(F.lit("missing: "), F.array_join(absent, ", ")))
    checked = df.withColumn("_reason", reason)
    good = checked.where(F.col("_reason").isNull()).drop("_reason")
    bad = checked.where(F.col("_reason").isNotNull())
    return score(model, good), bad.select(row_id, F.col("_reason").alias("reason"))


def feature_importance(model: BoostedTrees, features: list[str], kind: str = "gain") -> DataFrame:
    """(feature, importance): total gain of a feature's splits, or ('split') their number."""
    found = importances(model, SparkSession.active()).where(F.col("feature").isin(features))
    value = F.col("gain" if kind == "gain" else "splits").alias("importance")
    return found.select("feature", value).orderBy(F.desc("importance"), "feature")


LEADERBOARD_SCHEMA = T.StructType(
    [
        T.StructField("config_index", T.IntegerType()),
        T.StructField("params", T.StringType()),
        T.StructField("validation_log_loss", T.DoubleType()),
        T.StructField("validation_auc", T.DoubleType()),
        T.StructField("rank", T.IntegerType()),
    ]
)


def _scored_by_all(models: list[BoostedTrees], df: DataFrame, label: str) -> DataFrame:
    """(model, score, label): one row per model and row, from one pass over the rows."""
    scores = probabilities(models, "_scores")
    return df.select(F.col(label).alias("_label"), F.posexplode(scores).alias("model", "score"))


def search_trees(
    train: DataFrame,
    test: DataFrame,
    features: list[str],
    label: str = S.TARGET,
    *,
    configs: list[dict] | None = None,
    inner_fraction: float = 0.8,
) -> tuple[BoostedTrees, DataFrame, dict]:
    """Pick a configuration on the later games of ``train``, refit, evaluate on ``test``.

    Returns the refitted model, the leaderboard and the run record. All configurations are
    fitted together over one binned table and judged in one pass over the validation rows.
    """
    configs = configs or grid_configs()
    labelled = _sides(train, inner_fraction)
    try:
        inner = labelled.where(F.col("_side") == "train").drop("_side")
        validation = labelled.where(F.col("_side") == "test").drop("_side")
        models = fit_many(inner, features, label, [tree_config(**c) for c in configs])
        judged = metrics_by_model(_scored_by_all(models, validation, label), "model", "score", "_label")
        found = {row["model"]: row for row in judged.collect()}
    finally:
        labelled.unpersist()
    trials = [(i, str(c), found[i]["log_loss"], found[i]["auc"]) for i, c in enumerate(configs)]
    trials.sort(key=lambda trial: (trial[2], trial[0]))
    best = trials[0]
    final = fit_trees(train, features, label, **configs[best[0]])
    tested = classification_metrics(score(final, test), PROBABILITY, label).first()
    record = {
        "best_config_index": best[0],
        "validation_log_loss": best[2],
        "validation_auc": best[3],
        "test_log_loss": tested["log_loss"],
        "test_auc": tested["auc"],
    }
    ranked = [(*trial, rank) for rank, trial in enumerate(trials, 1)]
    return final, train.sparkSession.createDataFrame(ranked, LEADERBOARD_SCHEMA), record


def missing_shares(train: DataFrame, test: DataFrame, features: list[str]) -> DataFrame:
    """(feature, train_missing_pct, test_missing_pct)."""
    sides = []
    for name, df in (("train", train), ("test", test)):
        shares = df.agg(*[(100.0 * F.avg(F.col(c).isNull().cast("double"))).alias(c) for c in features])
        sides.append(shares.unpivot([], features, "feature", f"{name}_missing_pct"))
    return sides[0].join(sides[1], "feature")


def audit_single_features(
    train: DataFrame,
    test: DataFrame,
    features: list[str],
    label: str = S.TARGET,
    *,
    required: tuple[str, ...] = S.MARGIN_COLUMNS,
    **overrides,
) -> DataFrame:
    """One model per feature: AUC, log loss, accuracy, missing shares and the 0.90 flag.

    Fails unless both sides hold the ``required`` columns, by default those of the prior margin.
    The models are fitted together, over one count of the rows per feature, range and label.
    """
    for side in (train, test):
        require_columns(side, required)
    models = fit_single_features(train, features, label, tree_config(**overrides))
    judged = metrics_by_model(_scored_by_all(models, test, label), "model", "score", "_label")
    names = train.sparkSession.createDataFrame(list(enumerate(features)), "model int, feature string")
    return (
        names.join(judged, "model", "left")
        .join(missing_shares(train, test, features), "feature")
        .select(
            "feature",
            "auc",
            "log_loss",
            "accuracy",
            "train_missing_pct",
            "test_missing_pct",
            F.coalesce(F.col("auc") >= SUSPICIOUS_AUC, F.lit(False)).alias("suspicious"),
        )
        .orderBy(F.desc("auc"), "feature")
    )


def sequence_statistics(sequences: DataFrame) -> dict[str, tuple[float, float]]:
    """(mean, population deviation) per event field over all slots, padding included."""
    slots = sequences.select(F.explode(_padded_records()).alias("e"))
    row = slots.agg(
        *[F.avg(F.col("e")[i]).alias(f"m{i}") for i in range(len(EVENT_FIELDS))],
        *[F.stddev_pop(F.col("e")[i]).alias(f"s{i}") for i in range(len(EVENT_FIELDS))],
    ).first()
    return {
        name: (float(row[f"m{i}"] or 0.0), float(row[f"s{i}"] or 0.0) or 1.0)
        for i, name in enumerate(EVENT_FIELDS)
    }


def _padded_records() -> Column:
    width = len(EVENT_FIELDS)
    flat = flat_sequence("seq")
    starts = F.sequence(F.lit(0), F.lit(SEQUENCE_LENGTH - 1))
    return F.transform(starts, lambda i: F.slice(flat, i * width + 1, width))


def standardised_sequence(statistics: dict[str, tuple[float, float]]) -> Column:
    """145 standardised doubles; statistics belong to the training rows."""
    repeated = [statistics[name] for _ in range(SEQUENCE_LENGTH) for name in EVENT_FIELDS]
    means, scales = F.lit([m for m, _ in repeated]), F.lit([s for _, s in repeated])
    shifted = F.zip_with(flat_sequence("seq"), means, lambda value, mean: value - mean)
    return F.zip_with(shifted, scales, lambda value, scale: value / scale)


def event_inputs(df: DataFrame) -> DataFrame:
    """``df`` with one column per slot and event field; a missing ``seq`` gives zeros, as padding does."""
    flat = df.withColumn("_flat", flat_sequence("seq"))
    values = [F.coalesce(F.get("_flat", F.lit(i)), F.lit(0.0)).alias(c) for i, c in enumerate(EVENT_INPUTS)]
    return flat.select(*df.columns, *values)


def fit_challenger(
    train: DataFrame,
    label: str = S.TARGET,
    *,
    features: list[str] | None = None,
    inner_fraction: float = 0.8,
    exact: bool = True,
    **overrides,
) -> Challenger:
    """Network on the 62 'pressure' columns and the 145 values of ``seq``, which ``train`` holds.

    Fitted as :func:`fit_network` is; an event field is scaled by its mean and deviation over all
    slots of the earlier games.
    """
    features = features or feature_columns("sequence")
    require_columns(train, [*features, "seq", label])
    return Challenger(_fit_on_earlier_games(train, features, label, inner_fraction, exact, True, overrides))


def compare_models(scored: dict[str, DataFrame], label: str = S.TARGET) -> DataFrame:
    """Metrics of several models on the same rows, best log loss first, with a verdict."""
    parts = [
        classification_metrics(df, PROBABILITY, label).select(F.lit(name).alias("model"), "*")
        for name, df in scored.items()
    ]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table.orderBy("log_loss", "model")


def run_record(
    spark: SparkSession, *, environment: str, model: str, mode: str, season: str, result: dict
) -> DataFrame:
    """One run-summary row; the metrics table is the union of such rows."""
    base = {"environment": environment, "model": model, "mode": mode, "season": season}
    body = result if mode == "search" else {"metrics": result}
    return spark.createDataFrame([{**base, **body}], S.RUN_SUMMARY)


def save_model(model: Model, path: str) -> str:
    if isinstance(model, Challenger):
        model.network.save(SparkSession.active(), f"{path}/challenger")
        return path
    if isinstance(model, (BoostedTrees, Network)):
        return model.save(SparkSession.active(), path)
    model.write().overwrite().save(path)
    return path


def promote(spark: SparkSession, aliases_path: str, alias: str, model_path: str) -> None:
    """Point an alias at a saved model; the newest row per alias counts."""
    row = [(alias, model_path, time.time())]
    schema = "alias string, model_path string, promoted_at double"
    spark.createDataFrame(row, schema).write.mode("append").parquet(aliases_path)


def load_model(spark: SparkSession, aliases_path: str, alias: str) -> Model:
    pointers = spark.read.parquet(aliases_path).where(F.col("alias") == alias)
    row = pointers.agg(F.max_by("model_path", "promoted_at").alias("path")).first()
    if row["path"] is None:
        raise KeyError(f"no model is promoted as {alias!r}")
    if _exists(spark, f"{row['path']}/challenger"):
        return Challenger(Network.load(spark, f"{row['path']}/challenger"))
    if _exists(spark, f"{row['path']}/ensemble"):
        return BoostedTrees.load(spark, row["path"])
    if _exists(spark, f"{row['path']}/network"):
        return Network.load(spark, row["path"])
    return PipelineModel.load(row["path"])


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
