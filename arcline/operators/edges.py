"""Shot-quality tables, the similar-shot baseline and edge backtests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcline import schemas as S
from arcline.functions import shots as X
from arcline.functions.value import ALLOWED_VALUES, checked_value, scored_points

# Columns of the edge table, and measures it may be ranked by.
EDGE_COLUMNS = (
    "row_id",
    "shot_value",
    "shot_distance",
    "period",
    "actual_made",
    "actual_points",
    "predicted_make_probability",
    "expected_shot_value",
    "baseline_make_rate",
    "baseline_expected_value",
    "probability_edge_vs_baseline",
    "ev_edge_vs_baseline",
    "similar_shot_count",
)
RANK_MEASURES = (
    "ev_edge_vs_baseline",
    "probability_edge_vs_baseline",
    "expected_shot_value",
    "predicted_make_probability",
)

def _zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0.0))


def _hit(column: str) -> Column:
    return F.col(column).cast("boolean").cast("double")


def overview(labelled: DataFrame, *, split: str = "split", made: str = S.TARGET) -> DataFrame:
    """Shots and make rates of train, test and both, from one pass."""
    def of(side: str) -> Column:
        return F.col(split) == side

    return labelled.agg(
        F.count_if(of("train")).alias("train_shots"),
        F.count_if(of("test")).alias("test_shots"),
        F.count(F.lit(1)).alias("total_shots"),
        _zero(F.avg(F.when(of("train"), _hit(made)))).alias("train_make_rate"),
        _zero(F.avg(F.when(of("test"), _hit(made)))).alias("test_make_rate"),
        _zero(F.avg(_hit(made))).alias("overall_make_rate"),
    ).withColumn("feature_count", F.lit(len(S.TABULAR_FEATURES)))


def filter_shots(
    df: DataFrame,
    *,
    shot_value: int | None = None,
    periods: list[int] | None = None,
    min_distance: float | None = None,
    max_distance: float | None = None,
) -> DataFrame:
    """Inclusive filters; each one reaches the scan as a pushed predicate."""
    if shot_value is not None:
        df = df.where(F.col("shot_value") == shot_value)
    if periods is not None:
        df = df.where(F.col("period").isin(*periods) if periods else F.lit(False))
    if min_distance is not None:
        df = df.where(F.col("shot_distance") >= min_distance)
    if max_distance is not None:
        df = df.where(F.col("shot_distance") <= max_distance)
    return df


def filter_domain(df: DataFrame) -> DataFrame:
    """Distance range and the periods present (one row per period)."""
    by_period = df.groupBy("period").agg(
        F.min("shot_distance").alias("_low"), F.max("shot_distance").alias("_high")
    )
    return by_period.agg(
        F.min("_low").alias("min_distance"),
        F.max("_high").alias("max_distance"),
        F.array_join(F.array_sort(F.collect_set("period").cast("array<bigint>")), ",").alias("periods"),
    )


def quality_summary(df: DataFrame, made: str = S.TARGET) -> DataFrame:
    rate, value = _zero(F.avg(_hit(made))), _zero(F.avg("shot_value"))
    return df.agg(
        F.count(F.lit(1)).alias("shot_count"),
        rate.alias("make_rate"),
        value.alias("avg_shot_value"),
        _zero(F.avg("shot_distance")).alias("avg_shot_distance"),
        (rate * value).alias("avg_expected_points_baseline"),
    )


def _every_bucket(
    df: DataFrame, rank: Column, labels: tuple[str, ...], name: str, measures: dict[str, Column]
) -> DataFrame:
    """One row per label in order, zeros where empty; no rows for an empty input.

    Measures are aggregated per rank (partial aggregation leaves one row per bucket and
    task), then the few buckets are laid over the full label list.
    """
    ranked = df.withColumn("_rank", rank)
    grouped = ranked.groupBy("_rank").agg(*[c.alias(n) for n, c in measures.items()])
    found = F.struct("_rank", *measures)
    # At most len(labels) + 1 groups reach this array.
    collected = grouped.agg(F.collect_list(found).alias("_found"))
    positions = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(label).alias("label")) for i, label in enumerate(labels)])
    spread = collected.where(F.size("_found") > 0).select("_found", F.explode(positions).alias("_b"))
    match = F.get(F.filter("_found", lambda e: e["_rank"] == F.col("_b.i")), F.lit(0))
    return spread.withColumn("_m", match).select(
        F.col("_b.label").alias(name),
        F.col("_b.i").alias("bucket_rank"),
        *[F.coalesce(F.col("_m")[n], F.lit(0)).alias(n) for n in measures],
    )


def distance_bucket_summary(df: DataFrame, made: str = S.TARGET) -> DataFrame:
    """All seven distance buckets; shots without a bucket count as input but in no row."""
    summary = _every_bucket(
        df,
        X.distance_rank("shot_distance"),
        X.DISTANCE_LABELS,
        "distance_bucket",
        {
            "shot_count": F.count(F.lit(1)),
            "make_rate": _zero(F.avg(_hit(made))),
            "avg_shot_value": _zero(F.avg(F.col("shot_value").cast("double"))),
        },
    )
    return summary.withColumn(
        "avg_expected_points_baseline", F.col("make_rate") * F.col("avg_shot_value")
    )


def similar_baseline(
    shots: DataFrame, *, made: str = S.TARGET, distance: str = "shot_distance"
) -> DataFrame:
    """Make rate per (shot value, distance bucket): at most 2 x 7 rows."""
    rank = X.distance_rank(distance)
    known = shots.where(F.col("shot_value").isin(*ALLOWED_VALUES) & rank.isNotNull())
    return known.groupBy(F.col("shot_value"), rank.alias("bucket_rank")).agg(
        F.count(F.lit(1)).alias("similar_shot_count"),
        F.sum(_hit(made)).alias("similar_made"),
        F.count(made).alias("similar_known"),
    )


def attach_baseline(
    scored: DataFrame,
    baseline: DataFrame,
    *,
    made: str = S.TARGET,
    distance: str = "shot_distance",
    leave_one_out: bool = False,
) -> DataFrame:
    """Baseline make rate, value and group size per shot; zeros when no group matches.

    The shot itself counts in its group unless ``leave_one_out``.
    """
    # Two values times seven buckets bound the broadcast side to 14 rows.
    joined = scored.withColumn("bucket_rank", X.distance_rank(distance)).join(
        F.broadcast(baseline), ["shot_value", "bucket_rank"], "left"
    )
    count, hits, known = (F.col(c) for c in ("similar_shot_count", "similar_made", "similar_known"))
    if leave_one_out:
        own = F.col(made).isNotNull().cast("int")
        count, hits, known = count - 1, hits - _zero(_hit(made)), known - own
    rate = _zero(F.try_divide(hits, known.cast("double")))
    return (
        joined.withColumn("baseline_make_rate", rate)
        .withColumn("baseline_expected_value", rate * checked_value("shot_value").cast("double"))
        .withColumn("similar_shot_count", F.coalesce(count, F.lit(0)))
        .drop("bucket_rank", "similar_made", "similar_known")
    )


def edge_table(
    scored: DataFrame,
    shots: DataFrame | None = None,
    *,
    row_id: str = "row_id",
    made: str = S.TARGET,
    probability: str = "predicted_make_probability",
    leave_one_out: bool = False,
) -> DataFrame:
    """Thirteen columns per scored shot against the baseline of ``shots`` (default: itself)."""
    baseline = similar_baseline(scored if shots is None else shots, made=made)
    joined = attach_baseline(scored, baseline, made=made, leave_one_out=leave_one_out)
    expected = F.col(probability) * F.col("shot_value").cast("double")
    values = {
        "row_id": F.col(row_id),
        "actual_made": F.col(made).cast("boolean"),
        "actual_points": scored_points(F.col(made).cast("boolean"), "shot_value"),
        "predicted_make_probability": F.col(probability),
        "expected_shot_value": expected,
        "probability_edge_vs_baseline": F.col(probability) - F.col("baseline_make_rate"),
        "ev_edge_vs_baseline": expected - F.col("baseline_expected_value"),
    }
    return joined.select(*[values[c].alias(c) if c in values else F.col(c) for c in EDGE_COLUMNS])


def edge_backtest(edges: DataFrame) -> DataFrame:
    """Ten measures per edge bucket, every bucket present; unknown outcomes are skipped."""
    summary = _every_bucket(
        edges,
        X.edge_rank("ev_edge_vs_baseline"),
        X.EDGE_LABELS,
        "bucket",
        {
            "shot_count": F.count(F.lit(1)),
            "avg_predicted_make_probability": _zero(F.avg("predicted_make_probability")),
            "avg_model_ev": _zero(F.avg("expected_shot_value")),
            "avg_baseline_ev": _zero(F.avg("baseline_expected_value")),
            "avg_ev_edge": _zero(F.avg("ev_edge_vs_baseline")),
            "actual_make_rate": _zero(F.avg(_hit("actual_made"))),
            "avg_actual_points": _zero(F.avg("actual_points")),
        },
    )
    return summary.withColumn(
        "model_ev_minus_actual_points", F.col("avg_model_ev") - F.col("avg_actual_points")
    ).withColumn(
        "baseline_ev_minus_actual_points", F.col("avg_baseline_ev") - F.col("avg_actual_points")
    )


def backtest_verdict(summary: DataFrame) -> DataFrame:
    """Count-weighted rates and points of both sides and which way they point."""
    active = F.col("shot_count") > 0

    def weighted(column: str, side: str) -> Column:
        mine = active & F.col("bucket").endswith(f"{side} edge")
        weight = F.when(mine, F.col("shot_count").cast("double"))
        return F.try_divide(F.sum(F.col(column) * weight), F.sum(weight))

    pairs = {
        f"{side}_{short}": weighted(column, side)
        for side in ("positive", "negative")
        for short, column in (("make_rate", "actual_make_rate"), ("points", "avg_actual_points"))
    }
    result = summary.agg(
        F.coalesce(F.sum("shot_count"), F.lit(0)).alias("shots"),
        *[c.alias(n) for n, c in pairs.items()],
    )
    better = (F.col("positive_make_rate") > F.col("negative_make_rate")) | (
        F.col("positive_points") > F.col("negative_points")
    )
    verdict = (
        F.when(F.col("shots") == 0, "no shots")
        .when(F.col("positive_points").isNull() | F.col("negative_points").isNull(), "one side only")
        .when(better, "expected direction")
        .otherwise("no clear difference")
    )
    return result.withColumn("verdict", verdict)


def edge_means(edges: DataFrame) -> DataFrame:
    return edges.agg(
        F.count(F.lit(1)).alias("shots_scored"),
        F.avg("predicted_make_probability").alias("avg_predicted_make_rate"),
        F.avg("expected_shot_value").alias("avg_model_ev"),
        F.avg("baseline_expected_value").alias("avg_baseline_ev"),
        F.avg("ev_edge_vs_baseline").alias("avg_ev_edge"),
    )


def rank_edges(
    edges: DataFrame,
    measure: str = "ev_edge_vs_baseline",
    *,
    highest_first: bool = True,
    shot_value: int | None = None,
    n: int | None = None,
) -> DataFrame:
    if measure not in RANK_MEASURES:
        raise ValueError(f"measure must be one of {RANK_MEASURES}")
    if shot_value is not None:
        edges = edges.where(F.col("shot_value") == shot_value)
    order = F.desc_nulls_last(measure) if highest_first else F.asc_nulls_last(measure)
    ordered = edges.orderBy(order, "row_id")
    return ordered if n is None else ordered.limit(n)


def sample_rows(df: DataFrame, row_id: str, n: int = 100, seed: int = 42) -> DataFrame:
    """A repeatable sample of n rows: the smallest seeded hashes of the id."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(row_id)), row_id).limit(n)


def top_importance(importance: DataFrame, n: int = 15) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(max(n, 0))


def requested_rows(df: DataFrame, requested: DataFrame, row_id: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """(rows found, requested ids that do not exist)."""
    ids = requested.select(row_id).distinct()
    found = df.join(ids, row_id, "left_semi")
    absent = ids.join(df.select(row_id), row_id, "left_anti")
    return found, absent
