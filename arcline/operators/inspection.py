"""Counts and coverage of loaded tables, each as one aggregation per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import key_duplicates, missing, report_union


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return report_union(
        [
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("table_name"), "row_count"
            )
            for name, df in tables.items()
        ]
    )


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column with its NULL (text: or blank) count, from a single pass."""
    counted = df.agg(*[F.count_if(missing(df, c)).alias(c) for c in columns])
    return counted.unpivot([], columns, "column_name", "missing_rows")


def duplicate_keys(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    return report_union(
        [
            key_duplicates(df, keys).select(F.lit(name).alias("table_name"), "*")
            for name, (df, keys) in tables.items()
        ]
    )


def duplicate_sample(df: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
    return counted.where(F.col("row_count") > 1).orderBy(F.desc("row_count"), *keys).limit(n)


def date_coverage(
    df: DataFrame, date: str, game: str, by: list[str] | None = None
) -> DataFrame:
    measures = [
        F.min(date).alias("min_date"),
        F.max(date).alias("max_date"),
        F.countDistinct(game).alias("games"),
        F.count(F.lit(1)).alias("row_count"),
    ]
    return df.groupBy(*by).agg(*measures) if by else df.agg(*measures)


def row_delta(derived: DataFrame, source: DataFrame) -> DataFrame:
    """Rows of a derived table minus rows of its source, as one two-input aggregation."""
    both = derived.select(F.lit(1).alias("d"), F.lit(0).alias("s")).unionByName(
        source.select(F.lit(0).alias("d"), F.lit(1).alias("s"))
    )
    totals = both.agg(
        F.coalesce(F.sum("s"), F.lit(0)).alias("source_rows"),
        F.coalesce(F.sum("d"), F.lit(0)).alias("derived_rows"),
    )
    return totals.withColumn("row_delta", F.col("derived_rows") - F.col("source_rows"))


def id_uniqueness(df: DataFrame, key: str) -> DataFrame:
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counted.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"),
        F.count(key).alias("distinct_ids"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))


def domain_check(df: DataFrame, column: str, allowed) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col(column).isNull()).alias("missing_rows"),
        F.count_if(F.col(column).isNotNull() & ~F.col(column).isin(*allowed)).alias("invalid_rows"),
    )


def percent(condition: Column, decimals: int = 1) -> Column:
    share = F.try_divide(F.count_if(condition).cast("double") * 100.0, F.count(F.lit(1)).cast("double"))
    return F.round(share, decimals)


def fill_rates(df: DataFrame, columns: list[str], by: list[Column] | None = None) -> DataFrame:
    """Total rows, then per column the missing count and the filled percentage."""
    measures = [F.count(F.lit(1)).alias("total_rows")]
    for c in columns:
        measures.append(F.count_if(F.col(c).isNull()).alias(f"missing_{c}"))
        measures.append(percent(F.col(c).isNotNull()).alias(f"{c}_pct"))
    return (df.groupBy(*by) if by else df.groupBy()).agg(*measures)


def feature_averages(df: DataFrame, columns: list[str], decimals: int = 4) -> DataFrame:
    """Average and filled rows per feature."""
    measures = []
    for c in columns:
        measures.append(F.round(F.avg(c), decimals).alias(f"avg_{c}"))
        measures.append(F.count(c).alias(f"filled_{c}"))
    return df.agg(*measures)


def margin_coverage(df: DataFrame, margin: str = "score_margin") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count(margin).alias("with_margin"),
        F.count_if(F.col(margin).isNull()).alias("without_margin"),
        percent(F.col(margin).isNotNull()).alias("with_margin_pct"),
        F.min(margin).alias("min_margin"),
        F.max(margin).alias("max_margin"),
    )


def missing_by_feature(df: DataFrame, features: list[str], split: str = "split") -> DataFrame:
    """One row per (split, feature)."""
    counted = df.groupBy(split).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in features])
    return counted.unpivot([split], features, "feature", "missing_rows")


def inspect_gold(gold: DataFrame, shots: DataFrame, games: DataFrame) -> DataFrame:
    """Seven post-load counts and the verdict in one row.

    ``shots`` are the source shots of the same season. Repeated ids are counted per id
    first; the home flag is compared through one join to the game dimension.
    """
    sides = games.select(
        "game_id", F.col("home_team_id").alias("_home"), F.col("away_team_id").alias("_away")
    )
    home = F.col("is_home")
    wrong_side = (home & (F.col("team_id") != F.col("_home"))) | (
        ~home & (F.col("team_id") != F.col("_away"))
    )
    gold_part = (
        gold.join(sides, "game_id", "left")
        .groupBy("shot_id")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.count_if(~F.col("shot_value").isin(2, 3)).alias("_value"),
            F.count_if(F.col("shot_made_flag").isNull()).alias("_made"),
            F.count_if(F.col("opponent_team_id").isNull()).alias("_opponent"),
            F.count_if(wrong_side).alias("_side"),
        )
        .select(F.lit(0).alias("_shots"), "_n", F.col("_n") - 1, "_value", "_made", "_opponent", "_side")
        .toDF("_shots", "_n", "_extra", "_value", "_made", "_opponent", "_side")
    )
    known_games = games.select("game_id").distinct()
    shot_part = shots.join(known_games, "game_id", "left_semi").select(F.lit(1).alias("_shots"))
    names = {
        "shots_row_count": "_shots",
        "gold_row_count": "_n",
        "duplicate_shot_ids": "_extra",
        "invalid_shot_value_rows": "_value",
        "missing_shot_made_flag": "_made",
        "missing_opponent_team_id": "_opponent",
        "is_home_mismatches": "_side",
    }
    totals = gold_part.unionByName(shot_part, allowMissingColumns=True).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for n, c in names.items()]
    )
    clean = F.lit(True)
    for name in list(names)[2:]:
        clean = clean & (F.col(name) == 0)
    return totals.withColumn(
        "row_count_delta", F.col("gold_row_count") - F.col("shots_row_count")
    ).withColumn(
        "passed", clean & (F.col("gold_row_count") > 0) & (F.col("row_count_delta") == 0)
    )


def home_flag_check(gold: DataFrame, games: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose home flag disagrees with the game, in both directions, per group."""
    sides = games.select(
        "game_id", F.col("home_team_id").alias("_home"), F.col("away_team_id").alias("_away")
    )
    home = F.col("is_home")
    return (
        gold.select(*by, "game_id", "team_id", "is_home")
        .join(sides, "game_id")
        .groupBy(*by)
        .agg(
            F.count_if(home & (F.col("team_id") != F.col("_home"))).alias("is_home_true_but_away"),
            F.count_if(~home & (F.col("team_id") != F.col("_away"))).alias("is_home_false_but_home"),
            F.count(F.lit(1)).alias("total_rows"),
        )
    )
