"""Over-expectation summaries and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcline import schemas as S
from arcline.functions.labels import named_id, zone_label
from arcline.functions.shots import month_label
from arcline.session import checkpoint_dir

from .windows import change_from_previous

# Sample-size thresholds used by the findings.
MIN_PLAYER_ATTEMPTS = 100
MIN_ZONE_ATTEMPTS = 100
MIN_MONTH_ATTEMPTS = 40
TOP_N = 5
ZONE_TOP_N = 3

# Names and order of the summary columns.
SUMMARY_MEASURES = (
    "attempts",
    "made_shots",
    "actual_fg_pct",
    "expected_fg_pct",
    "actual_points",
    "expected_points",
    "points_above_expected",
    "points_above_expected_per_100_shots",
    "avg_expected_shot_value",
    "avg_shot_value",
)
SUMMARY_KEYS = {
    "players": ("player_id",),
    "teams": ("team_id",),
    "zones": S.ZONE_COLUMNS,
    "trends": ("player_id", "game_month"),
}



def _parts() -> dict[str, Column]:
    made = F.col("shot_made_flag").cast("boolean")
    return {
        "attempts": F.count("shot_id"),
        "made_shots": F.count_if(made),
        "actual_points": F.coalesce(F.sum("actual_points"), F.lit(0.0)),
        "expected_points": F.coalesce(F.sum("expected_shot_value"), F.lit(0.0)),
        "points_above_expected": F.coalesce(F.sum("points_above_expected"), F.lit(0.0)),
        "_p": F.sum("predicted_make_probability"),
        "_n_p": F.count("predicted_make_probability"),
        "_n_e": F.count("expected_shot_value"),
        "_v": F.sum(F.col("shot_value").cast("double")),
        "_n_v": F.count("shot_value"),
    }


def _measures(parts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    def ratio(top: str, bottom: str) -> Column:
        return F.try_divide(F.col(top).cast("double"), F.col(bottom).cast("double"))

    values = {
        "actual_fg_pct": ratio("made_shots", "attempts"),
        "expected_fg_pct": ratio("_p", "_n_p"),
        "points_above_expected_per_100_shots": ratio("points_above_expected", "attempts") * 100.0,
        "avg_expected_shot_value": ratio("expected_points", "_n_e"),
        "avg_shot_value": ratio("_v", "_n_v"),
    }
    return parts.select(
        *keys, *[values[m].alias(m) if m in values else F.col(m) for m in SUMMARY_MEASURES]
    )


def with_month(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("game_month", month_label("game_date"))


def summarize(predictions: DataFrame, keys: tuple[str, ...] | list[str]) -> DataFrame:
    """One row per group with ten measures; groups with a NULL key are left out."""
    known = predictions.na.drop(subset=list(keys))
    parts = known.groupBy(*keys).agg(*[c.alias(n) for n, c in _parts().items()])
    return _measures(parts, tuple(keys))


def summary_base(predictions: DataFrame) -> DataFrame:
    """Additive parts per (player, team, zone, month): one scan serves every summary."""
    keys = ["player_id", "team_id", *S.ZONE_COLUMNS, "game_month"]
    return with_month(predictions).groupBy(*keys).agg(*[c.alias(n) for n, c in _parts().items()])


def summary_from_base(base: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    names = list(_parts())
    rolled = base.na.drop(subset=list(keys)).groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])
    return _measures(rolled, keys)


def all_summaries(predictions: DataFrame) -> dict[str, DataFrame]:
    """The four summaries from one scan: their additive parts are checkpointed and shared."""
    checkpoint_dir(predictions.sparkSession)
    base = summary_base(predictions).checkpoint()
    return {name: summary_from_base(base, keys) for name, keys in SUMMARY_KEYS.items()}


def summarize_players(predictions: DataFrame) -> DataFrame:
    return summarize(predictions, SUMMARY_KEYS["players"])


def summarize_teams(predictions: DataFrame) -> DataFrame:
    return summarize(predictions, SUMMARY_KEYS["teams"])


def summarize_zones(predictions: DataFrame) -> DataFrame:
    absent = [c for c in S.ZONE_COLUMNS if c not in predictions.columns]
    if absent:
        raise KeyError(f"predictions without zone columns: {absent}")
    return summarize(predictions, SUMMARY_KEYS["zones"])


def summarize_player_months(predictions: DataFrame) -> DataFrame:
    if "game_date" not in predictions.columns:
        raise KeyError("predictions without game_date")
    return summarize(with_month(predictions), SUMMARY_KEYS["trends"])


def with_minimum_attempts(summary: DataFrame, minimum: int) -> DataFrame:
    return summary.where(F.col("attempts") >= minimum)


def top_rows(
    summary: DataFrame, measure: str, keys: list[str], n: int, *, ascending: bool = False
) -> DataFrame:
    """The n best (or worst) rows; missing measures last, ties by key. Never a full sort."""
    order = F.asc_nulls_last(measure) if ascending else F.desc_nulls_last(measure)
    return summary.orderBy(order, *keys).limit(n)


def top_players_by_total(players: DataFrame, *, minimum: int = MIN_PLAYER_ATTEMPTS, n: int = TOP_N) -> DataFrame:
    return top_rows(with_minimum_attempts(players, minimum), "points_above_expected", ["player_id"], n)


def top_players_by_rate(players: DataFrame, *, minimum: int = MIN_PLAYER_ATTEMPTS, n: int = TOP_N) -> DataFrame:
    kept = with_minimum_attempts(players, minimum)
    return top_rows(kept, "points_above_expected_per_100_shots", ["player_id"], n)


def top_teams_by_total(teams: DataFrame, *, n: int = TOP_N) -> DataFrame:
    return top_rows(teams, "points_above_expected", ["team_id"], n)


def top_teams_by_value(teams: DataFrame, *, n: int = TOP_N) -> DataFrame:
    return top_rows(teams, "avg_expected_shot_value", ["team_id"], n)


def zone_extremes(zones: DataFrame, *, minimum: int = MIN_ZONE_ATTEMPTS, n: int = ZONE_TOP_N) -> DataFrame:
    kept = with_minimum_attempts(zones, minimum)
    measure, keys = "points_above_expected_per_100_shots", list(S.ZONE_COLUMNS)
    best = top_rows(kept, measure, keys, n).withColumn("side", F.lit("best"))
    worst = top_rows(kept, measure, keys, n, ascending=True).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def month_changes(trends: DataFrame, *, minimum: int = MIN_MONTH_ATTEMPTS) -> DataFrame:
    """Change of the per-100 rate between consecutive months that have enough attempts."""
    measure = "points_above_expected_per_100_shots"
    changed = change_from_previous(
        with_minimum_attempts(trends, minimum),
        "player_id",
        "game_month",
        measure,
        {"game_month": "from_month", "attempts": "from_attempts"},
    )
    return changed.select(
        "player_id",
        "from_month",
        F.col("game_month").alias("to_month"),
        F.col("change").alias("delta_per_100"),
        "from_attempts",
        F.col("attempts").alias("to_attempts"),
        F.col(measure).alias("to_total_per_100"),
    )


def month_change_extremes(changes: DataFrame) -> DataFrame:
    """Largest improvement and largest decline, one row each."""
    keys = ["player_id", "to_month"]
    up = top_rows(changes, "delta_per_100", keys, 1).withColumn("side", F.lit("improvement"))
    down = top_rows(changes, "delta_per_100", keys, 1, ascending=True)
    return up.unionByName(down.withColumn("side", F.lit("decline")))


def findings(
    summaries: dict[str, DataFrame],
    *,
    player_names: DataFrame | None = None,
    team_names: DataFrame | None = None,
    min_players: int = MIN_PLAYER_ATTEMPTS,
    min_zones: int = MIN_ZONE_ATTEMPTS,
    min_months: int = MIN_MONTH_ATTEMPTS,
    n: int = TOP_N,
    zone_n: int = ZONE_TOP_N,
) -> DataFrame:
    """All findings as rows (finding, position, subject, attempts, total, per_100, value).

    ``player_names``: player_id, full_name; ``team_names``: team_id, abbreviation. Every
    part is at most a handful of rows before names are joined, so the position window and
    the name joins are bounded.
    """
    from pyspark.sql import Window as W

    def rows(df, finding, subject, order, value="points_above_expected_per_100_shots"):
        position = F.row_number().over(W.orderBy(order, "subject"))
        return df.select(
            subject.alias("subject"),
            F.col("attempts").cast("bigint").alias("attempts"),
            F.col("points_above_expected").alias("total"),
            F.col("points_above_expected_per_100_shots").alias("per_100"),
            F.col(value).alias("value"),
        ).select(F.lit(finding).alias("finding"), position.alias("position"), "*")

    def named(df, names, key, column, fallback):
        if names is None:
            return df, named_id(F.lit(None).cast("string"), key, fallback)
        small = names.select(F.col(key), F.col(column).alias("_name"))
        # The few chosen rows are broadcast to the name table, not the other way round.
        matched = small.join(F.broadcast(df.select(key)), key, "left_semi")
        return df.join(matched, key, "left"), named_id("_name", key, fallback)

    parts = []
    for finding, chosen, measure in (
        ("top players by total", top_players_by_total(summaries["players"], minimum=min_players, n=n), "points_above_expected"),
        ("top players by rate", top_players_by_rate(summaries["players"], minimum=min_players, n=n), "points_above_expected_per_100_shots"),
    ):
        df, label = named(chosen, player_names, "player_id", "full_name", "Player")
        parts.append(rows(df, finding, label, F.desc("value"), measure))
    for finding, chosen, measure in (
        ("top teams by total", top_teams_by_total(summaries["teams"], n=n), "points_above_expected"),
        ("top teams by expected value", top_teams_by_value(summaries["teams"], n=n), "avg_expected_shot_value"),
    ):
        df, label = named(chosen, team_names, "team_id", "abbreviation", "Team")
        parts.append(rows(df, finding, label, F.desc("value"), measure))
    zones = zone_extremes(summaries["zones"], minimum=min_zones, n=zone_n)
    for side, order in (("best", F.desc("value")), ("worst", F.asc("value"))):
        parts.append(rows(zones.where(F.col("side") == side), f"{side} zones", zone_label(*S.ZONE_COLUMNS), order))
    extremes = month_change_extremes(month_changes(summaries["trends"], minimum=min_months))
    df, label = named(extremes, player_names, "player_id", "full_name", "Player")
    span = F.concat_ws(" ", label, F.col("from_month"), F.lit("to"), F.col("to_month"))
    parts.append(
        df.select(
            F.concat(F.lit("month "), "side").alias("finding"),
            F.lit(1).alias("position"),
            span.alias("subject"),
            F.col("to_attempts").cast("bigint").alias("attempts"),
            F.lit(None).cast("double").alias("total"),
            F.col("to_total_per_100").alias("per_100"),
            F.col("delta_per_100").alias("value"),
        )
    )
    parts.append(
        summaries["players"]
        .agg(F.coalesce(F.sum("attempts"), F.lit(0)).cast("bigint").alias("attempts"))
        .select(
            F.lit("evaluation volume").alias("finding"),
            F.lit(1).alias("position"),
            F.lit(f"min players {min_players}, zones {min_zones}").alias("subject"),
            "attempts",
            F.lit(None).cast("double").alias("total"),
            F.lit(None).cast("double").alias("per_100"),
            F.lit(None).cast("double").alias("value"),
        )
    )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
