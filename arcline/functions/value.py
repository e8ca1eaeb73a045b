"""Expected-value expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parsing import as_column

ALLOWED_VALUES = (2, 3)  # fixed values: points an attempt can be worth


def checked_probability(probability: Column | str) -> Column:
    """The probability itself; a value outside [0, 1] fails the query."""
    p = as_column(probability).cast("double")
    message = F.concat(F.lit("probability outside [0, 1]: "), p.cast("string"))
    return F.when((p < 0) | (p > 1) | F.isnan(p), F.raise_error(message)).otherwise(p)


def checked_value(shot_value: Column | str) -> Column:
    value = as_column(shot_value)
    message = F.concat(F.lit("shot value must be 2 or 3: "), value.cast("string"))
    return F.when(~value.isin(*ALLOWED_VALUES), F.raise_error(message)).otherwise(value)


def expected_value(probability: Column | str, shot_value: Column | str) -> Column:
    return checked_probability(probability) * checked_value(shot_value).cast("double")


def scored_points(made: Column | str, shot_value: Column | str) -> Column:
    """Points scored; NULL when the outcome is unknown."""
    outcome = as_column(made)
    return F.when(outcome.isNull(), None).when(
        outcome, as_column(shot_value).cast("double")
    ).otherwise(F.lit(0.0))


def value_columns(probability: str, shot_value: str, made: str) -> dict[str, Column]:
    expected = expected_value(probability, shot_value)
    scored = scored_points(made, shot_value)
    return {
        "expected_shot_value": expected,
        "actual_points": scored,
        "points_above_expected": scored - expected,
    }
