"""Per-shot expressions: value, clock, side of the floor, buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parsing import as_column

# Rules of the game and chart geometry.
THREE_POINT_LABEL = "3PT Field Goal"
TWO_POINT_LABEL = "2PT Field Goal"
REGULATION_PERIODS = 4
PERIOD_SECONDS = 720
CORNER_ZONES = ("Left Corner 3", "Right Corner 3")
CORNER_MIN_ABS_X = 220
CORNER_MAX_Y = 92.5
FREE_THROW_WEIGHT = 0.44

# Distance buckets, left-closed, feet.
DISTANCE_EDGES = (0, 5, 10, 15, 20, 25, 30)
DISTANCE_LABELS = (
    "0-5 ft",
    "5-10 ft",
    "10-15 ft",
    "15-20 ft",
    "20-25 ft",
    "25-30 ft",
    "30+ ft",
)

# Edge buckets.
EDGE_LIMIT = 0.10
EDGE_LABELS = (
    "Strong negative edge",
    "Slight negative edge",
    "Slight positive edge",
    "Strong positive edge",
)


def opponent_id(team: Column | str, home: Column | str, away: Column | str) -> Column:
    return F.when(as_column(team) == as_column(home), as_column(away)).otherwise(as_column(home))


def attempt_value(shot_type: Column | str) -> Column:
    return F.when(as_column(shot_type) == THREE_POINT_LABEL, F.lit(3)).otherwise(F.lit(2))


def period_clock(minutes_left: Column | str, seconds_left: Column | str) -> Column:
    return as_column(minutes_left).cast("double") * 60.0 + as_column(seconds_left).cast("double")


def game_clock(period: Column | str, period_seconds: Column | str) -> Column:
    """Seconds left in regulation; inside overtime only the period clock counts."""
    number, seconds = as_column(period).cast("int"), as_column(period_seconds)
    whole_periods = (F.lit(REGULATION_PERIODS) - number) * F.lit(float(PERIOD_SECONDS))
    return F.when(number <= REGULATION_PERIODS, whole_periods + seconds).otherwise(seconds)


def corner_three(
    zone: Column | str, shot_type: Column | str, x: Column | str, y: Column | str
) -> Column:
    """Zone label when known, otherwise the geometric corner; unknown geometry is False."""
    by_geometry = F.coalesce(
        (as_column(shot_type) == THREE_POINT_LABEL)
        & (F.abs(as_column(x)) >= CORNER_MIN_ABS_X)
        & (as_column(y) <= CORNER_MAX_Y),
        F.lit(False),
    )
    return F.when(as_column(zone).isNotNull(), as_column(zone).isin(*CORNER_ZONES)).otherwise(
        by_geometry
    )


def chart_angle(x: Column | str, y: Column | str) -> Column:
    """Angle from straight-on: x is the first argument of atan2 on purpose."""
    return F.atan2(as_column(x).cast("double"), as_column(y).cast("double"))


def possessions(fga: Column | str, fta: Column | str, turnovers: Column | str, oreb: Column | str) -> Column:
    return (
        as_column(fga).cast("double")
        + F.lit(FREE_THROW_WEIGHT) * as_column(fta).cast("double")
        + as_column(turnovers).cast("double")
        - as_column(oreb).cast("double")
    )


def distance_rank(distance: Column | str) -> Column:
    """0-based bucket position; NULL for missing or negative distances."""
    feet = as_column(distance)
    chain = F.when(feet.isNull() | F.isnan(feet.cast("double")) | (feet < DISTANCE_EDGES[0]), None)
    for position, edge in enumerate(DISTANCE_EDGES[1:]):
        chain = chain.when(feet < edge, F.lit(position))
    return chain.otherwise(F.lit(len(DISTANCE_LABELS) - 1))


def distance_bucket(distance: Column | str) -> Column:
    return F.get(F.array(*[F.lit(label) for label in DISTANCE_LABELS]), distance_rank(distance))


def edge_rank(edge: Column | str) -> Column:
    value = as_column(edge)
    return (
        F.when(value <= -EDGE_LIMIT, F.lit(0))
        .when(value <= 0, F.lit(1))
        .when(value < EDGE_LIMIT, F.lit(2))
        .when(value.isNotNull(), F.lit(3))
    )


def edge_bucket(edge: Column | str) -> Column:
    return F.get(F.array(*[F.lit(label) for label in EDGE_LABELS]), edge_rank(edge))


def month_label(date: Column | str) -> Column:
    return F.date_format(as_column(date), "yyyy-MM")
