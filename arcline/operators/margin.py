"""Score margin before each shot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcline.functions.events import shooter_margin

from .form import attach_form
from .windows import fill_then_lag


def prior_scores(
    events: DataFrame,
    *,
    game: str = "game_id",
    number: str = "action_number",
    home: str = "score_home",
    away: str = "score_away",
) -> DataFrame:
    """Per event the score known before it; 0 before the first score of a game."""
    filled = fill_then_lag(
        events.select(game, number, home, away),
        [game],
        [number],
        {home: ("_home", "prior_score_home"), away: ("_away", "prior_score_away")},
    )
    return filled.select(game, number, "prior_score_home", "prior_score_away")


def attach_margin(shots: DataFrame, events: DataFrame) -> DataFrame:
    """Margin from the shooter's side at the event numbered like the shot.

    The match is an equality: a shot without its own event keeps NULL and the missing flag.
    A repeated event number fails the query instead of multiplying shots.
    """
    joined = attach_form(
        shots, prior_scores(events), {"game_id": "game_id", "game_event_id": "action_number"}
    )
    margin = F.when(
        F.col("prior_score_home").isNotNull() & F.col("prior_score_away").isNotNull(),
        shooter_margin(F.col("prior_score_home"), F.col("prior_score_away"), F.col("is_home")),
    ).cast("bigint")
    return (
        joined.withColumn("score_margin", margin)
        .withColumn("score_margin_missing", F.col("score_margin").isNull())
        .drop("prior_score_home", "prior_score_away")
    )


def without_margin(shots: DataFrame) -> DataFrame:
    """The same two columns when no event log is available."""
    return shots.withColumn("score_margin", F.lit(None).cast("bigint")).withColumn(
        "score_margin_missing", F.lit(True)
    )
