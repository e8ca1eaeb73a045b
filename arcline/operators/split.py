"""Split by game date so that no game is on both sides."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date as Date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import nth_smallest


@dataclass(frozen=True)
class TimeCut:
    """Last training game in (date, id) order; None when there are no games."""

    date: Date | None
    game: object | None

    def label(self, date: str, game: str) -> Column:
        known = F.col(date).isNotNull()
        before = (F.col(date) < F.lit(self.date)) | (
            (F.col(date) == F.lit(self.date)) & (F.col(game) <= F.lit(self.game))
        )
        return F.when(before, F.lit("train")).when(known, F.lit("test"))


def find_time_cut(
    games: DataFrame, fraction: float, *, game: str = "game_id", date: str = "game_date"
) -> TimeCut:
    """Cut after max(1, min(n-1, floor(n*fraction))) games.

    Games are counted per day, so only the one day holding the cut is looked at by id; ids
    count in the order of their type (texts as texts). Games without a date are not counted.
    The driver sees one row. Days are few whatever the data size; the id within the day is
    found by counting, without gathering that day's games.
    """
    if not 0.0 < fraction < 1.0:
        raise ValueError(f"fraction must be between 0 and 1, got {fraction}")
    days = games.where(F.col(date).isNotNull()).groupBy(date).agg(F.count(F.lit(1)).alias("_games"))
    upto = W.orderBy(date).rowsBetween(W.unboundedPreceding, W.currentRow)
    total = F.sum("_games").over(W.partitionBy())
    wanted = F.greatest(F.lit(1), F.least(total - 1, F.floor(total * F.lit(fraction))))
    hit = (
        days.select(date, "_games", F.sum("_games").over(upto).alias("_end"), wanted.alias("_cut"))
        .where((F.col("_end") >= F.col("_cut")) & (F.col("_end") - F.col("_games") < F.col("_cut")))
        .first()
    )
    if hit is None:
        return TimeCut(None, None)
    inside = hit["_cut"] - (hit["_end"] - hit["_games"])
    same_day = games.where(F.col(date) == F.lit(hit[date]))
    return TimeCut(hit[date], nth_smallest(same_day.select(game), game, inside, rows=hit["_games"]))


def time_split(
    rows: DataFrame,
    fraction: float = 0.8,
    *,
    game: str = "game_id",
    date: str = "game_date",
    one_date_per_game: bool = False,
    name: str = "split",
) -> DataFrame:
    """Label every row 'train' or 'test' by the first date of its game; no date gives no label.

    With ``one_date_per_game`` (true for features joined to a game dimension) the label is a
    plain expression on the row and the features are not shuffled at all.
    """
    games = rows.groupBy(game).agg(F.min(date).alias(date))
    cut = find_time_cut(games, fraction, game=game, date=date)
    if cut.date is None:
        return rows.withColumn(name, F.lit("train"))
    if one_date_per_game:
        return rows.withColumn(name, cut.label(date, game))
    labels = games.select(game, cut.label(date, game).alias(name))
    return rows.join(labels, game)


def split_summary(
    labelled: DataFrame, *, game: str = "game_id", date: str = "game_date", name: str = "split"
) -> DataFrame:
    return labelled.groupBy(name).agg(
        F.countDistinct(game).alias("games"),
        F.count(F.lit(1)).alias("shot_rows"),
        F.min(date).alias("min_game_date"),
        F.max(date).alias("max_game_date"),
    )


def split_overlap(labelled: DataFrame, *, game: str = "game_id", name: str = "split") -> DataFrame:
    """Games found on more than one side; expected 0."""
    return (
        labelled.groupBy(game)
        .agg((F.min(name) != F.max(name)).alias("_both"))
        .agg(F.count_if("_both").alias("overlapping_game_ids"))
    )
