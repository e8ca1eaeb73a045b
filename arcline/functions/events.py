"""Per-event expressions for play-by-play rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parsing import as_column

# Words that mark each plain event kind in the event label.
LABEL_WORDS = {
    "is_turnover": ("TURNOVER",),
    "is_steal": ("STEAL",),
    "is_free_throw": ("FREE THROW",),
    "is_timeout": ("TIMEOUT",),
    "is_substitution": ("SUBSTITUTION", "SUB:"),
    "is_violation": ("VIOLATION",),
    "is_jump_ball": ("JUMP BALL",),
    "is_block": ("BLOCK",),
}

# Flag order inside an event record.
FLAG_NAMES = (
    "is_field_goal",
    "is_made_shot_event",
    "is_missed_shot_event",
    "is_rebound",
    "is_offensive_rebound",
    "is_defensive_rebound",
    "is_turnover",
    "is_steal",
    "is_foul",
    "is_free_throw",
    "is_timeout",
    "is_substitution",
    "is_violation",
    "is_jump_ball",
    "is_block",
    "is_unknown_event",
)


def event_label(action: Column | str, sub: Column | str) -> Column:
    blank = F.lit("")
    joined = F.concat_ws(
        " ",
        F.coalesce(as_column(action), blank),
        F.coalesce(as_column(sub), blank),
    )
    return F.upper(F.trim(joined))


def event_flags(
    action: Column | str,
    sub: Column | str,
    is_field_goal: Column | str,
    shot_result: Column | str,
) -> dict[str, Column]:
    """Sixteen boolean expressions by flag name; never NULL."""
    label = event_label(action, sub)
    result = F.lower(F.trim(F.coalesce(as_column(shot_result), F.lit(""))))
    made = label.contains("MADE SHOT") | (result == "made")
    missed = label.contains("MISSED SHOT") | (result == "missed")
    rebound = label.contains("REBOUND")
    offensive = rebound & label.contains("OFFENSIVE")
    flags = {
        "is_made_shot_event": made,
        "is_missed_shot_event": missed,
        "is_field_goal": F.coalesce(as_column(is_field_goal), F.lit(False)) | made | missed,
        "is_rebound": rebound,
        "is_offensive_rebound": offensive,
        "is_defensive_rebound": rebound & ~offensive,
        "is_foul": label.contains("FOUL") & ~label.contains("FREE THROW"),
    }
    for name, words in LABEL_WORDS.items():
        found = label.contains(words[0])
        for word in words[1:]:
            found = found | label.contains(word)
        flags[name] = found
    known = F.lit(False)
    for found in flags.values():
        known = known | found
    flags["is_unknown_event"] = ~known
    return {name: flags[name] for name in FLAG_NAMES}


def score_change(
    prior_home: Column | str, prior_away: Column | str, home: Column | str, away: Column | str
) -> Column:
    """Total after minus total before; NULL while a score is still unknown."""
    before = as_column(prior_home).cast("double") + as_column(prior_away).cast("double")
    return as_column(home).cast("double") + as_column(away).cast("double") - before


def possession_change(flags: dict[str, Column]) -> Column:
    return (
        flags["is_made_shot_event"]
        | flags["is_defensive_rebound"]
        | flags["is_turnover"]
        | flags["is_steal"]
    )


def shooter_margin(home_score: Column, away_score: Column, shooter_is_home: Column) -> Column:
    return F.when(shooter_is_home, home_score - away_score).otherwise(away_score - home_score)


def seconds_before_shot(event_clock: Column, shot_clock: Column, elapsed: bool = False) -> Column:
    """Shot clock minus event clock, floored at zero.

    Clocks count down, so for a real earlier event this is zero; the default keeps that
    long-standing definition. ``elapsed=True`` gives the time that really passed.
    """
    gap = event_clock - shot_clock if elapsed else shot_clock - event_clock
    return F.greatest(F.lit(0.0), gap)
