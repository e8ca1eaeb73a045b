"""The last events before each shot, as one array of records per shot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcline.functions.events import (
    FLAG_NAMES,
    event_flags,
    possession_change,
    score_change,
    seconds_before_shot,
    shooter_margin,
)
from arcline.functions.parsing import clock_seconds
from arcline.functions.shots import game_clock, period_clock

from .skew import plan_slices
from .windows import fill_then_lag

SEQUENCE_LENGTH = 5
SHOT_CLOCK_SECONDS = 24.0  # fixed value: length of a possession clock

# Field order of an event record.
EVENT_FIELDS = (
    "event_order_from_shot",
    "period",
    "seconds_remaining_period",
    "seconds_remaining_game",
    "seconds_since_next_event_or_shot",
    "event_seconds_before_shot",
    "same_team_as_shooter",
    "event_team_is_home",
    "score_margin_before_event",
    "event_score_change",
    "event_team_is_opponent",
    "event_likely_possession_change",
    "event_same_possession_as_shot",
    *FLAG_NAMES,
)

# Pressure columns; summary counts name the event field they add up.
SUMMARY_FLAGS = {
    "sequence_contains_timeout": "is_timeout",
    "sequence_contains_offensive_rebound": "is_offensive_rebound",
    "sequence_contains_turnover": "is_turnover",
}
SUMMARY_COUNTS = {
    "prior_5_score_change_total": "event_score_change",
    "prior_5_turnover_count": "is_turnover",
    "prior_5_steal_count": "is_steal",
    "prior_5_off_rebound_count": "is_offensive_rebound",
    "prior_5_def_rebound_count": "is_defensive_rebound",
    "prior_5_foul_count": "is_foul",
    "prior_5_same_team_event_count": "same_team_as_shooter",
    "prior_5_opponent_event_count": "event_team_is_opponent",
}
PRESSURE_COLUMNS = (
    "shot_seconds_remaining_period",
    "late_clock_proxy",
    *SUMMARY_FLAGS,
    *SUMMARY_COUNTS,
)

_SCORES = {
    "score_home": ("score_home_filled", "prior_score_home"),
    "score_away": ("score_away_filled", "prior_score_away"),
}


def _event_columns(events: DataFrame) -> DataFrame:
    """Expressions that need only the event row itself."""
    flags = event_flags("action_type", "sub_type", "is_field_goal", "shot_result")
    clock = clock_seconds("game_clock")
    return events.select(
        "game_id",
        "action_number",
        "team_id",
        "score_home",
        "score_away",
        F.col("period").cast("double").alias("period"),
        clock.alias("seconds_remaining_period"),
        game_clock("period", clock).alias("seconds_remaining_game"),
        *[flag.alias(name) for name, flag in flags.items()],
        possession_change(flags).alias("possession_change"),
    )


def enrich_events(events: DataFrame) -> DataFrame:
    """Clock seconds, filled and prior scores, kind flags, per event."""
    rows = _event_columns(events)
    return fill_then_lag(rows, ["game_id"], ["action_number"], _SCORES)


def last_events_before(
    left: DataFrame,
    right: DataFrame,
    *,
    key: str,
    left_position: str,
    right_position: str,
    record: list[str],
    n: int = SEQUENCE_LENGTH,
    fill: dict[str, tuple[str, str]] | None = None,
    name: str = "events",
    parts: int | None = None,
) -> DataFrame:
    """As-of join: each left row gets the last ``n`` right rows strictly before its position.

    Both sides are unioned and shuffled once by key. Right rows collect their last ``n`` among
    themselves, a frame of ``n`` rows; left rows take the latest such array, a running value.
    So any number of left rows between two right rows needs no more memory. The array is
    built after the shuffle and only left rows leave the operator. ``fill`` runs
    :func:`fill_then_lag` over the right columns inside the same partitions. ``parts`` deals rows to as
    many partitions as those of another table dealt by the key.
    """
    marked_right = right.select(
        key,
        F.col(right_position).alias("_at"),
        F.lit(1).alias("_right"),
        *[c for c in right.columns if c not in (key,)],
    )
    marked_left = left.select(
        key,
        F.col(left_position).alias("_at"),
        F.lit(0).alias("_right"),
        F.struct(*[c for c in left.columns if c != key]).alias("_left"),
    )
    rows = marked_right.unionByName(marked_left, allowMissingColumns=True)
    slices = plan_slices(rows, [key], ["_at", "_right"])
    rows = slices.assign(rows)
    if slices.hot is None:
        rows = rows.repartition(parts, key) if parts else slices.spread(rows)
    if fill:
        rows = fill_then_lag(rows, [key], ["_at", "_right"], fill, slices=slices, finish=False)
    keep = [c for c in rows.columns if c.startswith("_")]
    rows = rows.select(
        key, *keep, F.when(F.col("_right") == 1, F.struct(*record)).alias("_record")
    )
    rows = slices.carry_rows(rows, n, F.col("_right") == 1)
    if slices.hot is not None:
        rows = slices.spread(rows)
    own = W.partitionBy(*slices.partition, "_right").orderBy("_at").rowsBetween(-(n - 1), 0)
    latest = F.when(F.col("_right") == 1, F.collect_list("_record").over(own))
    upto = slices.window().rowsBetween(W.unboundedPreceding, W.currentRow)
    none = F.array().cast(T.ArrayType(rows.schema["_record"].dataType))
    rows = rows.withColumn("_latest", latest).withColumn(
        name, F.coalesce(F.last("_latest", ignorenulls=True).over(upto), none)
    )
    found = slices.finish(rows).where(F.col("_right") == 0)
    return found.select(key, "_left.*", name)


def _shot_record(event: Column, index: Column, shot: dict[str, Column], elapsed: bool) -> Column:
    """One event seen from the shot: 29 doubles."""
    count = F.size("events")
    following = F.get(F.col("events"), index + 1)["seconds_remaining_game"]
    until = F.when(index < count - 1, following).otherwise(shot["clock"])
    gap = event["seconds_remaining_game"] - until
    own = F.coalesce(event["team_id"] == shot["team"], F.lit(False))
    later = F.slice("events", index + 1, F.lit(SEQUENCE_LENGTH))
    values = {
        "event_order_from_shot": index - count,
        "period": event["period"],
        "seconds_remaining_period": event["seconds_remaining_period"],
        "seconds_remaining_game": event["seconds_remaining_game"],
        "seconds_since_next_event_or_shot": F.when(gap < 0, F.lit(0.0)).otherwise(gap),
        "event_seconds_before_shot": seconds_before_shot(
            event["seconds_remaining_game"], shot["clock"], elapsed
        ),
        "same_team_as_shooter": own,
        "event_team_is_home": F.coalesce(event["team_id"] == shot["home"], F.lit(False)),
        "score_margin_before_event": shooter_margin(
            event["prior_score_home"], event["prior_score_away"], shot["team"] == shot["home"]
        ),
        "event_score_change": score_change(
            event["prior_score_home"],
            event["prior_score_away"],
            event["score_home_filled"],
            event["score_away_filled"],
        ),
        "event_team_is_opponent": event["team_id"].isNotNull() & ~own,
        "event_likely_possession_change": event["possession_change"],
        "event_same_possession_as_shot": own
        & ~F.exists(later, lambda other: other["possession_change"]),
        **{flag: event[flag] for flag in FLAG_NAMES},
    }
    return F.struct(*[values[name].cast("double").alias(name) for name in EVENT_FIELDS])


def build_sequences(
    shots: DataFrame, events: DataFrame, *, elapsed: bool = False, parts: int | None = None
) -> DataFrame:
    """Per shot: ``seq`` (up to five records, oldest first) and ``max_prior_action``.

    Only events numbered below the shot's own event are used, whether or not that event
    exists. Shots without any prior event keep an empty array and -1. ``parts`` is that of
    :func:`last_events_before`.
    """
    seconds = (
        F.col("seconds_remaining_period").cast("double")
        if "seconds_remaining_period" in shots.columns
        else period_clock("minutes_remaining", "seconds_remaining")
    )
    left = shots.select(
        "game_id",
        "shot_id",
        "game_event_id",
        F.col("team_id").alias("shooter_team_id"),
        "home_team_id",
        seconds.alias("shot_seconds_remaining_period"),
        game_clock("period", seconds).alias("shot_clock"),
    )
    record = [
        "action_number",
        "team_id",
        "period",
        "seconds_remaining_period",
        "seconds_remaining_game",
        "score_home_filled",
        "score_away_filled",
        "prior_score_home",
        "prior_score_away",
        "possession_change",
        *FLAG_NAMES,
    ]
    found = last_events_before(
        left,
        _event_columns(events),
        key="game_id",
        left_position="game_event_id",
        right_position="action_number",
        record=record,
        fill=_SCORES,
        parts=parts,
    )
    shot = {
        "clock": F.col("shot_clock"),
        "team": F.col("shooter_team_id"),
        "home": F.col("home_team_id"),
    }
    return found.select(
        "shot_id",
        "game_id",
        "game_event_id",
        "shot_seconds_remaining_period",
        F.coalesce(
            F.array_max(F.transform("events", lambda e: e["action_number"])), F.lit(-1)
        ).alias("max_prior_action"),
        F.transform("events", lambda e, i: _shot_record(e, i, shot, elapsed)).alias("seq"),
    )


def flat_sequence(seq: Column | str = "seq") -> Column:
    """5 x 29 doubles, zero-padded on the left."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    missing = (F.lit(SEQUENCE_LENGTH) - F.size(seq)) * len(EVENT_FIELDS)
    padding = F.array_repeat(F.lit(0.0), missing)
    values = F.flatten(F.transform(seq, lambda e: F.array(*[e[name] for name in EVENT_FIELDS])))
    return F.concat(padding, values)


def sequence_slots(sequences: DataFrame) -> DataFrame:
    """One row per filled slot: shot_id, slot (1 = oldest position of five), record fields."""
    return sequences.select(
        "shot_id", F.size("seq").alias("_n"), F.posexplode("seq").alias("_i", "event")
    ).select(
        "shot_id", (F.col("_i") + SEQUENCE_LENGTH - F.col("_n") + 1).alias("slot"), "event.*"
    )


def sequence_quality(sequences: DataFrame) -> DataFrame:
    """Shots, slots, padded slots and rate, and whether every prior event is really prior."""
    slots = F.count(F.lit(1)) * SEQUENCE_LENGTH
    padded = F.coalesce(F.sum(SEQUENCE_LENGTH - F.size("seq")), F.lit(0))
    strict = F.coalesce(
        F.bool_and((F.col("max_prior_action") < 0) | (F.col("max_prior_action") < F.col("game_event_id"))),
        F.lit(True),
    )
    return sequences.agg(
        F.count(F.lit(1)).alias("shots"),
        slots.alias("total_slots"),
        padded.alias("padded_slots"),
        F.coalesce(F.try_divide(padded.cast("double"), slots.cast("double")), F.lit(0.0)).alias(
            "padded_rate"
        ),
        strict.alias("leakage_check_passed"),
    )


def pressure_columns() -> dict[str, Column]:
    """Pressure expressions over ``seq`` and the shot's period clock."""
    seq = F.col("seq")

    def ages(events: Column) -> Column:
        return F.array_max(F.transform(events, lambda e: e["event_seconds_before_shot"]))

    same = F.filter(seq, lambda e: e["event_same_possession_as_shot"] == 1.0)
    age = F.coalesce(F.when(F.size(same) > 0, ages(same)).otherwise(ages(seq)), F.lit(0.0))
    late = F.least(F.greatest(age, F.lit(0.0)) / SHOT_CLOCK_SECONDS, F.lit(1.0))

    def contains(field: str) -> Column:
        return F.coalesce(F.exists(seq, lambda e: e[field] >= 1.0), F.lit(False)).cast("double")

    def total(field: str) -> Column:
        return F.aggregate(seq, F.lit(0.0), lambda acc, e: acc + e[field])

    return {
        "shot_seconds_remaining_period": F.col("shot_seconds_remaining_period"),
        "late_clock_proxy": late,
        **{name: contains(field) for name, field in SUMMARY_FLAGS.items()},
        **{name: total(field) for name, field in SUMMARY_COUNTS.items()},
    }


def pressure_features(sequences: DataFrame) -> DataFrame:
    """Shot-level pressure columns from the event arrays, keyed by shot_id."""
    return sequences.select("shot_id", *[c.alias(n) for n, c in pressure_columns().items()])


def sequence_coverage(shots: DataFrame, sequences: DataFrame) -> DataFrame:
    """Repeated shot ids in ``sequences`` and shots without a sequence; both should be 0."""
    repeated = (
        sequences.groupBy("shot_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.count_if(F.col("n") > 1).alias("count"))
        .select(F.lit("duplicate_shot_id").alias("check"), "count")
    )
    missing = (
        shots.select("shot_id")
        .join(sequences.select("shot_id"), "shot_id", "left_anti")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.lit("missing_sequence").alias("check"), "count")
    )
    return repeated.unionByName(missing)


def align_sequences(shots: DataFrame, sequences: DataFrame) -> DataFrame:
    """Shots with their sequences by key; check :func:`sequence_coverage` first."""
    return shots.join(sequences.select("shot_id", "seq", "max_prior_action"), "shot_id")


def attach_pressure(
    features: DataFrame, sequences: DataFrame, *, keep_seq: bool = False, within: str | None = None
) -> DataFrame:
    """Features with pressure columns (and the arrays themselves), in one join by shot.

    ``within`` names a column, never missing, that both sides give alike for a shot: rows that are dealt
    by it stay where they are.
    """
    keys = ["shot_id", *([within] if within else [])]
    kept = [F.col("seq")] if keep_seq else []
    columns = [c.alias(n) for n, c in pressure_columns().items()]
    return features.join(sequences.select(*keys, *kept, *columns), keys, "left")
