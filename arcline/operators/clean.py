"""Raw extracts to typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcline import schemas as S
from arcline.functions import parsing as P

from .windows import keep_first, longest_text


def rename_known(raw: DataFrame, names: dict[str, str]) -> DataFrame:
    """Keep mapped columns only, under their table names; absent ones are skipped."""
    return raw.select(*[F.col(a).alias(b) for a, b in names.items() if a in raw.columns])


def require_complete(df: DataFrame, columns: list[str] | tuple[str, ...]) -> DataFrame:
    return df.na.drop(subset=[c for c in columns if c in df.columns])


def require_positive(df: DataFrame, *columns: str) -> DataFrame:
    for column in columns:
        if column in df.columns:
            df = df.where(F.col(column) > 0)
    return df


def evaluate_once(df: DataFrame) -> DataFrame:
    """Keep later filters from repeating the parsing expressions.

    A filter above a projection is rewritten in terms of the projection's inputs, which
    doubles every parse and makes one generated method too large to compile. Passing the
    row through a one-element ``inline`` keeps the filter on the parsed values.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def in_schema(df: DataFrame, schema) -> DataFrame:
    """Columns of ``schema`` in order and type; absent ones become NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def column_formats(raw: DataFrame, *, minutes: str | None = None, date: str | None = None) -> dict[str, str]:
    """Decide number-or-clock and compact-or-ISO once per column, in one pass.

    Minutes are numbers when more than half of the rows parse as numbers; dates are compact
    when any row is eight digits. Values in the other format then become NULL.
    """
    measures = []
    if minutes:
        share = F.avg(F.when(P.number(F.col(minutes).cast("string")).isNotNull(), 1.0).otherwise(0.0))
        measures.append(share.alias("minutes"))
    if date:
        eight = F.col(date).cast("string").rlike(r"^\d{8}$")
        measures.append(F.bool_or(F.coalesce(eight, F.lit(False))).alias("date"))
    row = raw.agg(*measures).first() if measures else None
    formats = {}
    if minutes:
        formats["minutes"] = "number" if (row["minutes"] or 0) > 0.5 else "clock"
    if date:
        formats["date"] = "compact" if row["date"] else "iso"
    return formats


def clean_shots(raw: DataFrame, *, date_format: str = "row", first_by: list[Column | str] | None = None) -> DataFrame:
    df = rename_known(raw, S.SHOT_NAMES)
    whole = [f.name for f in S.SHOTS.fields if f.dataType.typeName() == "long"]
    df = df.withColumns(
        {
            "game_id": P.padded_game_id("game_id"),
            "game_date": P.game_date("game_date", date_format),
            "shot_made_flag": P.flag("shot_made_flag"),
            **{c: P.integer(c) for c in whole if c in df.columns},
        }
    )
    if "shot_attempted_flag" in df.columns:
        attempted = F.coalesce(P.flag("shot_attempted_flag"), F.lit(True))
        df = df.withColumn("shot_attempted_flag", attempted)
    required = (
        *S.NATURAL_KEYS["shots"],
        "team_id",
        "period",
        "minutes_remaining",
        "seconds_remaining",
        "shot_made_flag",
        "game_date",
    )
    df = require_positive(require_complete(evaluate_once(df), required), "player_id")
    return keep_first(in_schema(df, S.SHOTS), list(S.NATURAL_KEYS["shots"]), first_by)


def clean_game_logs(
    raw: DataFrame,
    *,
    players: bool,
    minutes_format: str = "row",
    date_format: str = "row",
    first_by: list[Column | str] | None = None,
) -> DataFrame:
    names, schema, table = (
        (S.PLAYER_LOG_NAMES, S.PLAYER_GAME_LOGS, "player_game_logs")
        if players
        else (S.TEAM_LOG_NAMES, S.TEAM_GAME_LOGS, "team_game_logs")
    )
    df = rename_known(raw, names)
    changes = {
        "season_year": F.col("season_year").cast("string"),
        "game_id": P.padded_game_id("game_id"),
        "game_date": P.game_date("game_date", date_format),
        "matchup": F.trim(F.col("matchup").cast("string")),
        "win_loss": P.upper_text("win_loss"),
        "minutes": P.minutes("minutes", minutes_format),
        **{c: P.integer(c) for c in ("player_id", "team_id", *S.BOX_SCORE_COUNTS)},
        **{c: P.ratio3(c) for c in S.BOX_SCORE_RATIOS},
    }
    df = df.withColumns({name: value for name, value in changes.items() if name in df.columns})
    required = ("season_year", "game_id", "game_date", "matchup", "win_loss", "team_id")
    df = require_complete(evaluate_once(df), (*required, *S.NATURAL_KEYS[table]))
    df = df.where(F.col("win_loss").isin("W", "L"))
    df = require_positive(df, "team_id", *(["player_id"] if players else []))
    return keep_first(in_schema(df, schema), list(S.NATURAL_KEYS[table]), first_by)


def clean_events(raw: DataFrame, *, first_by: list[Column | str] | None = None) -> DataFrame:
    df = rename_known(raw, S.EVENT_NAMES)
    whole = [
        f.name
        for f in S.PLAY_BY_PLAY.fields
        if f.dataType.typeName() == "long" and f.name not in ("person_id", "team_id")
    ]
    changes = {
        "game_id": P.padded_game_id("game_id"),
        "game_clock": F.trim(F.col("game_clock").cast("string")),
        "person_id": P.positive_id("person_id"),
        "team_id": P.positive_id("team_id"),
        "is_field_goal": P.flag("is_field_goal"),
        "video_available": P.flag("video_available"),
        "player_name": P.clean_text("player_name"),
        **{c: P.integer(c) for c in whole},
    }
    df = df.withColumns({name: value for name, value in changes.items() if name in df.columns})
    keys = S.NATURAL_KEYS["play_by_play"]
    df = require_complete(evaluate_once(df), (*keys, "period", "game_clock"))
    return keep_first(in_schema(df, S.PLAY_BY_PLAY), list(keys), first_by)


def team_dimension(raw: DataFrame) -> DataFrame:
    df = rename_known(raw, S.TEAM_NAMES)
    df = df.withColumns(
        {c: P.integer(c) for c in ("team_id", "year_founded") if c in df.columns}
    )
    return in_schema(df, S.TEAMS)


def union_names(*sources: DataFrame) -> DataFrame:
    """(player_id, full_name) pairs of several sources with the source position."""
    tagged = [
        df.select("player_id", "full_name", F.lit(position).alias("source"))
        for position, df in enumerate(sources)
    ]
    result = tagged[0]
    for other in tagged[1:]:
        result = result.unionByName(other)
    return result


def player_dimension(*raw_sources: DataFrame) -> DataFrame:
    """One row per player: the longest name seen, split into first and last."""
    named = [
        raw.select(P.positive_id("PLAYER_ID").alias("player_id"), P.clean_text("PLAYER_NAME", ("", "nan")).alias("full_name"))
        for raw in raw_sources
        if {"PLAYER_ID", "PLAYER_NAME"} <= set(raw.columns)
    ]
    names = union_names(*named).na.drop(subset=["player_id", "full_name"])
    best = longest_text(names, "player_id", "full_name", "source")
    first, last = P.name_parts("full_name")
    return best.select(
        "player_id",
        "full_name",
        first.alias("first_name"),
        last.alias("last_name"),
        F.lit(True).alias("is_active"),
    )


def parse_matchups(
    logs: DataFrame, teams: DataFrame, *, text: str = "matchup", tricode: str = "team_abbreviation"
) -> DataFrame:
    """Add row_team_id, opponent_team_id, home/away ids and ``matchup_error``.

    A malformed text, a tricode that is not the row's own and an unknown team each give an
    error label instead of failing the job.
    """
    # Two narrow columns of a team dimension; Spark broadcasts them when its size check allows.
    codes = teams.select(F.upper("abbreviation").alias("_code"), F.col("team_id").alias("_id"))
    parsed = evaluate_once(logs.withColumn("_m", P.matchup(text)))
    parsed = parsed.join(
        codes.withColumnsRenamed({"_code": "_own", "_id": "row_team_id"}),
        F.col("_m.team") == F.col("_own"),
        "left",
    ).join(
        codes.withColumnsRenamed({"_code": "_other", "_id": "opponent_team_id"}),
        F.col("_m.opponent") == F.col("_other"),
        "left",
    )
    error = (
        F.when(F.col("_m").isNull(), "unrecognized format")
        .when(F.col("_m.team") != F.upper(F.col(tricode)), "team differs from row")
        .when(F.col("row_team_id").isNull() | F.col("opponent_team_id").isNull(), "unknown team")
    )
    at_home = F.col("_m.at_home")
    return (
        parsed.withColumn("matchup_error", error)
        .withColumn("at_home", at_home)
        .withColumn("home_team_id", F.when(at_home, F.col("row_team_id")).otherwise(F.col("opponent_team_id")))
        .withColumn("away_team_id", F.when(at_home, F.col("opponent_team_id")).otherwise(F.col("row_team_id")))
        .drop("_m", "_own", "_other")
    )


def resolve_home_away(
    parsed: DataFrame, chart_pairs: DataFrame | None = None, *, game: str = "game_id"
) -> DataFrame:
    """Per game the home and away team, or a reason why they are unknown.

    All rows agree, else the single home row, else the pair drawn on the shot chart
    (``chart_pairs``: game, chart_home_id, chart_away_id). Aggregates only, so a game with
    many rows is reduced before the shuffle.
    """
    good = F.col("matchup_error").isNull()
    pair = F.struct("home_team_id", "away_team_id")
    per_game = parsed.groupBy(game).agg(
        F.min(F.when(good, pair)).alias("_low"),
        F.max(F.when(good, pair)).alias("_high"),
        F.count_if(F.col("at_home")).alias("_home_rows"),
        F.min(F.when(good & F.col("at_home"), pair)).alias("_home_pair"),
        F.min("matchup_error").alias("_error"),
    )
    if chart_pairs is None:
        per_game = per_game.withColumn("_chart", F.lit(None).cast("struct<home_team_id:bigint,away_team_id:bigint>"))
    else:
        charted = chart_pairs.groupBy(game).agg(
            F.min(
                F.struct(
                    F.col("chart_home_id").alias("home_team_id"),
                    F.col("chart_away_id").alias("away_team_id"),
                )
            ).alias("_chart")
        )
        per_game = per_game.join(charted, game, "left")
    choice = (
        F.when(F.col("_error").isNotNull(), None)
        .when(F.col("_low") == F.col("_high"), F.col("_low"))
        .when((F.col("_home_rows") == 1) & F.col("_home_pair").isNotNull(), F.col("_home_pair"))
        .otherwise(F.col("_chart"))
    )
    return per_game.withColumn("_pair", choice).select(
        game,
        F.col("_pair.home_team_id").alias("home_team_id"),
        F.col("_pair.away_team_id").alias("away_team_id"),
        F.when(F.col("_error").isNotNull(), F.col("_error"))
        .when(F.col("_pair").isNull(), F.lit("rows disagree and no chart pair"))
        .alias("reason"),
    )


def game_dimension(
    team_logs: DataFrame,
    teams: DataFrame,
    *,
    shots: DataFrame | None = None,
    season_type: str = "Regular Season",
) -> tuple[DataFrame, DataFrame]:
    """(games, unresolved games with reasons) from raw team logs."""
    if not {"GAME_ID", "SEASON_YEAR", "GAME_DATE", "MATCHUP"} <= set(team_logs.columns):
        raise ValueError("team logs need GAME_ID, SEASON_YEAR, GAME_DATE and MATCHUP")
    own = teams.select("team_id", F.upper("abbreviation").alias("team_abbreviation"))
    if "TEAM_ABBREVIATION" in team_logs.columns:
        logs = team_logs.withColumn("team_abbreviation", F.upper("TEAM_ABBREVIATION"))
    elif "TEAM_ID" in team_logs.columns:
        logs = team_logs.withColumn("team_id", P.integer("TEAM_ID")).join(own, "team_id", "left")
    else:
        raise ValueError("team logs need TEAM_ABBREVIATION or TEAM_ID")
    logs = logs.select(
        P.padded_game_id("GAME_ID").alias("game_id"),
        F.col("SEASON_YEAR").cast("string").alias("season"),
        P.game_date("GAME_DATE").alias("game_date"),
        F.col("MATCHUP").alias("matchup"),
        "team_abbreviation",
    ).na.drop(subset=["game_id", "game_date", "matchup", "team_abbreviation"])
    pairs = None
    if shots is not None and {"HTM", "VTM"} <= set(shots.columns):
        codes = teams.select(F.upper("abbreviation").alias("_code"), "team_id")
        pairs = (
            shots.select(P.padded_game_id("GAME_ID").alias("game_id"), F.upper("HTM").alias("_h"), F.upper("VTM").alias("_v"))
            .distinct()
            .join(codes.withColumnsRenamed({"_code": "_h", "team_id": "chart_home_id"}), "_h")
            .join(codes.withColumnsRenamed({"_code": "_v", "team_id": "chart_away_id"}), "_v")
        )
    sides = resolve_home_away(parse_matchups(logs, teams), pairs)
    head = logs.groupBy("game_id").agg(F.min(F.struct("game_date", "season")).alias("_head"))
    games = sides.where(F.col("reason").isNull()).join(head, "game_id")
    games = games.select(
        "game_id",
        F.col("_head.season").alias("season"),
        F.lit(season_type).alias("season_type"),
        F.col("_head.game_date").alias("game_date"),
        "home_team_id",
        "away_team_id",
    )
    unresolved = sides.where(F.col("reason").isNotNull()).select("game_id", "reason")
    return games, unresolved


def distinct_game_ids(raw: DataFrame, column: str = "GAME_ID") -> DataFrame:
    ids = raw.select(P.padded_game_id(column).alias("game_id")).na.drop()
    return ids.distinct().orderBy("game_id")


def union_extracts(
    parts: list[DataFrame], keys: list[str], first_by: list[Column | str] | None = None
) -> DataFrame:
    """Several extracts as one: columns matched by name, one row per natural key."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return keep_first(whole, keys, first_by)
