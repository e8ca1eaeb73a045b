"""Recent-form features: the previous games of a player, a team, or a team's opponents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arcline.functions.shots import possessions

from .skew import Slices, plan_slices
from .windows import keep_first, shift_roll

# Feature suffix -> ratio (numerator, denominator) or mean of one column.
PLAYER_RATIOS = {
    "player_recent_fg_pct_5": ("field_goals_made", "field_goals_attempted"),
    "player_recent_fg3_pct_5": ("three_pointers_made", "three_pointers_attempted"),
}
PLAYER_MEANS = {
    "player_recent_fga_5": "field_goals_attempted",
    "player_recent_fg3a_5": "three_pointers_attempted",
    "player_recent_minutes_5": "minutes",
    "player_recent_points_5": "points",
}
TEAM_RATIOS = {
    "team_recent_off_eff_proxy_5": ("points", "possessions"),
    "team_recent_fg_pct_5": ("field_goals_made", "field_goals_attempted"),
    "team_recent_three_point_rate_5": ("three_pointers_attempted", "field_goals_attempted"),
}
TEAM_MEANS = {
    "team_recent_pace_proxy_5": "possessions",
    "team_recent_fga_5": "field_goals_attempted",
    "team_recent_points_5": "points",
    "team_recent_turnovers_5": "turnovers",
}
OPPONENT_RATIOS = {
    "opp_recent_fg_pct_allowed_5": ("field_goals_made", "field_goals_attempted"),
    "opp_recent_three_point_rate_allowed_5": (
        "three_pointers_attempted",
        "field_goals_attempted",
    ),
}
OPPONENT_MEANS = {
    "opp_recent_points_allowed_5": "points",
    "opp_recent_pace_proxy_5": "possessions",
    "opp_recent_fga_allowed_5": "field_goals_attempted",
}
ALLOWED_MEASURES = (
    "field_goals_made",
    "field_goals_attempted",
    "three_pointers_attempted",
    "free_throws_attempted",
    "offensive_rebounds",
    "turnovers",
    "points",
)


def _used_columns(ratios: dict[str, tuple[str, str]], means: dict[str, str]) -> list[str]:
    return sorted({c for pair in ratios.values() for c in pair} | set(means.values()))


def recent_form(
    logs: DataFrame,
    entity: str,
    ratios: dict[str, tuple[str, str]],
    means: dict[str, str],
    *,
    game: str = "game_id",
    date: str = "game_date",
    window: int = 5,
    unique_key: bool = False,
    slices: Slices | None = None,
    new: str | None = None,
) -> DataFrame:
    """One row per (game, entity) with form over the ``window`` games before it.

    Ratios are sums over sums, NULL when the denominator is missing or not positive. ``new`` names
    a flag of ``logs``: rows without it are looked back on but give no row of their own.
    ``unique_key=True`` states that the log has one row per (game, entity), as cleaned logs
    do; otherwise a repeated key keeps its earliest row.
    """
    used = _used_columns(ratios, means)
    sums = {f"_sum_{c}": ("sum", c) for pair in ratios.values() for c in pair}
    averages = {name: ("avg", column) for name, column in means.items()}
    rolled = shift_roll(
        logs.select(game, entity, date, *used, *([new] if new else [])),
        [entity],
        [date, game],
        {**sums, **averages},
        window=window,
        slices=slices,
    )
    if new is not None:
        rolled = rolled.where(F.col(new))
    ratio_columns = [
        F.when(F.col(f"_sum_{bottom}") > 0, F.col(f"_sum_{top}") / F.col(f"_sum_{bottom}")).alias(name)
        for name, (top, bottom) in ratios.items()
    ]
    form = rolled.select(game, entity, date, *ratio_columns, *means)
    if not unique_key:
        form = keep_first(form, [game, entity], [date])
    return form.drop(date)


def player_form(logs: DataFrame, **options) -> DataFrame:
    return recent_form(logs, "player_id", PLAYER_RATIOS, PLAYER_MEANS, **options)


def with_possessions(logs: DataFrame) -> DataFrame:
    return logs.withColumn(
        "possessions",
        possessions(
            "field_goals_attempted", "free_throws_attempted", "turnovers", "offensive_rebounds"
        ),
    )


def player_slices(logs: DataFrame) -> Slices:
    return plan_slices(logs, ["player_id"], ["game_date", "game_id"])


def team_slices(logs: DataFrame) -> Slices:
    """Slicing plan that team and opponent form share."""
    return plan_slices(logs, ["team_id"], ["game_date", "game_id"])


def team_form(logs: DataFrame, **options) -> DataFrame:
    return recent_form(with_possessions(logs), "team_id", TEAM_RATIOS, TEAM_MEANS, **options)


def opponent_allowed(
    logs: DataFrame,
    measures: tuple[str, ...] = ALLOWED_MEASURES,
    *,
    game: str = "game_id",
    team: str = "team_id",
    date: str = "game_date",
) -> DataFrame:
    """Per (game, team): what the other side of the game produced.

    Game totals minus all rows of the team in that game, over two windows of the game: rows are
    dealt once by game and nothing is joined. With two teams per game this is the opponent's row.
    A team that a game lists twice gives two result rows, neither counting the other. Teams alone
    in a game have no opponent and drop out, as in an inner join.
    """
    whole, side = W.partitionBy(game), W.partitionBy(game, team)
    named = F.count(team).over(whole)
    several = (F.min(team).over(whole) < F.max(team).over(whole)) | (
        (named > 0) & (named < F.count(F.lit(1)).over(whole))
    )
    rows = logs.where(F.col(game).isNotNull()).select(
        game,
        team,
        date,
        several.alias("_several"),
        *[F.sum(c).over(whole).alias(f"_sum_{c}") for c in measures],
        *[F.count(c).over(whole).alias(f"_known_{c}") for c in measures],
        *[F.sum(c).over(side).alias(f"_own_{c}") for c in measures],
        *[F.count(c).over(side).alias(f"_mine_{c}") for c in measures],
    )
    others = [
        F.when(
            F.col(f"_known_{c}") > F.col(f"_mine_{c}"),
            F.col(f"_sum_{c}") - F.coalesce(F.col(f"_own_{c}"), F.lit(0)),
        ).alias(c)
        for c in measures
    ]
    return rows.where(F.col("_several")).select(game, team, date, *others)


def opponent_form(logs: DataFrame, **options) -> DataFrame:
    allowed = with_possessions(opponent_allowed(logs))
    # One row per log row at most, so the log itself tells which teams are large.
    options["slices"] = options.get("slices") or team_slices(logs)
    return recent_form(allowed, "team_id", OPPONENT_RATIOS, OPPONENT_MEANS, **options)


# Kind of form -> its entity, ratios and means.
FORM_KINDS = {
    "player": ("player_id", PLAYER_RATIOS, PLAYER_MEANS),
    "team": ("team_id", TEAM_RATIOS, TEAM_MEANS),
    "opponent": ("team_id", OPPONENT_RATIOS, OPPONENT_MEANS),
}


def form_rows(kind: str, logs: DataFrame) -> DataFrame:
    """The rows that a kind of form rolls over: keys, date and the measures it uses."""
    entity, ratios, means = FORM_KINDS[kind]
    if kind == "opponent":
        logs = opponent_allowed(logs)
    if kind != "player":
        logs = with_possessions(logs)
    return logs.select("game_id", entity, "game_date", *_used_columns(ratios, means))


def form_state(
    kind: str, logs: DataFrame, state: DataFrame | None = None, *, window: int = 5
) -> DataFrame:
    """What later games need to know: the last ``window`` rows of every entity.

    ``state`` is that of the games before ``logs``. Ranks are cut per task before the shuffle, so
    a state of few rows per entity stands for all history.
    """
    rows = form_rows(kind, logs)
    if state is not None:
        rows = rows.unionByName(state)
    latest = W.partitionBy(FORM_KINDS[kind][0]).orderBy(F.desc("game_date"), F.desc("game_id"))
    ranked = rows.withColumn("_rank", F.row_number().over(latest))
    return ranked.where(F.col("_rank") <= window).drop("_rank")


def form_since(
    kind: str, logs: DataFrame, state: DataFrame | None = None, **options
) -> DataFrame:
    """Form of the games of ``logs``, looking back into ``state`` instead of older logs.

    Equal to the rows of the same games in the form over all logs, if the games of ``logs`` come
    after those of the state and have dates. All rows of a game must be in the same logs.
    """
    entity, ratios, means = FORM_KINDS[kind]
    rows = form_rows(kind, logs).withColumn("_new", F.lit(True))
    if state is not None:
        rows = rows.unionByName(state.withColumn("_new", F.lit(False)))
    return recent_form(rows, entity, ratios, means, new="_new", **options)


def attach_form(
    shots: DataFrame, form: DataFrame, on: dict[str, str], *, check_unique: bool = True
) -> DataFrame:
    """Left join ``form`` on {shot column: form column}; right keys must be unique.

    With ``check_unique`` a repeated right key fails the query instead of multiplying rows.
    """
    right_keys = list(on.values())
    if check_unique:
        values = [c for c in form.columns if c not in right_keys]
        message = F.lit("repeated key on the right side of an m:1 join")
        form = (
            form.groupBy(*right_keys)
            .agg(
                F.count(F.lit(1)).alias("_n"),
                *[F.first(c).alias(c) for c in values],
            )
            .withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(message)).otherwise(F.col("_n")))
            .where(F.col("_n").isNotNull())
            .drop("_n")
        )
    renamed = form
    for left, right in on.items():
        if left != right:
            renamed = renamed.withColumnRenamed(right, left)
    return shots.join(renamed, list(on), "left")
