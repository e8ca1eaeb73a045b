"""Cleaning, shot features, recent form, margins, sequences and splits."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from arcline.functions import events as E
from arcline.functions import labels as L
from arcline.functions import parsing as P
from arcline.functions import shots as X
from arcline.functions.spatial import spatial_encodings
from arcline.functions.value import value_columns
from arcline.operators import clean as C
from arcline.operators import form as R
from arcline.operators import sequences as Q
from arcline.operators import split as D
from arcline.operators.margin import attach_margin, prior_scores, without_margin
from arcline.operators.windows import fill_then_lag, number_rows, shift_roll
from arcline.plans.gold import base_features, gold_features, versioned
from arcline.session import checkpoint_dir

from .registry import day, n, query, r

# --- cleaning ------------------------------------------------------------------------------


@query(
    "clean_shots",
    ("v_raw_shots",),
    f"""
    with typed as (
      select case when length(GAME_ID) >= 10 then GAME_ID else lpad(GAME_ID, 10, '0') end as game_id,
             {n('try_cast(GAME_EVENT_ID as double)')} as game_event_id, {n('PLAYER_ID')} as player_id,
             {n('TEAM_ID')} as team_id, {n('PERIOD')} as period, try_cast(MINUTES_REMAINING as bigint) as minutes_remaining,
             {n('SECONDS_REMAINING')} as seconds_remaining, EVENT_TYPE as event_type, ACTION_TYPE as action_type,
             SHOT_TYPE as shot_type, SHOT_ZONE_BASIC as shot_zone_basic, SHOT_ZONE_AREA as shot_zone_area,
             SHOT_ZONE_RANGE as shot_zone_range, {n('SHOT_DISTANCE')} as shot_distance, {n('LOC_X')} as loc_x,
             {n('LOC_Y')} as loc_y, coalesce(SHOT_ATTEMPTED_FLAG, '1') = '1' as shot_attempted_flag,
             SHOT_MADE_FLAG = '1' as shot_made_flag,
             case when GAME_DATE like '%-%' then cast(GAME_DATE as date) else strptime(GAME_DATE, '%Y%m%d')::date end as game_date,
             HTM as home_team_abbreviation, VTM as away_team_abbreviation
      from v_raw_shots),
    kept as (select *, row_number() over (partition by game_id, game_event_id, player_id
                order by team_id, period, minutes_remaining, seconds_remaining, event_type, action_type, shot_type,
                         shot_zone_basic, shot_zone_area, shot_zone_range, shot_distance, loc_x, loc_y,
                         shot_attempted_flag, shot_made_flag, game_date) as pick
             from typed where minutes_remaining is not null and player_id > 0)
    select game_id, game_event_id, player_id, team_id, period, minutes_remaining, seconds_remaining, event_type,
           action_type, shot_type, shot_zone_basic, shot_zone_area, shot_zone_range, shot_distance, loc_x, loc_y,
           cast(shot_attempted_flag as int) as shot_attempted_flag, cast(shot_made_flag as int) as shot_made_flag,
           cast(game_date as string) as game_date, home_team_abbreviation, away_team_abbreviation
    from kept where pick = 1""",
)
def clean_shots(t):
    return C.clean_shots(t["v_raw_shots"])


@query(
    "clean_player_logs",
    ("v_raw_logs",),
    f"""select SEASON_YEAR as season_year, lpad(GAME_ID, 10, '0') as game_id, {n('PLAYER_ID')} as player_id,
           {n('TEAM_ID')} as team_id, GAME_DATE as game_date, trim(MATCHUP) as matchup, upper(trim(WL)) as win_loss,
           {r('''round(coalesce(try_cast(MIN as double), try_cast(split_part(MIN, ':', 1) as double)
                + try_cast(nullif(split_part(MIN, ':', 2), '') as double) / 60), 1)''')} as minutes,
           {n('FGM')} as field_goals_made, {n('cast(FGA as double)')} as field_goals_attempted,
           {r('round(cast(FG_PCT as double), 3)')} as field_goal_pct, {n('PTS')} as points
        from v_raw_logs where upper(trim(WL)) in ('W', 'L') and cast(PLAYER_ID as bigint) > 0""",
)
def clean_player_logs(t):
    logs = C.clean_game_logs(t["v_raw_logs"], players=True)
    return logs.select(
        "season_year", "game_id", "player_id", "team_id", "game_date", "matchup", "win_loss",
        "minutes", "field_goals_made", "field_goals_attempted", "field_goal_pct", "points",
    )


@query(
    "clean_events",
    ("v_raw_events",),
    f"""
    with typed as (
      select lpad(gameId, 10, '0') as game_id, {n('cast(actionNumber as double)')} as action_number,
             {n('actionId')} as action_id, trim(clock) as game_clock, {n('period')} as period,
             case when cast(teamId as bigint) > 0 then cast(teamId as bigint) end as team_id,
             case when cast(personId as bigint) > 0 then cast(personId as bigint) end as person_id,
             case when trim(playerName) not in ('', 'nan', 'None') then trim(playerName) end as player_name,
             cast(isFieldGoal = '1' as int) as is_field_goal, try_cast(scoreHome as bigint) as score_home,
             description, actionType as action_type
      from v_raw_events),
    kept as (select *, row_number() over (partition by game_id, action_number order by action_id) as pick from typed)
    select * exclude (pick) from kept where pick = 1""",
)
def clean_events(t):
    events = C.clean_events(t["v_raw_events"])
    return events.select(
        "game_id", "action_number", "action_id", "game_clock", "period", "team_id", "person_id",
        "player_name", "is_field_goal", "score_home", "description", "action_type",
    )


@query(
    "player_dimension",
    ("v_raw_shots", "v_raw_logs"),
    f"""
    with names as (
      select {n('PLAYER_ID')} as player_id, trim(PLAYER_NAME) as full_name, 0 as source from v_raw_shots
      union all select {n('PLAYER_ID')}, trim(PLAYER_NAME), 1 from v_raw_logs),
    kept as (select *, row_number() over (partition by player_id order by length(full_name) desc, source, full_name) as pick
             from names where player_id > 0 and full_name not in ('', 'nan'))
    select player_id, full_name, split_part(full_name, ' ', 1) as first_name,
           nullif(substr(full_name, length(split_part(full_name, ' ', 1)) + 2), '') as last_name, 1 as is_active
    from kept where pick = 1""",
)
def player_dimension(t):
    return C.player_dimension(t["v_raw_shots"], t["v_raw_logs"])


@query(
    "team_dimension",
    (),
    "select s_suppkey as team_id, right(s_name, 3) as abbreviation, s_name as full_name from supplier",
)
def team_dimension(t):
    raw = t["supplier"].select(
        F.col("s_suppkey").cast("string").alias("id"),
        F.right("s_name", F.lit(3)).alias("abbreviation"),
        F.col("s_name").alias("full_name"),
    )
    return C.team_dimension(raw).select("team_id", "abbreviation", "full_name")


_PARSED_MATCHUPS = """
    parts as (
      select lpad(GAME_ID, 10, '0') as game_id, GAME_DATE as game_date, SEASON_YEAR as season, upper(TEAM_ABBREVIATION) as tricode,
             regexp_extract(trim(MATCHUP), '^([A-Za-z]{2,3})\\s+(vs\\.?|@)\\s+([A-Za-z]{2,3})$', 1) as team,
             regexp_extract(trim(MATCHUP), '^([A-Za-z]{2,3})\\s+(vs\\.?|@)\\s+([A-Za-z]{2,3})$', 2) as sep,
             regexp_extract(trim(MATCHUP), '^([A-Za-z]{2,3})\\s+(vs\\.?|@)\\s+([A-Za-z]{2,3})$', 3) as other
      from v_raw_team_logs),
    looked as (
      select p.*, a.team_id as own_id, b.team_id as other_id, p.sep like 'vs%' as at_home,
             case when p.team = '' then 'unrecognized format'
                  when upper(p.team) <> p.tricode then 'team differs from row'
                  when a.team_id is null or b.team_id is null then 'unknown team' end as error
      from parts p left join v_letters a on a.abbreviation = upper(p.team)
                   left join v_letters b on b.abbreviation = upper(p.other)),
    sided as (select *, case when at_home then own_id else other_id end as home_id,
                     case when at_home then other_id else own_id end as away_id from looked),
    games as (
      select game_id, min(game_date) as game_date, min(season) as season, min(error) as error,
             count(distinct home_id * 1000 + away_id) as pairs, min(home_id) as any_home, min(away_id) as any_away,
             sum(case when error is null and at_home then 1 else 0 end) as home_rows,
             min(case when at_home then home_id end) as row_home, min(case when at_home then away_id end) as row_away
      from sided group by game_id),
    resolved as (
      select *, case when error is not null then error
                     when pairs = 1 or home_rows = 1 then null
                     else 'rows disagree and no chart pair' end as reason,
             case when pairs = 1 then any_home else row_home end as home_team_id,
             case when pairs = 1 then any_away else row_away end as away_team_id
      from games)"""


@query(
    "game_dimension",
    ("v_raw_team_logs", "v_letters"),
    f"""with {_PARSED_MATCHUPS}
    select game_id, season, 'Regular Season' as season_type, game_date, home_team_id, away_team_id
    from resolved where reason is null""",
)
def game_dimension(t):
    return C.game_dimension(t["v_raw_team_logs"], t["v_letters"])[0]


@query(
    "game_dimension_unresolved",
    ("v_raw_team_logs", "v_letters"),
    f"with {_PARSED_MATCHUPS} select game_id, reason from resolved where reason is not null",
)
def game_dimension_unresolved(t):
    return C.game_dimension(t["v_raw_team_logs"], t["v_letters"])[1]


@query(
    "matchup_parse",
    ("v_raw_team_logs", "v_letters"),
    f"""with {_PARSED_MATCHUPS}
    select game_id, tricode as team_abbreviation, own_id as row_team_id, other_id as opponent_team_id,
           cast(case when team = '' then null else at_home end as int) as at_home, error as matchup_error from looked""",
)
def matchup_parse(t):
    logs = t["v_raw_team_logs"].select(
        P.padded_game_id("GAME_ID").alias("game_id"),
        F.upper("TEAM_ABBREVIATION").alias("team_abbreviation"),
        F.col("MATCHUP").alias("matchup"),
    )
    parsed = C.parse_matchups(logs, t["v_letters"])
    return parsed.select(
        "game_id", "team_abbreviation", "row_team_id", "opponent_team_id", "at_home", "matchup_error"
    )


@query(
    "value_parsing",
    ("v_raw_logs",),
    f"""select GAME_ID as id, lpad(GAME_ID, 10, '0') as padded,
           {r('''round(coalesce(try_cast(MIN as double), try_cast(split_part(MIN, ':', 1) as double)
               + try_cast(nullif(split_part(MIN, ':', 2), '') as double) / 60), 1)''')} as minutes,
           GAME_DATE as day_iso, GAME_DATE as day_compact, split_part(PLAYER_NAME, ' ', 1) as first_name,
           substr(PLAYER_NAME, length(split_part(PLAYER_NAME, ' ', 1)) + 2) as last_name,
           {n('cast(FGA as double)')} as attempts, {n('nullif(try_cast(FGM as bigint), 0)')} as positive,
           cast(cast(PTS as double) <> 0 as int) as flag
        from v_raw_logs""",
)
def value_parsing(t):
    first, last = P.name_parts("PLAYER_NAME")
    return t["v_raw_logs"].select(
        F.col("GAME_ID").alias("id"),
        P.padded_game_id("GAME_ID").alias("padded"),
        P.minutes("MIN").alias("minutes"),
        P.game_date("GAME_DATE").alias("day_iso"),
        P.game_date(F.replace("GAME_DATE", F.lit("-"))).alias("day_compact"),
        first.alias("first_name"),
        last.alias("last_name"),
        P.integer("FGA").alias("attempts"),
        P.positive_id("FGM").alias("positive"),
        P.flag("PTS").alias("flag"),
    )


@query(
    "distinct_game_ids",
    (),
    "select distinct lpad(cast(l_orderkey as string), 10, '0') as game_id from lineitem",
)
def distinct_game_ids(t):
    return C.distinct_game_ids(t["lineitem"], "l_orderkey")


@query(
    "shot_ids",
    ("v_shots",),
    f"""select shot_id, {n('row_number() over (order by game_id, game_event_id, player_id, shot_id)')} as row_id
        from v_shots""",
)
def shot_ids(t):
    shots = t["v_shots"].select("shot_id", "game_id", "game_event_id", "player_id")
    numbered = number_rows(shots, "game_id", ["game_event_id", "player_id", "shot_id"])
    return numbered.select("shot_id", "row_id")


# --- shot features -------------------------------------------------------------------------

_BASE_SQL = f"""select shot_id, game_id, {n('game_event_id')} as game_event_id, player_id, team_id,
      case when team_id = home_team_id then away_team_id else home_team_id end as opponent_team_id,
      season, game_date, shot_made_flag, case when shot_type = '3PT Field Goal' then 3 else 2 end as shot_value,
      shot_distance, loc_x, loc_y, abs(loc_x) as abs_loc_x, atan2(loc_x, loc_y) as shot_angle,
      case when shot_zone_basic is not null then shot_zone_basic in ('Left Corner 3', 'Right Corner 3')
           else shot_type = '3PT Field Goal' and abs(loc_x) >= 220 and loc_y <= 92.5 end as is_corner_three,
      team_id = home_team_id as is_home, {n('period')} as period,
      minutes_remaining * 60 + seconds_remaining as seconds_remaining_period,
      case when period <= 4 then (4 - period) * 720 else 0 end + minutes_remaining * 60 + seconds_remaining as seconds_remaining_game,
      shot_zone_basic, shot_zone_area, shot_zone_range from v_shots"""


@query(
    "base_features",
    ("v_shots",),
    f"""select * replace (cast(game_date as string) as game_date, cast(shot_made_flag as int) as shot_made_flag,
           {r('shot_angle')} as shot_angle, cast(is_corner_three as int) as is_corner_three,
           cast(is_home as int) as is_home, {r('seconds_remaining_period')} as seconds_remaining_period,
           {r('seconds_remaining_game')} as seconds_remaining_game) from ({_BASE_SQL})""",
)
def base_shot_features(t):
    return base_features(t["v_shots"])


@query(
    "spatial_encodings",
    ("v_shots",),
    f"""select shot_id, {r('loc_x / 300')} as loc_x_scaled, {r('loc_y / 470')} as loc_y_scaled,
        {r('loc_x * loc_x')} as loc_x_squared, {r('loc_y * loc_y')} as loc_y_squared, {r('loc_x * loc_y')} as xy_interaction,
        {r('shot_distance * shot_distance')} as distance_squared, {r('sin(atan2(loc_x, loc_y))')} as sin_shot_angle,
        {r('cos(atan2(loc_x, loc_y))')} as cos_shot_angle, {r('loc_x < -50')} as is_left_side, {r('loc_x > 50')} as is_right_side,
        {r('abs(loc_x) <= 50')} as is_center, {r('sqrt(loc_x ** 2 + loc_y ** 2)')} as dist_to_rim,
        {r('sqrt((loc_x + 220) ** 2 + (loc_y - 92.5) ** 2)')} as dist_to_left_corner,
        {r('sqrt((loc_x - 220) ** 2 + (loc_y - 92.5) ** 2)')} as dist_to_right_corner,
        {r('sqrt(loc_x ** 2 + (loc_y - 280) ** 2)')} as dist_to_top_key,
        {r('sqrt((loc_x + 220) ** 2 + (loc_y - 280) ** 2)')} as dist_to_left_wing,
        {r('sqrt((loc_x - 220) ** 2 + (loc_y - 280) ** 2)')} as dist_to_right_wing,
        {r('sqrt(loc_x ** 2 + (loc_y - 95) ** 2)')} as dist_to_paint_center from v_shots""",
)
def spatial(t):
    angled = t["v_shots"].withColumn("shot_angle", X.chart_angle("loc_x", "loc_y"))
    return angled.select("shot_id", *[c.alias(k) for k, c in spatial_encodings().items()])


def _rolled(kind: str, column: str) -> str:
    return f"{kind}({column}) over w"


def _ratio(top: str, bottom: str) -> str:
    return r(f"case when sum({bottom}) over w > 0 then sum({top}) over w / cast(sum({bottom}) over w as double) end")


_FRAME = "order by game_date, game_id rows between 5 preceding and 1 preceding"

_PLAYER_FORM_SQL = f"""select game_id, player_id,
    {_ratio('field_goals_made', 'field_goals_attempted')} as player_recent_fg_pct_5,
    {_ratio('three_pointers_made', 'three_pointers_attempted')} as player_recent_fg3_pct_5,
    {r('avg(field_goals_attempted) over w')} as player_recent_fga_5,
    {r('avg(three_pointers_attempted) over w')} as player_recent_fg3a_5,
    {r('avg(minutes) over w')} as player_recent_minutes_5, {r('avg(points) over w')} as player_recent_points_5
    from v_player_logs window w as (partition by player_id {_FRAME})"""

_TEAM_FORM_SQL = f"""select game_id, team_id,
    {_ratio('points', 'possessions')} as team_recent_off_eff_proxy_5,
    {_ratio('field_goals_made', 'field_goals_attempted')} as team_recent_fg_pct_5,
    {_ratio('three_pointers_attempted', 'field_goals_attempted')} as team_recent_three_point_rate_5,
    {r('avg(possessions) over w')} as team_recent_pace_proxy_5, {r('avg(field_goals_attempted) over w')} as team_recent_fga_5,
    {r('avg(points) over w')} as team_recent_points_5, {r('avg(turnovers) over w')} as team_recent_turnovers_5
    from (select *, field_goals_attempted + 0.44e0 * free_throws_attempted + turnovers - offensive_rebounds as possessions
          from v_team_logs) window w as (partition by team_id {_FRAME})"""

_ALLOWED = (
    "field_goals_made",
    "field_goals_attempted",
    "three_pointers_attempted",
    "free_throws_attempted",
    "offensive_rebounds",
    "turnovers",
    "points",
)
_ALLOWED_SQL = f"""select a.game_id, a.team_id, a.game_date, {', '.join(f'sum(b.{c}) as {c}' for c in _ALLOWED)}
    from v_team_logs a join v_team_logs b on a.game_id = b.game_id and a.team_id <> b.team_id
    group by a.game_id, a.team_id, a.game_date"""

_OPPONENT_FORM_SQL = f"""select game_id, team_id,
    {_ratio('field_goals_made', 'field_goals_attempted')} as opp_recent_fg_pct_allowed_5,
    {_ratio('three_pointers_attempted', 'field_goals_attempted')} as opp_recent_three_point_rate_allowed_5,
    {r('avg(points) over w')} as opp_recent_points_allowed_5, {r('avg(possessions) over w')} as opp_recent_pace_proxy_5,
    {r('avg(field_goals_attempted) over w')} as opp_recent_fga_allowed_5
    from (select *, field_goals_attempted + 0.44e0 * free_throws_attempted + turnovers - offensive_rebounds as possessions
          from ({_ALLOWED_SQL})) window w as (partition by team_id {_FRAME})"""


@query("player_form", ("v_player_logs",), _PLAYER_FORM_SQL)
def player_form(t):
    return R.player_form(t["v_player_logs"], unique_key=True)


@query("player_form_first_row", ("v_player_logs",), _PLAYER_FORM_SQL)
def player_form_first_row(t):
    return R.player_form(t["v_player_logs"])


@query("team_form", ("v_team_logs",), _TEAM_FORM_SQL)
def team_form(t):
    return R.team_form(t["v_team_logs"], unique_key=True)


def _form_by_season(t, kind: str, view: str):
    """Form season after season, each from its own logs and the state the one before left."""
    folder = f"{checkpoint_dir(t.spark)}/form-{kind}-{uuid.uuid4().hex}"

    def written(df, name):
        df.write.parquet(f"{folder}/{name}")
        return t.spark.read.parquet(f"{folder}/{name}")

    logs = written(t[view].withColumn("_season", F.year("game_date")), "logs")
    state, parts = None, []
    for row in logs.select("_season").distinct().orderBy("_season").collect():
        own = logs.where(F.col("_season") == row["_season"]).drop("_season")
        parts.append(R.form_since(kind, own, state, unique_key=True))
        state = written(R.form_state(kind, own, state), f"state/after={row['_season']}")
    return reduce(lambda x, y: x.unionByName(y), parts)


@query("player_form_by_season", ("v_player_logs",), _PLAYER_FORM_SQL)
def player_form_by_season(t):
    return _form_by_season(t, "player", "v_player_logs")


@query("team_form_by_season", ("v_team_logs",), _TEAM_FORM_SQL)
def team_form_by_season(t):
    return _form_by_season(t, "team", "v_team_logs")


@query("opponent_form_by_season", ("v_team_logs",), _OPPONENT_FORM_SQL)
def opponent_form_by_season(t):
    return _form_by_season(t, "opponent", "v_team_logs")


@query(
    "opponent_allowed",
    ("v_team_logs",),
    f"select * replace (cast(game_date as string) as game_date, {', '.join(f'{n(c)} as {c}' for c in _ALLOWED)}) from ({_ALLOWED_SQL})",
)
def opponent_allowed(t):
    return R.opponent_allowed(t["v_team_logs"])


@query("opponent_form", ("v_team_logs",), _OPPONENT_FORM_SQL)
def opponent_form(t):
    return R.opponent_form(t["v_team_logs"], unique_key=True)


@query(
    "rolling_order_totals",
    (),
    f"""select o_orderkey, {r('sum(o_totalprice) over w')} as prior_sum, {r('avg(o_totalprice) over w')} as prior_mean
        from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey rows between 5 preceding and 1 preceding)""",
)
def rolling_order_totals(t):
    orders = t["orders"].select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    measures = {"prior_sum": ("sum", "o_totalprice"), "prior_mean": ("avg", "o_totalprice")}
    rolled = shift_roll(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], measures)
    return rolled.select("o_orderkey", *measures)


@query(
    "join_player_form",
    ("v_shots", "v_player_logs"),
    f"""with f as ({_PLAYER_FORM_SQL})
    select s.shot_id, f.player_recent_fg_pct_5, f.player_recent_points_5
    from v_shots s left join f on f.game_id = s.game_id and f.player_id = s.player_id""",
)
def join_player_form(t):
    shots = t["v_shots"].select("shot_id", "game_id", "player_id")
    form = R.player_form(t["v_player_logs"], unique_key=True)
    joined = R.attach_form(
        shots, form, {"game_id": "game_id", "player_id": "player_id"}, check_unique=True
    )
    return joined.select("shot_id", "player_recent_fg_pct_5", "player_recent_points_5")


_GOLD_SQL = f"""with b as ({_BASE_SQL}), pf as ({_PLAYER_FORM_SQL}), tf as ({_TEAM_FORM_SQL}), of as ({_OPPONENT_FORM_SQL}),
    scores as (
      select game_id, action_number,
             coalesce(last_value(score_home ignore nulls) over (partition by game_id order by action_number rows between unbounded preceding and 1 preceding), 0) as ph,
             coalesce(last_value(score_away ignore nulls) over (partition by game_id order by action_number rows between unbounded preceding and 1 preceding), 0) as pa
      from v_events)
    select b.* replace (cast(b.game_date as string) as game_date, cast(b.shot_made_flag as int) as shot_made_flag,
             {r('b.shot_angle')} as shot_angle, cast(b.is_corner_three as int) as is_corner_three, cast(b.is_home as int) as is_home,
             {r('b.seconds_remaining_period')} as seconds_remaining_period, {r('b.seconds_remaining_game')} as seconds_remaining_game),
           pf.* exclude (game_id, player_id), tf.* exclude (game_id, team_id), of.* exclude (game_id, team_id),
           {n('case when b.is_home then ph - pa else pa - ph end')} as score_margin, cast(ph is null as int) as score_margin_missing
    from b left join pf on pf.game_id = b.game_id and pf.player_id = b.player_id
           left join tf on tf.game_id = b.game_id and tf.team_id = b.team_id
           left join of on of.game_id = b.game_id and of.team_id = b.opponent_team_id
           left join scores s on s.game_id = b.game_id and s.action_number = b.game_event_id"""
GOLD_VIEWS = ("v_shots", "v_player_logs", "v_team_logs", "v_events")


def gold(t):
    return gold_of(t, *t.together(*GOLD_VIEWS[:3]))


def gold_of(t, shots, player_logs, team_logs):
    players, teams = t.together(*GOLD_VIEWS[1:3], once=False)
    return gold_features(
        base_features(shots), player_logs, team_logs, t["v_events"],
        slices={"player": R.player_slices(players), "team": R.team_slices(teams)},
    )


@query("gold_features", GOLD_VIEWS, _GOLD_SQL)
def gold_shot_features(t):
    return gold(t)


@query(
    "gold_without_margin",
    ("v_shots",),
    """select season, 'base_v1' as feature_set_version, count(*) as total_rows,
              cast(0 as bigint) as with_margin, count(*) as margin_missing from v_shots group by season""",
)
def gold_without_margin(t):
    rows = versioned(without_margin(base_features(t["v_shots"])))
    return rows.groupBy("season", "feature_set_version").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count("score_margin").alias("with_margin"),
        F.count_if("score_margin_missing").alias("margin_missing"),
    )


# --- events --------------------------------------------------------------------------------

_PRIOR = "partition by game_id order by action_number rows between unbounded preceding and 1 preceding"
_UPTO = "partition by game_id order by action_number rows between unbounded preceding and current row"


@query(
    "prior_scores",
    ("v_events",),
    f"""select game_id, action_number, coalesce(last_value(score_home ignore nulls) over ({_PRIOR}), 0) as prior_score_home,
           coalesce(last_value(score_away ignore nulls) over ({_PRIOR}), 0) as prior_score_away from v_events""",
)
def prior_score_rows(t):
    return prior_scores(t["v_events"])


@query(
    "fill_then_lag",
    (),
    f"""select event_id, {r("last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row)")} as filled,
           {r("coalesce(last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0)")} as prior
        from events""",
)
def fill_lag(t):
    spent = F.when(F.col("event_type") == "purchase", F.col("value")).alias("spent")
    events = t["events"].select("event_id", "user_id", "ts", spent)
    filled = fill_then_lag(events, ["user_id"], ["ts", "event_id"], {"spent": ("filled", "prior")})
    return filled.select("event_id", "filled", "prior")


@query(
    "score_margin",
    ("v_event_shots", "v_events"),
    f"""with p as (select game_id, action_number, coalesce(last_value(score_home ignore nulls) over ({_PRIOR}), 0) as ph,
                coalesce(last_value(score_away ignore nulls) over ({_PRIOR}), 0) as pa from v_events)
    select s.shot_id, {n('case when s.is_home then ph - pa else pa - ph end')} as score_margin, cast(ph is null as int) as score_margin_missing
    from v_event_shots s left join p on p.game_id = s.game_id and p.action_number = s.game_event_id""",
)
def score_margin(t):
    joined = attach_margin(t["v_event_shots"], t["v_events"])
    return joined.select("shot_id", "score_margin", "score_margin_missing")


_CLOCK = "'^PT(?:(\\d+)M)?(?:(\\d+(?:\\.\\d+)?)S)?$'"
_LABELLED = f"""labelled as (
      select *, upper(trim(concat(coalesce(action_type, ''), ' ', coalesce(sub_type, '')))) as label,
             lower(coalesce(shot_result, '')) as outcome,
             case when regexp_matches(game_clock, {_CLOCK}) then
               coalesce(try_cast(nullif(regexp_extract(game_clock, {_CLOCK}, 1), '') as double), 0) * 60
               + coalesce(try_cast(nullif(regexp_extract(game_clock, {_CLOCK}, 2), '') as double), 0) end as srp
      from v_events),
    flagged as (
      select *, case when period <= 4 then (4 - period) * 720 + srp else srp end as srg,
             label like '%MADE SHOT%' or outcome = 'made' as made, label like '%MISSED SHOT%' or outcome = 'missed' as missed,
             label like '%REBOUND%' as reb, label like '%REBOUND%' and label like '%OFFENSIVE%' as oreb,
             label like '%REBOUND%' and label not like '%OFFENSIVE%' as dreb, label like '%TURNOVER%' as tov, label like '%STEAL%' as stl,
             label like '%FOUL%' and label not like '%FREE THROW%' as foul, label like '%FREE THROW%' as ft, label like '%TIMEOUT%' as tout,
             label like '%SUBSTITUTION%' or label like '%SUB:%' as subst, label like '%VIOLATION%' as viol,
             label like '%JUMP BALL%' as jump, label like '%BLOCK%' as block
      from labelled),
    known as (select *, coalesce(is_field_goal, false) or made or missed as fg from flagged),
    enriched as (
      select *, not (fg or reb or tov or stl or foul or ft or tout or subst or viol or jump or block) as unknown,
             made or dreb or tov or stl as change,
             last_value(score_home ignore nulls) over ({_UPTO}) as sh, last_value(score_away ignore nulls) over ({_UPTO}) as sa,
             coalesce(last_value(score_home ignore nulls) over ({_PRIOR}), 0) as ph, coalesce(last_value(score_away ignore nulls) over ({_PRIOR}), 0) as pa
      from known)"""

_FLAG_SQL = {
    "is_field_goal": "fg",
    "is_made_shot_event": "made",
    "is_missed_shot_event": "missed",
    "is_rebound": "reb",
    "is_offensive_rebound": "oreb",
    "is_defensive_rebound": "dreb",
    "is_turnover": "tov",
    "is_steal": "stl",
    "is_foul": "foul",
    "is_free_throw": "ft",
    "is_timeout": "tout",
    "is_substitution": "subst",
    "is_violation": "viol",
    "is_jump_ball": "jump",
    "is_block": "block",
    "is_unknown_event": "unknown",
}


@query(
    "event_flags",
    ("v_events",),
    f"""with {_LABELLED} select action_number, label, {', '.join(f'cast({b} as int) as {a}' for a, b in _FLAG_SQL.items())},
        cast(change as int) as possession_change from enriched""",
)
def event_flag_rows(t):
    flags = E.event_flags("action_type", "sub_type", "is_field_goal", "shot_result")
    return t["v_events"].select(
        "action_number",
        E.event_label("action_type", "sub_type").alias("label"),
        *[c.alias(k) for k, c in flags.items()],
        E.possession_change(flags).alias("possession_change"),
    )


@query(
    "enriched_events",
    ("v_events",),
    f"""with {_LABELLED} select game_id, action_number, {r('srp')} as seconds_remaining_period, {r('srg')} as seconds_remaining_game,
        sh as score_home_filled, sa as score_away_filled, ph as prior_score_home, pa as prior_score_away,
        {r('sh + sa - ph - pa')} as score_change from enriched""",
)
def enriched_events(t):
    rows = Q.enrich_events(t["v_events"])
    change = E.score_change(
        "prior_score_home", "prior_score_away", "score_home_filled", "score_away_filled"
    )
    return rows.select(
        "game_id", "action_number", "seconds_remaining_period", "seconds_remaining_game",
        "score_home_filled", "score_away_filled", "prior_score_home", "prior_score_away",
        change.alias("score_change"),
    )


_SLOTS = f"""{_LABELLED},
    shots as (select *, minutes_remaining * 60 + seconds_remaining as left_period,
                     case when period <= 4 then (4 - period) * 720 else 0 end + minutes_remaining * 60 + seconds_remaining as left_game
              from v_event_shots),
    pairs as (
      select s.shot_id, s.game_event_id, s.team_id as shooter, s.home_team_id as home, s.left_game, e.*,
             row_number() over (partition by s.shot_id order by e.action_number desc) as back
      from shots s join enriched e on e.game_id = s.game_id and e.action_number < s.game_event_id),
    slots as (
      select *, lead(srg) over w as next_srg, back = 1 as newest, coalesce(team_id = shooter, false) as own,
             sum(cast(change as int)) over (partition by shot_id order by action_number rows between current row and unbounded following) as later_changes
      from pairs where back <= 5 window w as (partition by shot_id order by action_number)),
    records as (
      select shot_id, 6 - back as slot, action_number, -back as event_order_from_shot, period, srp as seconds_remaining_period, srg as seconds_remaining_game,
             case when srg - case when newest then left_game else next_srg end < 0 then 0
                  else srg - case when newest then left_game else next_srg end end as seconds_since_next_event_or_shot,
             greatest(0, coalesce(left_game - srg, 0)) as event_seconds_before_shot, own as same_team_as_shooter,
             coalesce(team_id = home, false) as event_team_is_home,
             case when shooter = home then ph - pa else pa - ph end as score_margin_before_event,
             sh + sa - ph - pa as event_score_change, team_id is not null and not own as event_team_is_opponent,
             change as event_likely_possession_change, own and later_changes = 0 as event_same_possession_as_shot,
             {', '.join(f'{b} as {a}' for a, b in _FLAG_SQL.items())}
      from slots)"""


@query(
    "sequence_slots",
    ("v_events", "v_event_shots"),
    f"with {_SLOTS} select shot_id, {n('slot')} as slot, {', '.join(f'{r(c)} as {c}' for c in Q.EVENT_FIELDS)} from records",
)
def sequence_slots(t):
    return Q.sequence_slots(Q.build_sequences(t["v_event_shots"], t["v_events"]))


@query(
    "sequence_heads",
    ("v_events", "v_event_shots"),
    f"""with {_SLOTS} select s.shot_id, s.game_event_id, {n('coalesce(max(x.action_number), -1)')} as max_prior_action,
        {n('count(x.slot)')} as events, {n('145')} as flat_width,
        {r('coalesce(sum(x.event_order_from_shot), 0)')} as order_total
        from shots s left join records x on x.shot_id = s.shot_id group by s.shot_id, s.game_event_id""",
)
def sequence_heads(t):
    rows = Q.build_sequences(t["v_event_shots"], t["v_events"])
    starts = F.filter(Q.flat_sequence(), lambda value, i: i % len(Q.EVENT_FIELDS) == 0)
    return rows.select(
        "shot_id",
        "game_event_id",
        "max_prior_action",
        F.size("seq").alias("events"),
        F.size(Q.flat_sequence()).alias("flat_width"),
        F.aggregate(starts, F.lit(0.0), lambda total, value: total + value).alias("order_total"),
    )


@query(
    "pressure_features",
    ("v_events", "v_event_shots"),
    f"""with {_SLOTS}
    select s.shot_id, {r('s.left_period')} as shot_seconds_remaining_period,
        {r('''least(greatest(coalesce(max(case when event_same_possession_as_shot then event_seconds_before_shot end),
               max(event_seconds_before_shot), 0), 0) / 24e0, 1)''')} as late_clock_proxy,
        {r('coalesce(max(cast(is_timeout as int)), 0)')} as sequence_contains_timeout,
        {r('coalesce(max(cast(is_offensive_rebound as int)), 0)')} as sequence_contains_offensive_rebound,
        {r('coalesce(max(cast(is_turnover as int)), 0)')} as sequence_contains_turnover,
        {r('case when count(slot) = 0 then 0 when count(event_score_change) = count(slot) then sum(event_score_change) end')} as prior_5_score_change_total,
        {', '.join(f"{r(f'coalesce(sum(cast({field} as int)), 0)')} as {name}" for name, field in Q.SUMMARY_COUNTS.items() if field != 'event_score_change')}
    from shots s left join records x on x.shot_id = s.shot_id group by s.shot_id, s.left_period""",
)
def pressure_features(t):
    return Q.pressure_features(Q.build_sequences(t["v_event_shots"], t["v_events"]))


@query(
    "sequence_quality",
    ("v_events", "v_event_shots"),
    f"""with {_SLOTS}, per_shot as (select s.shot_id, s.game_event_id, count(x.slot) as c, max(x.action_number) as top
          from shots s left join records x on x.shot_id = s.shot_id group by s.shot_id, s.game_event_id)
    select count(*) as shots, {n('5 * count(*)')} as total_slots, {n('sum(5 - c)')} as padded_slots,
           {r('sum(5 - c) / (5e0 * count(*))')} as padded_rate, cast(bool_and(top is null or top < game_event_id) as int) as leakage_check_passed
    from per_shot""",
)
def sequence_quality(t):
    return Q.sequence_quality(Q.build_sequences(t["v_event_shots"], t["v_events"]))


@query(
    "sequence_coverage",
    ("v_event_shots",),
    """select 'duplicate_shot_id' as "check", cast(0 as bigint) as "count"
       union all select 'missing_sequence', cast((select count(*) from events) - (select count(*) from v_event_shots) as bigint)""",
)
def sequence_coverage(t):
    every_event = t["events"].select(F.col("event_id").alias("shot_id"))
    return Q.sequence_coverage(every_event, Q.build_sequences(t["v_event_shots"], t["v_events"]))


@query(
    "last_events_before",
    (),
    f"""with p as (
      select a.event_id as shot, b.event_id as e, b.value as v, row_number() over (partition by a.event_id order by b.ts desc) as back
      from events a join events b on a.user_id = b.user_id and b.ts < a.ts and b.event_type <> 'purchase'
      where a.event_type = 'purchase')
    select a.event_id, {n('count(p.e)')} as found, {n('coalesce(sum(p.e), 0)')} as id_total, {n('coalesce(min(p.e), -1)')} as oldest
    from events a left join p on p.shot = a.event_id and p.back <= 5 where a.event_type = 'purchase' group by a.event_id""",
)
def last_events_before(t):
    bought = F.col("event_type") == "purchase"
    left = t["events"].where(bought).select("user_id", "event_id", "ts")
    right = t["events"].where(~bought).select("user_id", F.col("event_id").alias("e"), "ts")
    found = Q.last_events_before(
        left, right, key="user_id", left_position="ts", right_position="ts", record=["e"]
    )
    ids = F.transform("events", lambda item: item["e"])
    return found.select(
        "event_id",
        F.size("events").alias("found"),
        F.aggregate(ids, F.lit(0).cast("bigint"), lambda total, e: total + e).alias("id_total"),
        F.coalesce(F.array_min(ids), F.lit(-1)).alias("oldest"),
    )


# --- split ---------------------------------------------------------------------------------

_SPLIT = """ranked as (
      select game_id, row_number() over (order by game_date, game_id) as rn, count(*) over () as total
      from (select game_id, min(game_date) as game_date from v_shots group by game_id)),
    labels as (select game_id, case when rn <= greatest(1, least(total - 1, floor(total * 0.8))) then 'train' else 'test' end as split from ranked)"""


@query(
    "time_split",
    ("v_shots",),
    f"with {_SPLIT} select s.shot_id, l.split from v_shots s join labels l on l.game_id = s.game_id",
)
def time_split(t):
    return D.time_split(t["v_shots"].select("shot_id", "game_id", "game_date")).select("shot_id", "split")


@query(
    "time_split_by_day",
    ("v_shots",),
    f"with {_SPLIT} select s.shot_id, l.split from v_shots s join labels l on l.game_id = s.game_id",
)
def time_split_by_day(t):
    rows = t["v_shots"].select("shot_id", "game_id", "game_date")
    return D.time_split(rows, one_date_per_game=True).select("shot_id", "split")


@query(
    "split_summary",
    ("v_shots",),
    f"""with {_SPLIT} select l.split, count(distinct s.game_id) as games, count(*) as shot_rows,
        {day('min(s.game_date)')} as min_game_date, {day('max(s.game_date)')} as max_game_date
        from v_shots s join labels l on l.game_id = s.game_id group by l.split""",
)
def split_summary(t):
    return D.split_summary(D.time_split(t["v_shots"].select("shot_id", "game_id", "game_date")))


@query(
    "split_overlap",
    ("v_shots",),
    f"""with {_SPLIT} select count(*) as overlapping_game_ids from labels a join labels b
        on a.game_id = b.game_id and a.split = 'train' and b.split = 'test'""",
)
def split_overlap(t):
    return D.split_overlap(D.time_split(t["v_shots"].select("shot_id", "game_id", "game_date")))


# --- value ---------------------------------------------------------------------------------


@query(
    "expected_value",
    ("v_open",),
    f"""select shot_id, {r('predicted_make_probability * shot_value')} as expected_shot_value,
           {r('case when outcome then shot_value when not outcome then 0 end')} as actual_points,
           {r('case when outcome then shot_value when not outcome then 0 end - predicted_make_probability * shot_value')} as points_above_expected
        from v_open""",
)
def expected_value(t):
    values = value_columns("predicted_make_probability", "shot_value", "outcome")
    return t["v_open"].select("shot_id", *[c.alias(k) for k, c in values.items()])


@query(
    "display_labels",
    ("v_open",),
    """select shot_id, concat(shot_zone_basic, ' / ', shot_zone_area, ' / ', shot_zone_range) as zone,
           case when outcome is null then 'Unknown' when outcome then 'Made' else 'Missed' end as result,
           case when c_name is null then concat('Player `', cast(player_id as string), '`')
                else concat(c_name, ' (`', cast(player_id as string), '`)') end as player
       from v_open left join customer on c_custkey = player_id and c_acctbal > 0""",
)
def display_labels(t):
    names = t["customer"].where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("player_id"), "c_name")
    return t["v_open"].join(names, "player_id", "left").select(
        "shot_id",
        L.zone_label("shot_zone_basic", "shot_zone_area", "shot_zone_range").alias("zone"),
        L.shot_result("outcome").alias("result"),
        L.named_id("c_name", "player_id", "Player").alias("player"),
    )


@query(
    "union_extracts",
    (),
    f"""with both_parts as (
      select c_custkey as id, c_name as name, c_nationkey as nation, null as part from customer
      union all select s_suppkey, s_name, s_nationkey, 'supplier' from supplier
      union all select s_suppkey, s_name, s_nationkey, 'supplier' from supplier)
    select id, name, {n('nation')} as nation, part from (
      select *, row_number() over (partition by id order by name desc, nation, part) as pick from both_parts) where pick = 1""",
)
def union_extracts(t):
    customers = t["customer"].selectExpr("c_custkey as id", "c_name as name", "c_nationkey as nation")
    suppliers = t["supplier"].selectExpr(
        "s_suppkey as id", "s_name as name", "s_nationkey as nation", "'supplier' as part"
    )
    return C.union_extracts([customers, suppliers, suppliers], ["id"], [F.desc("name")])
