"""Summaries, findings, edges, data quality, inspections, metrics and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from arcline import schemas as S
from arcline.functions import shots as X
from arcline.operators import edges as G
from arcline.operators import inspection as I
from arcline.operators import metrics as K
from arcline.operators import models as M
from arcline.operators import quality as Q
from arcline.operators import summaries as A
from arcline.operators.ranks import exact_quantiles
from arcline.operators.sequences import attach_pressure, build_sequences
from arcline.operators.split import time_split
from arcline.operators.windows import keep_first
from arcline.session import written_once
from arcline.sources.sinks import newest_entries

from .feature_queries import GOLD_VIEWS, _GOLD_SQL, _SLOTS, _SPLIT, gold, gold_of
from .registry import day, n, query, r
from .views import TABLES

# Sample-size limits suited to the provided tables (players have 3 to 93 attempts there).
MIN_PLAYERS, MIN_ZONES, MIN_MONTHS = 20, 100, 4

VALUED_SQL = """valued as (
      select s.*, predicted_make_probability * shot_value as ev, case when shot_made_flag then shot_value else 0 end as pts,
             strftime(game_date, '%Y-%m') as game_month from v_scored s)"""


def predictions(t):
    return M.prediction_table(t["v_scored"])


# --- summaries -----------------------------------------------------------------------------


def _summary_sql(keys: tuple[str, ...], name: str = "summary") -> str:
    return f"""{name} as (
      select {', '.join(keys)}, count(*) as attempts, {n('sum(cast(shot_made_flag as int))')} as made_shots,
             avg(cast(shot_made_flag as int)) as actual_fg_pct, avg(predicted_make_probability) as expected_fg_pct,
             sum(pts) as actual_points, sum(ev) as expected_points, sum(pts - ev) as points_above_expected,
             sum(pts - ev) / count(*) * 100 as points_above_expected_per_100_shots,
             avg(ev) as avg_expected_shot_value, avg(shot_value) as avg_shot_value
      from valued group by {', '.join(keys)})"""


_DOUBLES = [m for m in A.SUMMARY_MEASURES if m not in ("attempts", "made_shots")]
_ROUNDED = ", ".join(f"{r(m)} as {m}" for m in _DOUBLES)
_SUMMARY_COLUMNS = f"attempts, made_shots, {_ROUNDED}"
_KEYS = {
    "players": ("player_id",),
    "teams": ("team_id",),
    "zones": S.ZONE_COLUMNS,
    "trends": ("player_id", "game_month"),
}


def _full_summary_sql(kind: str) -> str:
    keys = _KEYS[kind]
    return f"with {VALUED_SQL}, {_summary_sql(keys)} select {', '.join(keys)}, {_SUMMARY_COLUMNS} from summary"


def _top_sql(kind: str, measure: str, minimum: int, count: int, direction: str = "desc") -> str:
    keys = ", ".join(_KEYS[kind])
    return f"""with {VALUED_SQL}, {_summary_sql(_KEYS[kind])} select {keys}, {_SUMMARY_COLUMNS} from (
        select * from summary where attempts >= {minimum} order by {measure} {direction}, {keys} limit {count})"""


@query("predictions_table", ("v_scored",), f"""select shot_id, game_id, player_id, team_id, shot_value, cast(shot_made_flag as int) as shot_made_flag,
    {r('predicted_make_probability')} as predicted_make_probability, {r('predicted_make_probability * shot_value')} as expected_shot_value,
    {r('case when shot_made_flag then shot_value else 0 end')} as actual_points,
    {r('case when shot_made_flag then shot_value else 0 end - predicted_make_probability * shot_value')} as points_above_expected,
    cast(game_date as string) as game_date, shot_zone_basic, shot_zone_area, shot_zone_range, shot_distance from v_scored""")
def predictions_table(t):
    return predictions(t)


@query("summary_players", ("v_scored",), _full_summary_sql("players"))
def summary_players(t):
    return A.summarize_players(predictions(t))


@query("summary_teams", ("v_scored",), _full_summary_sql("teams"))
def summary_teams(t):
    return A.summarize_teams(predictions(t))


@query("summary_zones", ("v_scored",), _full_summary_sql("zones"))
def summary_zones(t):
    return A.summarize_zones(predictions(t))


@query("summary_player_months", ("v_scored",), _full_summary_sql("trends"))
def summary_player_months(t):
    return A.summarize_player_months(predictions(t))


@query("summary_teams_from_base", ("v_scored",), _full_summary_sql("teams"))
def summary_teams_from_base(t):
    return A.summary_from_base(A.summary_base(predictions(t)), ("team_id",))


@query(
    "players_with_minimum_attempts",
    ("v_scored",),
    f"with {VALUED_SQL}, {_summary_sql(('player_id',))} select player_id, {_SUMMARY_COLUMNS} from summary where attempts >= {MIN_PLAYERS}",
)
def players_with_minimum_attempts(t):
    return A.with_minimum_attempts(A.summarize_players(predictions(t)), MIN_PLAYERS)


@query("top_players_by_total", ("v_scored",), _top_sql("players", "points_above_expected", MIN_PLAYERS, 5))
def top_players_by_total(t):
    return A.top_players_by_total(A.summarize_players(predictions(t)), minimum=MIN_PLAYERS)


@query(
    "top_players_by_rate",
    ("v_scored",),
    _top_sql("players", "points_above_expected_per_100_shots", MIN_PLAYERS, 5),
)
def top_players_by_rate(t):
    return A.top_players_by_rate(A.summarize_players(predictions(t)), minimum=MIN_PLAYERS)


@query("top_teams_by_total", ("v_scored",), _top_sql("teams", "points_above_expected", 0, 5))
def top_teams_by_total(t):
    return A.top_teams_by_total(A.summarize_teams(predictions(t)))


@query("top_teams_by_value", ("v_scored",), _top_sql("teams", "avg_expected_shot_value", 0, 5))
def top_teams_by_value(t):
    return A.top_teams_by_value(A.summarize_teams(predictions(t)))


_ZONE_KEYS = ", ".join(S.ZONE_COLUMNS)
_EXTREME_ZONES = f"""kept as (select * from summary where attempts >= {MIN_ZONES}),
    extremes as (
      select *, 'best' as side from (select * from kept order by points_above_expected_per_100_shots desc, {_ZONE_KEYS} limit 3)
      union all select *, 'worst' as side from (select * from kept order by points_above_expected_per_100_shots, {_ZONE_KEYS} limit 3))"""


@query(
    "zone_extremes",
    ("v_scored",),
    f"with {VALUED_SQL}, {_summary_sql(S.ZONE_COLUMNS)}, {_EXTREME_ZONES} select {_ZONE_KEYS}, {_SUMMARY_COLUMNS}, side from extremes",
)
def zone_extremes(t):
    return A.zone_extremes(A.summarize_zones(predictions(t)), minimum=MIN_ZONES)


_MONTHS = f"""{_summary_sql(('player_id', 'game_month'), 'monthly')},
    changes as (
      select player_id, lag(game_month) over w as from_month, game_month as to_month,
             points_above_expected_per_100_shots - lag(points_above_expected_per_100_shots) over w as delta_per_100,
             lag(attempts) over w as from_attempts, attempts as to_attempts,
             points_above_expected_per_100_shots as to_total_per_100
      from monthly where attempts >= {MIN_MONTHS} window w as (partition by player_id order by game_month)
      qualify delta_per_100 is not null)"""
_CHANGE_COLUMNS = f"player_id, from_month, to_month, {r('delta_per_100')} as delta_per_100, from_attempts, to_attempts, {r('to_total_per_100')} as to_total_per_100"


@query("month_changes", ("v_scored",), f"with {VALUED_SQL}, {_MONTHS} select {_CHANGE_COLUMNS} from changes")
def month_changes(t):
    return A.month_changes(A.summarize_player_months(predictions(t)), minimum=MIN_MONTHS)


_EXTREME_MONTHS = """months as (
      select *, 'improvement' as side from (select * from changes order by delta_per_100 desc, player_id, to_month limit 1)
      union all select *, 'decline' as side from (select * from changes order by delta_per_100, player_id, to_month limit 1))"""


@query(
    "month_change_extremes",
    ("v_scored",),
    f"with {VALUED_SQL}, {_MONTHS}, {_EXTREME_MONTHS} select {_CHANGE_COLUMNS}, side from months",
)
def month_change_extremes(t):
    changes = A.month_changes(A.summarize_player_months(predictions(t)), minimum=MIN_MONTHS)
    return A.month_change_extremes(changes)


def _finding_sql(finding: str, source: str, subject: str, measure: str, minimum: int, keys: str, count: int = 5, direction: str = "desc") -> str:
    return f"""select '{finding}' as finding, {n(f'row_number() over (order by {measure} {direction}, {keys})')} as position, {subject} as subject,
        attempts, {r('points_above_expected')} as total, {r('points_above_expected_per_100_shots')} as per_100, {r(measure)} as value
      from (select * from {source} where attempts >= {minimum} order by {measure} {direction}, {keys} limit {count})"""


def _player(key: str = "player_id") -> str:
    return f"(select concat(c_name, ' (`', cast(c_custkey as string), '`)') from customer where c_custkey = {key})"


_TEAM = "(select concat(s_name, ' (`', cast(s_suppkey as string), '`)') from supplier where s_suppkey = team_id)"
_ZONE = "concat(shot_zone_basic, ' / ', shot_zone_area, ' / ', shot_zone_range)"
_RATE = "points_above_expected_per_100_shots"


@query(
    "findings",
    ("v_scored",),
    f"""with {VALUED_SQL}, {_summary_sql(('player_id',), 'players')}, {_summary_sql(('team_id',), 'teams')}, {_summary_sql(S.ZONE_COLUMNS, 'zones')},
      {_MONTHS}, {_EXTREME_MONTHS}
    {_finding_sql('top players by total', 'players', _player(), 'points_above_expected', MIN_PLAYERS, 'player_id')}
    union all {_finding_sql('top players by rate', 'players', _player(), _RATE, MIN_PLAYERS, 'player_id')}
    union all {_finding_sql('top teams by total', 'teams', _TEAM, 'points_above_expected', 0, 'team_id')}
    union all {_finding_sql('top teams by expected value', 'teams', _TEAM, 'avg_expected_shot_value', 0, 'team_id')}
    union all {_finding_sql('best zones', 'zones', _ZONE, _RATE, MIN_ZONES, _ZONE_KEYS, 3)}
    union all {_finding_sql('worst zones', 'zones', _ZONE, _RATE, MIN_ZONES, _ZONE_KEYS, 3, 'asc')}
    union all select concat('month ', side), cast(1 as bigint), concat({_player()}, ' ', from_month, ' to ', to_month), to_attempts, null,
        {r('to_total_per_100')}, {r('delta_per_100')} from months
    union all select 'evaluation volume', cast(1 as bigint), 'min players {MIN_PLAYERS}, zones {MIN_ZONES}', {n('sum(attempts)')}, null, null, null from players""",
)
def findings(t):
    return A.findings(
        A.all_summaries(predictions(t)),
        player_names=t["customer"].select(F.col("c_custkey").alias("player_id"), F.col("c_name").alias("full_name")),
        team_names=t["supplier"].select(F.col("s_suppkey").alias("team_id"), F.col("s_name").alias("abbreviation")),
        min_players=MIN_PLAYERS,
        min_zones=MIN_ZONES,
        min_months=MIN_MONTHS,
    )


# --- shot quality and edges ----------------------------------------------------------------

_BUCKET = """case when shot_distance < 0 then null when shot_distance < 5 then 0 when shot_distance < 10 then 1 when shot_distance < 15 then 2
    when shot_distance < 20 then 3 when shot_distance < 25 then 4 when shot_distance < 30 then 5 else 6 end"""
_BUCKET_NAMES = ", ".join(f"({i}, '{label}')" for i, label in enumerate(X.DISTANCE_LABELS))
_EDGE_NAMES = ", ".join(f"({i}, '{label}')" for i, label in enumerate(X.EDGE_LABELS))


@query(
    "overview",
    ("v_shots",),
    f"""with {_SPLIT} select {n("sum(case when split = 'train' then 1 else 0 end)")} as train_shots, {n("sum(case when split = 'test' then 1 else 0 end)")} as test_shots,
        count(*) as total_shots, {r("avg(case when split = 'train' then cast(shot_made_flag as int) end)")} as train_make_rate,
        {r("avg(case when split = 'test' then cast(shot_made_flag as int) end)")} as test_make_rate, {r('avg(cast(shot_made_flag as int))')} as overall_make_rate,
        {n('31')} as feature_count from v_shots s join labels l on l.game_id = s.game_id""",
)
def overview(t):
    return G.overview(time_split(t["v_shots"].select("game_id", "game_date", "shot_made_flag")))


_FILTER = "shot_value = 3 and period in (1, 2, 5) and shot_distance >= 10 and shot_distance <= 30"


def _filtered(t):
    return G.filter_shots(t["v_scored"], shot_value=3, periods=[1, 2, 5], min_distance=10, max_distance=30)


@query("filter_shots", ("v_scored",), f"select shot_id, shot_value, {n('period')} as period, shot_distance from v_scored where {_FILTER}")
def filter_shots(t):
    return _filtered(t).select("shot_id", "shot_value", "period", "shot_distance")


@query(
    "quality_summary",
    ("v_scored",),
    f"""select count(*) as shot_count, {r('avg(cast(shot_made_flag as int))')} as make_rate, {r('avg(shot_value)')} as avg_shot_value,
        {r('avg(shot_distance)')} as avg_shot_distance, {r('avg(cast(shot_made_flag as int)) * avg(shot_value)')} as avg_expected_points_baseline
        from v_scored where {_FILTER}""",
)
def quality_summary(t):
    return G.quality_summary(_filtered(t))


@query(
    "filter_domain",
    ("v_scored",),
    f"""select min(shot_distance) as min_distance, max(shot_distance) as max_distance,
        (select string_agg(cast(period as string), ',' order by period) from (select distinct period from v_scored)) as periods from v_scored""",
)
def filter_domain(t):
    return G.filter_domain(t["v_scored"])


@query(
    "distance_bucket_summary",
    ("v_scored",),
    f"""with g as (select {_BUCKET} as b, count(*) as c, avg(cast(shot_made_flag as int)) as m, avg(shot_value) as v from v_scored
                 where shot_distance < 25 group by 1)
    select label as distance_bucket, {n('i')} as bucket_rank, {n('coalesce(c, 0)')} as shot_count, {r('coalesce(m, 0)')} as make_rate,
           {r('coalesce(v, 0)')} as avg_shot_value, {r('coalesce(m * v, 0)')} as avg_expected_points_baseline
    from (values {_BUCKET_NAMES}) as d(i, label) left join g on g.b = d.i""",
)
def distance_bucket_summary(t):
    return G.distance_bucket_summary(G.filter_shots(t["v_scored"], max_distance=24))


@query(
    "similar_baseline",
    ("v_open",),
    f"""select shot_value, {n(_BUCKET)} as bucket_rank, count(*) as similar_shot_count, {r('sum(cast(outcome as int))')} as similar_made,
        count(outcome) as similar_known from v_open group by 1, 2""",
)
def similar_baseline(t):
    return G.similar_baseline(t["v_open"], made="outcome")


def _edges_sql(leave_one_out: bool) -> str:
    drop = "- coalesce(cast(o.outcome as int), 0)" if leave_one_out else ""
    known = "- (case when o.outcome is null then 0 else 1 end)" if leave_one_out else ""
    one = "- 1" if leave_one_out else ""
    return f"""base as (select shot_value, {_BUCKET} as b, count(*) as c, sum(cast(outcome as int)) as h, count(outcome) as k from v_open group by 1, 2),
    based as (select o.*, b.c {one} as alike, coalesce((b.h {drop}) / nullif(cast(b.k {known} as double), 0), 0) as rate
              from (select *, {_BUCKET} as bucket from v_open) o join base b on b.shot_value = o.shot_value and b.b = o.bucket),
    edges as (select shot_id as row_id, shot_value, shot_distance, period, outcome as actual_made,
                case when outcome then shot_value when not outcome then 0 end as actual_points, predicted_make_probability,
                predicted_make_probability * shot_value as expected_shot_value, rate as baseline_make_rate, rate * shot_value as baseline_expected_value,
                predicted_make_probability - rate as probability_edge_vs_baseline, predicted_make_probability * shot_value - rate * shot_value as ev_edge_vs_baseline,
                alike as similar_shot_count from based)"""


_EDGE_OUT = f"""row_id, shot_value, shot_distance, {n('period')} as period, cast(actual_made as int) as actual_made,
    {', '.join(f'{r(c)} as {c}' for c in G.EDGE_COLUMNS[5:12])}, {n('similar_shot_count')} as similar_shot_count"""


def _edges(t, **options):
    scored = t["v_open"].withColumn("row_id", F.col("shot_id"))
    return G.edge_table(scored, made="outcome", **options)


@query("edge_table", ("v_open",), f"with {_edges_sql(False)} select {_EDGE_OUT} from edges")
def edge_table(t):
    return _edges(t)


@query("edge_table_leave_one_out", ("v_open",), f"with {_edges_sql(True)} select {_EDGE_OUT} from edges")
def edge_table_leave_one_out(t):
    return _edges(t, leave_one_out=True)


_BACKTEST = """tested as (
      select d.i, d.label as bucket, count(e.row_id) as shot_count, coalesce(avg(predicted_make_probability), 0) as p, coalesce(avg(expected_shot_value), 0) as m,
             coalesce(avg(baseline_expected_value), 0) as b, coalesce(avg(ev_edge_vs_baseline), 0) as e, coalesce(avg(cast(actual_made as int)), 0) as h,
             coalesce(avg(actual_points), 0) as a
      from (values %s) as d(i, label) left join edges e on d.i =
        case when ev_edge_vs_baseline <= -0.1 then 0 when ev_edge_vs_baseline <= 0 then 1 when ev_edge_vs_baseline < 0.1 then 2 else 3 end
      group by d.i, d.label)""" % _EDGE_NAMES


@query(
    "edge_backtest",
    ("v_open",),
    f"""with {_edges_sql(False)}, {_BACKTEST}
    select bucket, {n('i')} as bucket_rank, shot_count, {r('p')} as avg_predicted_make_probability, {r('m')} as avg_model_ev, {r('b')} as avg_baseline_ev,
           {r('e')} as avg_ev_edge, {r('h')} as actual_make_rate, {r('a')} as avg_actual_points, {r('m - a')} as model_ev_minus_actual_points,
           {r('b - a')} as baseline_ev_minus_actual_points from tested""",
)
def edge_backtest(t):
    return G.edge_backtest(_edges(t))


@query(
    "backtest_verdict",
    ("v_open",),
    f"""with {_edges_sql(False)}, {_BACKTEST},
    sides as (select case when i >= 2 then 'positive' else 'negative' end as side, sum(shot_count) as c,
                     sum(h * shot_count) / sum(shot_count) as rate, sum(a * shot_count) / sum(shot_count) as pts from tested where shot_count > 0 group by 1),
    wide as (select {n('sum(c)')} as shots, max(case when side = 'positive' then rate end) as pr, max(case when side = 'positive' then pts end) as pp,
                    max(case when side = 'negative' then rate end) as nr, max(case when side = 'negative' then pts end) as np from sides)
    select shots, {r('pr')} as positive_make_rate, {r('pp')} as positive_points, {r('nr')} as negative_make_rate, {r('np')} as negative_points,
           case when pr > nr or pp > np then 'expected direction' else 'no clear difference' end as verdict from wide""",
)
def backtest_verdict(t):
    return G.backtest_verdict(G.edge_backtest(_edges(t)))


@query(
    "edge_means",
    ("v_open",),
    f"""with {_edges_sql(False)} select count(*) as shots_scored, {r('avg(predicted_make_probability)')} as avg_predicted_make_rate,
        {r('avg(expected_shot_value)')} as avg_model_ev, {r('avg(baseline_expected_value)')} as avg_baseline_ev, {r('avg(ev_edge_vs_baseline)')} as avg_ev_edge from edges""",
)
def edge_means(t):
    return G.edge_means(_edges(t))


@query(
    "rank_edges_highest",
    ("v_open",),
    f"with {_edges_sql(False)} select {_EDGE_OUT} from (select * from edges where shot_value = 3 order by ev_edge_vs_baseline desc, row_id limit 50)",
)
def rank_edges_highest(t):
    return G.rank_edges(_edges(t), shot_value=3, n=50)


@query(
    "rank_edges_lowest",
    ("v_open",),
    f"with {_edges_sql(False)} select {_EDGE_OUT} from (select * from edges order by predicted_make_probability, row_id limit 25)",
)
def rank_edges_lowest(t):
    return G.rank_edges(_edges(t), "predicted_make_probability", highest_first=False, n=25)


@query("sample_rows")
def sample_rows(t):
    return G.sample_rows(t["v_scored"].select("shot_id", "shot_value", "period"), "shot_id", 100)


@query(
    "requested_rows_absent",
    ("v_scored",),
    "select event_id as game_id from events where event_id not in (select game_id from v_scored)",
)
def requested_rows_absent(t):
    wanted = t["events"].select(F.col("event_id").alias("game_id"))
    return G.requested_rows(t["v_scored"], wanted, "game_id")[1]


@query(
    "requested_rows_found",
    (),
    """select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey in (
         select p_partkey from part where p_brand = 'Brand#2')""",
)
def requested_rows_found(t):
    wanted = t["part"].where(F.col("p_brand") == "Brand#2").select(F.col("p_partkey").alias("l_partkey"))
    found, _ = G.requested_rows(t["lineitem"], wanted, "l_partkey")
    return found.select("l_orderkey", "l_linenumber", "l_partkey")


# --- inspections ---------------------------------------------------------------------------


@query(
    "row_counts",
    (),
    " union all ".join(f"select '{name}' as table_name, count(*) as row_count from {name}" for name in TABLES),
)
def row_counts(t):
    return I.row_counts({name: t[name] for name in TABLES})


_INSPECTED = ("shot_id", "shot_zone_basic", "shot_zone_area", "loc_x", "shot_made_flag")


@query(
    "missing_counts",
    ("v_shots",),
    " union all ".join(
        f"select '{c}' as column_name, count(*) - count({'nullif(trim(' + c + chr(41) + ', ' + chr(39) * 2 + ')' if 'zone' in c else c}) as missing_rows from v_shots"
        for c in _INSPECTED
    ),
)
def missing_counts(t):
    return I.missing_counts(t["v_shots"], list(_INSPECTED))


@query(
    "duplicate_keys",
    ("v_events",),
    f"""select 'lineitem' as table_name, {n('count(case when c > 1 then 1 end)')} as duplicate_groups, {n('sum(c - 1)')} as extra_rows
          from (select count(*) as c from lineitem group by l_orderkey, l_linenumber)
        union all select 'events', {n('count(case when c > 1 then 1 end)')}, {n('sum(c - 1)')}
          from (select count(*) as c from v_events group by game_id, team_id, period)""",
)
def duplicate_keys(t):
    return I.duplicate_keys(
        {
            "lineitem": (t["lineitem"], ["l_orderkey", "l_linenumber"]),
            "events": (t["v_events"], ["game_id", "team_id", "period"]),
        }
    )


@query(
    "duplicate_sample",
    (),
    f"""select l_orderkey, {n('l_linenumber')} as l_linenumber, count(*) as row_count from lineitem group by 1, 2 having count(*) > 1
        order by row_count desc, l_orderkey, l_linenumber limit 10""",
)
def duplicate_sample(t):
    return I.duplicate_sample(t["lineitem"], ["l_orderkey", "l_linenumber"])


@query(
    "keep_first",
    (),
    f"""select l_orderkey, {n('l_linenumber')} as l_linenumber, {n('l_partkey')} as l_partkey, l_suppkey, {r('l_extendedprice')} as l_extendedprice from (
          select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey, l_suppkey) as pick from lineitem) where pick = 1""",
)
def keep_first_rows(t):
    rows = t["lineitem"].select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"
    )
    kept = keep_first(rows, ["l_orderkey", "l_linenumber"], [F.desc("l_shipdate")])
    return kept.drop("l_shipdate")


_COVERAGE = f"{day('min(game_date)')} as min_date, {day('max(game_date)')} as max_date, count(distinct game_id) as games, count(*) as row_count"


@query("date_coverage", ("v_shots",), f"select {_COVERAGE} from v_shots")
def date_coverage(t):
    return I.date_coverage(t["v_shots"], "game_date", "game_id")


@query("season_coverage", ("v_shots",), f"select season, {_COVERAGE} from v_shots group by season")
def season_coverage(t):
    return I.date_coverage(t["v_shots"], "game_date", "game_id", ["season"])


@query(
    "row_delta",
    ("v_shots",),
    f"""select (select count(*) from lineitem) as source_rows, (select count(*) from v_shots) as derived_rows,
        (select count(*) from v_shots) - (select count(*) from lineitem) as row_delta""",
)
def row_delta(t):
    return I.row_delta(t["v_shots"], t["lineitem"])


@query(
    "id_uniqueness",
    (),
    f"select count(*) as total_rows, count(distinct l_partkey) as distinct_ids, count(*) - count(distinct l_partkey) as duplicate_rows from lineitem",
)
def id_uniqueness(t):
    return I.id_uniqueness(t["lineitem"], "l_partkey")


@query("value_distribution", (), "select l_returnflag, count(*) as row_count from lineitem group by 1")
def value_distribution(t):
    return I.value_distribution(t["lineitem"], "l_returnflag")


@query(
    "domain_check",
    (),
    f"""select count(*) as total_rows, count(*) - count(o_orderstatus) as missing_rows,
        {n("sum(case when o_orderstatus not in ('F', 'O') then 1 else 0 end)")} as invalid_rows from orders""",
)
def domain_check(t):
    return I.domain_check(t["orders"], "o_orderstatus", ["F", "O"])


_GOLD = f"with gold as ({_GOLD_SQL})"


def _rate(c: str) -> str:
    return r(f"round(100e0 * count({c}) / count(*), 1)")


@query(
    "form_fill_rates",
    GOLD_VIEWS,
    f"""{_GOLD} select count(*) as total_rows, {', '.join(f'count(*) - count({c}) as missing_{c}, {_rate(c)} as {c}_pct' for c in S.FORM_COLUMNS)} from gold""",
)
def form_fill_rates(t):
    return I.fill_rates(gold(t), list(S.FORM_COLUMNS))


@query(
    "form_fill_by_month",
    GOLD_VIEWS,
    f"""{_GOLD} select substr(game_date, 1, 7) as game_month, count(*) as total_rows, count(*) - count(player_recent_fg_pct_5) as missing_player_recent_fg_pct_5,
        {_rate('player_recent_fg_pct_5')} as player_recent_fg_pct_5_pct from gold group by 1""",
)
def form_fill_by_month(t):
    month = X.month_label("game_date").alias("game_month")
    return I.fill_rates(gold(t), ["player_recent_fg_pct_5"], [month])


_AVERAGED = (*S.TEAM_FORM_COLUMNS, *S.OPPONENT_FORM_COLUMNS)


@query(
    "form_averages",
    GOLD_VIEWS,
    f"{_GOLD} select {', '.join(f'{r(f'round(avg({c}), 4)')} as avg_{c}, count({c}) as filled_{c}' for c in _AVERAGED)} from gold",
)
def form_averages(t):
    return I.feature_averages(gold(t), list(_AVERAGED))


@query(
    "margin_coverage",
    ("v_event_shots", "v_events"),
    f"""with p as (select game_id, action_number, coalesce(last_value(score_home ignore nulls) over w, 0) - coalesce(last_value(score_away ignore nulls) over w, 0) as m
          from v_events window w as (partition by game_id order by action_number rows between unbounded preceding and 1 preceding)),
      j as (select case when s.is_home then m else -m end as m from v_event_shots s left join p on p.game_id = s.game_id and p.action_number = s.game_event_id)
    select count(*) as total_rows, count(m) as with_margin, count(*) - count(m) as without_margin, {r('round(100e0 * count(m) / count(*), 1)')} as with_margin_pct,
           {n('min(m)')} as min_margin, {n('max(m)')} as max_margin from j""",
)
def margin_coverage(t):
    from arcline.operators.margin import attach_margin

    return I.margin_coverage(attach_margin(t["v_event_shots"], t["v_events"]))


_MISSING_FEATURES = ("loc_x", "player_recent_fg_pct_5", "team_recent_fga_5", "score_margin")


@query(
    "missing_by_feature",
    GOLD_VIEWS,
    f"""with gold as ({_GOLD_SQL}), {_SPLIT}
    {' union all '.join(f"select split, '{c}' as feature, count(*) - count({c}) as missing_rows from gold g join labels l on l.game_id = g.game_id group by split" for c in _MISSING_FEATURES)}""",
)
def missing_by_feature(t):
    rows = written_once(gold(t).select("game_id", "game_date", *_MISSING_FEATURES), "missing")
    return I.missing_by_feature(time_split(rows, one_date_per_game=True), list(_MISSING_FEATURES))


@query(
    "inspect_gold",
    ("v_shots",),
    """select count(*) as shots_row_count, count(*) as gold_row_count, count(*) - count(distinct shot_id) as duplicate_shot_ids,
        cast(0 as bigint) as invalid_shot_value_rows, cast(0 as bigint) as missing_shot_made_flag, cast(0 as bigint) as missing_opponent_team_id,
        cast(sum(case when team_id <> home_team_id and team_id <> away_team_id then 1 else 0 end) as bigint) as is_home_mismatches,
        cast(0 as bigint) as row_count_delta,
        cast(sum(case when team_id <> home_team_id and team_id <> away_team_id then 1 else 0 end) = 0 as int) as passed from v_shots""",
)
def inspect_gold(t):
    return I.inspect_gold(base_rows(t), t["v_shots"], t["v_games"])


def base_rows(t):
    from arcline.plans.gold import base_features

    return base_features(t["v_shots"])


@query(
    "ordered_sample",
    ("v_shots",),
    f"select shot_id, game_id, {n('game_event_id')} as game_event_id, {day('game_date')} as game_date from v_shots order by v_shots.game_date, game_id, v_shots.game_event_id, shot_id limit 10",
)
def ordered_sample(t):
    rows = t["v_shots"].select("shot_id", "game_id", "game_event_id", "game_date")
    return rows.orderBy("game_date", "game_id", "game_event_id", "shot_id").limit(10)


# --- data quality --------------------------------------------------------------------------


def _issue(level: str, table: str, check: str, count: str, message: str) -> str:
    return f"""select '{level}' as "level", '{table}' as "table", '{check}' as "check", concat(cast({count} as string), ' {message}') as message, {n(count)} as "count" """


def _count(source: str, condition: str) -> str:
    return f"(select count(*) from {source} where {condition})"


_SHOT_ISSUES = " union all ".join(
    [
        _issue("critical", "shots", "contract_range", _count("v_shots", "shot_distance > 40"), "out of range (0, 40) on shot_distance"),
        _issue("critical", "shots", "contract_isin", _count("v_shots", "shot_type not in ('2PT Field Goal')"), "other than (''2PT Field Goal'',) on shot_type"),
        _issue("warning", "shots", "missing_shot_zone_basic", _count("v_shots", "shot_zone_basic is null"), "without a value in shot_zone_basic"),
        _issue("warning", "shots", "missing_event_type", "(select count(*) from v_shots)", "without a value in event_type"),
        _issue("critical", "shots", "invalid_period", _count("v_shots", "period not in (1, 2, 3, 4)"), "with period other than [1, 2, 3, 4]"),
        """select 'critical', 'shots', 'row_count_exact', concat('wanted exactly 30 rows, got ', cast(count(*) as string)), count(*) from v_shots""",
        """select 'critical', 'shots', 'duplicate_natural_key', concat(cast(count(*) as string), ' keys used more than once: (''game_id'', ''game_event_id'', ''player_id'')'),
             cast(sum(c - 1) as bigint) from (select count(*) as c from v_shots group by game_id, game_event_id, player_id having count(*) > 1)""",
        """select 'critical', 'shots', 'orphan_player_id', concat(cast(count(*) as string), ' with a player_id unknown to c_custkey'), count(*)
             from v_shots where player_id not in (select c_custkey from customer where c_acctbal > 0)""",
    ]
)


@query("rule_report", ("v_shots",), f'select * from ({_SHOT_ISSUES}) where "count" > 0')
def rule_report(t):
    shots = t["v_shots"]
    contract = (
        ("shot_distance", "range", (0, 40), True),
        ("shot_type", "isin", ("2PT Field Goal",), False),
        ("loc_x", "range", (-300, 300), True),
    )
    rules = Q.contract_rules(shots, contract)
    rules += Q.optional_rules(shots, ("shot_zone_basic", "event_type"))
    rules.append(Q.allowed_rule("period", (1, 2, 3, 4)))
    customers = t["customer"].where(F.col("c_acctbal") > 0)
    return Q.report_union(
        [
            Q.check_rows(shots, "shots", rules, expected=("exact", 30)),
            Q.check_keys(shots, "shots", S.NATURAL_KEYS["shots"]),
            Q.check_reference(shots, "shots", "player_id", customers, "c_custkey"),
        ]
    ).select(*Q.REPORT_COLUMNS)


@query(
    "table_report_games",
    ("v_games",),
    f"""select * from (
      {_issue('critical', 'games', 'contract_column', '(select count(*) from v_games)', 'cannot show absent column season_type')}
      union all {_issue('critical', 'games', 'home_equals_away', _count('v_games', 'home_team_id = away_team_id'), 'game(s) where home equals away')}
      union all {_issue('critical', 'games', 'date_range', _count('v_games', "game_date < date '2024-10-01' or game_date > date '2025-06-30'"), "with game_date beyond (''2024-10-01'', ''2025-06-30''), the days of 2024-25")}
      union all select 'critical', 'games', 'row_count_exact', concat('wanted exactly 1230 rows, got ', cast(count(*) as string)), count(*) from v_games
      ) where "count" > 0""",
)
def table_report_games(t):
    tables = {"teams": t["v_teams"]}
    return Q.check_table("games", t["v_games"], season="2024-25", tables=tables).select(*Q.REPORT_COLUMNS)


_BAD_GOLD = {
    "loc_x": "s.loc_x % 7 = 0",
    "game_date": "s.period = 7",
    "shot_distance": "s.shot_distance % 10 = 3",
    "shot_value": "s.loc_y % 11 = 0",
}


@query(
    "gold_contract",
    ("v_shots",),
    f"""select * from (
      {_issue('critical', 'gold_shot_features', 'contract_column', '(select count(*) from v_shots)', 'cannot show absent column shot_angle')}
      union all {_issue('critical', 'gold_shot_features', 'contract_type', '(select count(*) from v_shots)', 'unreadable as bigint in shot_id')}
      union all {_issue('critical', 'gold_shot_features', 'contract_type', f"(select count(*) from v_shots s where {_BAD_GOLD['loc_x']})", 'unreadable as bigint in loc_x')}
      union all {_issue('critical', 'gold_shot_features', 'contract_type', f"(select count(*) from v_shots s where {_BAD_GOLD['game_date']})", 'unreadable as date in game_date')}
      union all {_issue('critical', 'gold_shot_features', 'contract_type', f"(select count(*) from v_shots s where {_BAD_GOLD['shot_distance']})", 'unreadable as bigint in shot_distance')}
      union all {_issue('critical', 'gold_shot_features', 'contract_isin', f"(select count(*) from v_shots s where {_BAD_GOLD['shot_value']})", 'other than (2, 3) on shot_value')}
      union all {_issue('critical', 'gold_shot_features', 'contract_not_null', "(select count(*) from v_shots s where s.period = 6)", 'NULL in season')}
      ) where "count" > 0""",
)
def gold_contract(t):
    """All 44 gold columns against their contract, with bad values of every kind put in."""
    bad = {name: F.expr(condition.replace("s.", "")) for name, condition in _BAD_GOLD.items()}
    season = F.when(F.col("period") != 6, F.col("season"))
    rows = base_rows(t).select("*", *[condition.alias(f"_{name}") for name, condition in bad.items()])
    planted = rows.withColumns(
        {
            "loc_x": F.when(F.col("_loc_x"), F.lit("far")).otherwise(F.col("loc_x").cast("string")),
            "game_date": F.when(F.col("_game_date"), F.lit("some day")).otherwise(F.col("game_date").cast("string")),
            "shot_distance": F.col("shot_distance") + F.when(F.col("_shot_distance"), 0.5).otherwise(0.0),
            "shot_value": F.when(F.col("_shot_value"), F.lit("4.0")).otherwise(F.col("shot_value").cast("string")),
            "season": season,
        }
    )
    empty = {f.name: F.lit(None).cast(f.dataType) for f in S.GOLD.fields if f.name not in rows.columns}
    known = {"score_margin_missing": F.lit(True), "feature_set_version": F.lit("base_v1")}
    gold_rows = planted.withColumns({**empty, **known}).drop("shot_angle", *[f"_{name}" for name in bad])
    report = Q.check_gold(gold_rows, season="none")
    return report.where(F.col("check").startswith("contract")).select(*Q.REPORT_COLUMNS)


_RAW_TYPES = "GAME_ID bigint, GAME_EVENT_ID bigint, MINUTES_REMAINING bigint, SHOT_ATTEMPTED_FLAG boolean not null, SHOT_ZONE_BASIC double, SHOT_DISTANCE double, SHOT_MADE_FLAG boolean"


@query(
    "typed_reject_counts",
    ("v_raw_shots",),
    f"""select * from (
      select 'MINUTES_REMAINING' as "column", 'not bigint' as problem, {n("count(*)")} as "count" from v_raw_shots where MINUTES_REMAINING = 'n/a'
      union all select 'SHOT_ATTEMPTED_FLAG', 'missing', {n("count(*)")} from v_raw_shots where SHOT_ATTEMPTED_FLAG is null
      union all select 'SHOT_ZONE_BASIC', 'not double', {n("count(*)")} from v_raw_shots) where "count" > 0""",
)
def typed_reject_counts(t):
    from pyspark.sql.types import StructType

    _, rejected = Q.typed_rows(t["v_raw_shots"], StructType.fromDDL(_RAW_TYPES))
    return Q.reason_counts(rejected)


@query(
    "typed_good_rows",
    ("v_raw_shots",),
    f"""select {n('count(*)')} as good, {n('sum(cast(GAME_ID as bigint))')} as games,
          {n("sum(cast(replace(GAME_EVENT_ID, '.0', '') as bigint))")} as events, {n('sum(cast(MINUTES_REMAINING as bigint))')} as minutes,
          {n("sum(case when SHOT_MADE_FLAG = '1' then 1 else 0 end)")} as made
        from v_raw_shots where MINUTES_REMAINING <> 'n/a' and SHOT_ATTEMPTED_FLAG is not null""",
)
def typed_good_rows(t):
    from pyspark.sql.types import StructType

    kinds = _RAW_TYPES.replace("SHOT_ZONE_BASIC double, ", "")
    good, _ = Q.typed_rows(t["v_raw_shots"], StructType.fromDDL(kinds))
    return good.agg(
        F.count(F.lit(1)).alias("good"),
        F.sum("GAME_ID").alias("games"),
        F.sum("GAME_EVENT_ID").alias("events"),
        F.sum("MINUTES_REMAINING").alias("minutes"),
        F.sum(F.col("SHOT_MADE_FLAG").cast("int")).alias("made"),
    )


@query(
    "orphan_rows",
    (),
    """select l_partkey, count(*) as "rows" from lineitem where l_partkey not in (select p_partkey from part where p_size > 10) group by 1""",
)
def orphan_rows(t):
    return Q.orphan_rows(t["lineitem"], "l_partkey", t["part"].where(F.col("p_size") > 10), "p_partkey")


@query(
    "reference_counts",
    (),
    """select 'nation' as child, count(*) as orphans from nation where n_regionkey not in (select r_regionkey from region)
       union all select 'labels', count(*) from labels where doc_id not in (select doc_id from documents)
       union all select 'orders', count(*) from orders where o_custkey not in (select c_custkey from customer)""",
)
def reference_counts(t):
    pairs = (
        ("nation", "n_regionkey", "region", "r_regionkey"),
        ("labels", "doc_id", "documents", "doc_id"),
        ("orders", "o_custkey", "customer", "c_custkey"),
    )
    return Q.report_union(
        [
            Q.orphan_rows(t[child], column, t[parent], key)
            .agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("orphans"))
            .select(F.lit(child).alias("child"), "orphans")
            for child, column, parent, key in pairs
        ]
    )


@query(
    "manifest_newest",
    (),
    f"""select dataset, season, cast(user_id as string) as source, {n('event_id')} as row_count from (
          select *, event_type as dataset, cast(user_id % 3 as string) as season, row_number() over (partition by event_type, user_id % 3 order by ts desc) as pick from events)
        where pick = 1""",
)
def manifest_newest(t):
    entries = t["events"].select(
        F.col("event_type").alias("dataset"),
        F.col("user_id").cast("string").alias("source"),
        (F.col("user_id") % 3).cast("string").alias("season"),
        F.col("ts").cast("timestamp").alias("downloaded_at"),
        F.col("event_id").alias("row_count"),
    )
    return newest_entries(entries).drop("downloaded_at")


# --- metrics -------------------------------------------------------------------------------

_AUC = """(select (sum(case when y then rk end) - p * (p + 1) / 2) / (p * cast(q as double))
      from (select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2e0 as rk,
                   count(case when y then 1 end) over () as p, count(case when not y then 1 end) over () as q from %s) group by p, q)"""


@query(
    "classification_metrics",
    ("v_scored",),
    f"""with x as (select shot_made_flag as y, predicted_make_probability as s from v_scored)
    select {r(_AUC % 'x')} as auc, {r('(select avg(-ln(case when y then s else 1 - s end)) from x)')} as log_loss,
           {r('(select avg((cast(y as int) - s) ** 2) from x)')} as brier_score, {r('(select avg(cast((s >= 0.5) = y as int)) from x)')} as accuracy""",
)
def classification_metrics(t):
    return K.classification_metrics(t["v_scored"], "predicted_make_probability", "shot_made_flag")


@query(
    "metrics_with_ties",
    ("v_scored",),
    f"""with x as (select shot_made_flag as y, (shot_distance + 1) / 51e0 as s from v_scored) select {r(_AUC % 'x')} as auc""",
)
def metrics_with_ties(t):
    tied = t["v_scored"].withColumn("s", (F.col("shot_distance") + 1) / 51.0)
    return K.classification_metrics(tied, "s", "shot_made_flag").select("auc")


@query(
    "calibration",
    ("v_scored",),
    f"""with e as (select unnest(quantile_cont(predicted_make_probability, [{', '.join(f'{i / 10}' for i in range(1, 10))}])) as edge from v_scored),
      b as (select s.*, (select count(*) from e where edge < s.predicted_make_probability) as bin from v_scored s)
    select {n('bin')} as bin, {r('avg(predicted_make_probability)')} as mean_predicted, {r('avg(cast(shot_made_flag as int))')} as actual_rate, count(*) as shot_count
    from b group by bin""",
)
def calibration(t):
    return K.calibration_table(t["v_scored"], "predicted_make_probability", "shot_made_flag")


@query(
    "score_histogram",
    ("v_scored",),
    f"""select {n('least(floor((predicted_make_probability - lo) / ((hi - lo) / 50)) + 1, 50)')} as bin, count(*) as shot_count
        from v_scored, (select min(predicted_make_probability) as lo, max(predicted_make_probability) as hi from v_scored) group by 1""",
)
def score_histogram(t):
    return K.score_histogram(t["v_scored"], "predicted_make_probability")


@query(
    "score_ranges",
    ("v_shots", "v_scored"),
    f"""with {_SPLIT} select split, {r('avg(cast(shot_made_flag as int))')} as target_mean, {r('avg(predicted_make_probability)')} as score_mean,
        {r('min(predicted_make_probability)')} as score_min, {r('max(predicted_make_probability)')} as score_max
        from v_scored s join labels l on l.game_id = s.game_id group by split""",
)
def score_ranges(t):
    return K.score_ranges(time_split(t["v_scored"]), "predicted_make_probability", "shot_made_flag")


@query(
    "exact_quantiles",
    (),
    " union all ".join(
        f"select {q} as share, {r(f'quantile_cont(l_extendedprice, {q})')} as value from lineitem"
        for q in (0.05, 0.25, 0.5, 0.75, 0.95)
    ),
)
def quantile_rows(t):
    shares = [0.05, 0.25, 0.5, 0.75, 0.95]
    values = exact_quantiles(t["lineitem"], "l_extendedprice", shares)
    return t.spark.createDataFrame(list(zip(shares, values)), "share double, value double")


_AUDITED = ("shot_distance", "loc_x", "period", "predicted_make_probability", "leaked")


@query(
    "feature_auc_audit",
    ("v_scored",),
    f"""with x as (select *, case when loc_x < 200 then cast(shot_made_flag as int) end as leaked from v_scored),
      a as ({' union all '.join(f"select '{c}' as feature, {_AUC % f'(select shot_made_flag as y, {c} as s from x where {c} is not null)'} as auc, (select avg(cast({c} is null as int)) from x) as m" for c in _AUDITED)})
    select feature, {r('auc')} as auc, {r('greatest(auc, 1 - auc)')} as separation, {r('m * 100')} as missing_pct, cast(greatest(auc, 1 - auc) >= 0.9 as int) as suspicious from a""",
)
def feature_auc_audit(t):
    leaked = F.when(F.col("loc_x") < 200, F.col("shot_made_flag").cast("int"))
    rows = t["v_scored"].withColumn("leaked", leaked)
    return K.feature_auc_audit(rows, [*_AUDITED, "not_there"], "shot_made_flag")


# --- models (rows-only: fitted by iteration) -----------------------------------------------

_MODEL_FEATURES = M.feature_columns("tabular")


def _modelling_rows(t):
    """(train, test) of all gold rows with all tabular features, derived once."""
    kept = ["shot_id", "game_id", "game_date", *_MODEL_FEATURES, S.TARGET]
    ready = written_once(M.model_frame(gold(t).select(*kept), _MODEL_FEATURES), "modelling")
    rows = time_split(ready, one_date_per_game=True)
    return rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test")


def _scores(model, test):
    return M.score(model, test).select("shot_id", M.PROBABILITY)


@query("logistic_scores")
def logistic_scores(t):
    train, test = _modelling_rows(t)
    return _scores(M.fit_logistic(train, _MODEL_FEATURES), test)


@query(
    "logistic_training_rate",
    ("v_shots",),
    f"""with {_SPLIT} select count(*) as train_rows, round(avg(cast(s.shot_made_flag as int)), 3) as rate,
        round(avg(cast(s.shot_made_flag as int)), 3) as mean_probability, cast(1 as int) as in_range
        from v_shots s join labels l on l.game_id = s.game_id where l.split = 'train'""",
)
def logistic_training_rate(t):
    """At its optimum a logistic model's mean training probability is the training rate."""
    train, _ = _modelling_rows(t)
    scored = M.score(M.fit_logistic(train, _MODEL_FEATURES), train)
    return scored.agg(
        F.count(F.lit(1)).alias("train_rows"),
        F.round(F.avg(S.TARGET), 3).alias("rate"),
        F.round(F.avg(M.PROBABILITY), 3).alias("mean_probability"),
        F.bool_and(F.col(M.PROBABILITY).between(0, 1)).alias("in_range"),
    )


@query(
    "logistic_scored_rows",
    ("v_shots",),
    f"""with {_SPLIT} select s.shot_id, cast(1 as int) as in_range from v_shots s join labels l on l.game_id = s.game_id where l.split = 'test'""",
)
def logistic_scored_rows(t):
    """Every test shot gets one probability."""
    train, test = _modelling_rows(t)
    scored = _scores(M.fit_logistic(train, _MODEL_FEATURES), test)
    return scored.select("shot_id", F.col(M.PROBABILITY).between(0, 1).alias("in_range"))


@query("tree_scores")
def tree_scores(t):
    train, test = _modelling_rows(t)
    return _scores(M.fit_trees(train, _MODEL_FEATURES), test)


@query("network_scores")
def network_scores(t):
    train, test = _modelling_rows(t)
    return _scores(M.fit_network(train, _MODEL_FEATURES), test)


@query("model_comparison")
def model_comparison(t):
    train, test = _modelling_rows(t)
    linear = M.fit_logistic(train, _MODEL_FEATURES)
    trees = M.fit_trees(train, _MODEL_FEATURES)
    return M.compare_models({"logistic": M.score(linear, test), "trees": M.score(trees, test)})


@query("model_search")
def model_search(t):
    train, test = _modelling_rows(t)
    _, leaderboard, _ = M.search_trees(train, test, _MODEL_FEATURES)
    return leaderboard


@query("tree_importance")
def tree_importance(t):
    train, _ = _modelling_rows(t)
    model = M.fit_trees(train, _MODEL_FEATURES)
    gain = M.feature_importance(model, _MODEL_FEATURES)
    splits = M.feature_importance(model, _MODEL_FEATURES, "split")
    return gain.join(splits.withColumnRenamed("importance", "splits"), "feature")


@query("single_feature_models")
def single_feature_models(t):
    train, test = _modelling_rows(t)
    return M.audit_single_features(train, test, _MODEL_FEATURES)


_MISSING_SHARES = ", ".join(f"100.0 * avg(cast({c} is null as int)) as {c}" for c in _MODEL_FEATURES)


@query(
    "single_feature_missing",
    GOLD_VIEWS,
    f"""with gold as ({_GOLD_SQL}), {_SPLIT},
      shares as (select split, {_MISSING_SHARES} from gold g join labels l on l.game_id = g.game_id group by split),
      long as ({' union all '.join(f"select split, '{c}' as feature, {c} as pct from shares" for c in _MODEL_FEATURES)})
    select feature, {r("max(case when split = 'train' then pct end)")} as train_missing_pct,
        {r("max(case when split = 'test' then pct end)")} as test_missing_pct from long group by feature""",
)
def single_feature_missing(t):
    """The missing shares that single_feature_models reports, of all 31 features."""
    train, test = _modelling_rows(t)
    return M.missing_shares(train, test, _MODEL_FEATURES)


@query(
    "rejected_rows",
    ("v_shots", "v_player_logs"),
    """select shot_id, 'missing: player_recent_fg_pct_5' as reason from v_shots s
       where not exists (select 1 from v_player_logs p where p.player_id = s.player_id and (p.game_date, p.game_id) < (s.game_date, s.game_id))""",
)
def rejected_rows(t):
    from arcline.operators import form as R

    form = R.player_form(t["v_player_logs"], unique_key=True)
    rows = R.attach_form(base_rows(t), form, {"game_id": "game_id", "player_id": "player_id"})
    features = ["shot_distance", "player_recent_fg_pct_5"]
    kept = rows.select("shot_id", "shot_value", *features, S.TARGET)
    ready = written_once(M.model_frame(kept, features), "rejected")
    model = M.fit_logistic(ready, features, max_iter=5)
    return M.score_with_errors(model, ready, features, "shot_id")[1]


@query(
    "sequence_statistics",
    ("v_events", "v_event_shots"),
    f"""with {_SLOTS}, total as (select 5e0 * count(*) as c from v_event_shots)
    {' union all '.join(f"select '{f}' as field, {r(f'sum(coalesce(cast({f} as double), 0)) / max(c)')} as mean from records, total" for f in ('event_order_from_shot', 'period', 'is_turnover', 'same_team_as_shooter'))}""",
)
def sequence_statistics(t):
    found = M.sequence_statistics(build_sequences(t["v_event_shots"], t["v_events"]))
    fields = ("event_order_from_shot", "period", "is_turnover", "same_team_as_shooter")
    return t.spark.createDataFrame([(f, found[f][0]) for f in fields], "field string, mean double")


def _sequence_rows(t):
    """(train, test) of all shots with the 62 'pressure' columns and ``seq``, derived once."""
    features = M.feature_columns("sequence")
    shots, *logs = t.together(*GOLD_VIEWS[:3])
    parts = t.parts()
    sequences = build_sequences(shots, t["v_line_events"], parts=parts)
    # Gold rows are dealt by game only where there are many.
    within = "game_id" if parts else None
    rows = attach_pressure(M.add_spatial(gold_of(t, shots, *logs)), sequences, keep_seq=True, within=within)
    kept = ["shot_id", "game_id", "game_date", "seq", *features, S.TARGET]
    ready = time_split(written_once(M.model_frame(rows.select(*kept), features), "sequences"), one_date_per_game=True)
    return ready.where(F.col("split") == "train"), ready.where(F.col("split") == "test")


@query("challenger_scores")
def challenger_scores(t):
    train, test = _sequence_rows(t)
    return _scores(M.fit_challenger(train), test)


@query(
    "home_flag_check",
    ("v_shots",),
    f"""with flagged as (select *, case when game_event_id % 5 = 0 then team_id <> home_team_id else team_id = home_team_id end as is_home from v_shots)
        select season, {n('sum(case when is_home and team_id <> home_team_id then 1 else 0 end)')} as is_home_true_but_away,
        {n('sum(case when not is_home and team_id <> away_team_id then 1 else 0 end)')} as is_home_false_but_home,
        count(*) as total_rows from flagged group by season""",
)
def home_flag_check(t):
    """Every fifth flag is turned round, so both directions have rows to find."""
    rows = base_rows(t)
    turned = F.when(F.col("game_event_id") % 5 == 0, ~F.col("is_home")).otherwise(F.col("is_home"))
    return I.home_flag_check(rows.withColumn("is_home", turned), t["v_games"], ["season"])
