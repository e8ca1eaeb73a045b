"""Queries on inputs that are easy to get wrong: text orders, missing keys, many large keys,
unpadded ids, missing dates, repeated teams, mixed formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from arcline.operators import form as R
from arcline.operators import split as D
from arcline.operators.skew import plan_slices
from arcline.operators.windows import shift_roll
from arcline.plans.tables import build_tables

from .feature_queries import _ALLOWED
from .registry import n, query, r

MEASURES = {"prior_sum": ("sum", "o_totalprice"), "prior_mean": ("avg", "o_totalprice")}
# Rows per slice small enough that almost every customer is cut.
TINY_SLICE = 3


def _rolled(key: str, order: str, source: str = "orders") -> str:
    return f"""select o_orderkey, {r('sum(o_totalprice) over w')} as prior_sum, {r('avg(o_totalprice) over w')} as prior_mean
        from {source} window w as (partition by {key} order by {order} rows between 5 preceding and 1 preceding)"""


_CODED = "(select *, concat('order-', md5(cast(o_orderkey as varchar))) as code from orders)"


@query("text_order_roll", (), _rolled("o_orderstatus", "code", _CODED))
def text_order_roll(t):
    keys, order = ["o_orderstatus"], ["code"]
    code = F.concat(F.lit("order-"), F.md5(F.col("o_orderkey").cast("string"))).alias("code")
    orders = t["orders"].select("o_orderkey", *keys, code, "o_totalprice")
    slices = plan_slices(orders, keys, order, rows_per_slice=1000)
    return shift_roll(orders, keys, order, MEASURES, slices=slices).select("o_orderkey", *MEASURES)


_URGENT = "(select *, nullif(o_orderpriority, '1-URGENT') as priority from orders)"


@query("null_key_roll", (), _rolled("priority", "o_orderdate, o_orderkey", _URGENT))
def null_key_roll(t):
    keys, order = ["priority"], ["o_orderdate", "o_orderkey"]
    orders = t["orders"].withColumn("priority", F.nullif("o_orderpriority", F.lit("1-URGENT")))
    orders = orders.select("o_orderkey", "priority", "o_orderdate", "o_totalprice")
    slices = plan_slices(orders, keys, order, rows_per_slice=1000)
    return shift_roll(orders, keys, order, MEASURES, slices=slices).select("o_orderkey", *MEASURES)


@query("hot_keys_many", (), _rolled("o_custkey", "o_orderdate, o_orderkey"))
def hot_keys_many(t):
    keys, order = ["o_custkey"], ["o_orderdate", "o_orderkey"]
    orders = t["orders"].select("o_orderkey", *keys, "o_orderdate", "o_totalprice")
    slices = plan_slices(orders, keys, order, rows_per_slice=TINY_SLICE)
    return shift_roll(orders, keys, order, MEASURES, slices=slices).select("o_orderkey", *MEASURES)


def _labels(game: str, date: str) -> str:
    return f"""with games as (select {game} as game_id, min({date}) as game_date from orders group by 1),
    ranked as (
      select *, row_number() over (order by game_date, game_id) as rn, count(*) over () as total
      from games where game_date is not null),
    labels as (select game_id, case when rn <= greatest(1, least(total - 1, floor(total * 0.8))) then 'train' else 'test' end as split from ranked)
    select o_orderkey, split from orders left join labels on game_id = {game}"""


@query("time_split_text_ids", (), _labels("'G' || (o_orderkey % 1000)", "o_orderdate"))
def time_split_text_ids(t):
    rows = t["orders"].select(
        "o_orderkey", F.concat(F.lit("G"), (F.col("o_orderkey") % 1000).cast("string")).alias("game_id"), F.col("o_orderdate").alias("game_date")
    )
    return D.time_split(rows).select("o_orderkey", "split")


@query("time_split_missing_dates", (), _labels("o_custkey", "case when o_custkey % 5 <> 0 then o_orderdate end"))
def time_split_missing_dates(t):
    date = F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderdate"))
    rows = t["orders"].select("o_orderkey", F.col("o_custkey").alias("game_id"), date.alias("game_date"))
    return D.time_split(rows).select("o_orderkey", "split")


_REPEATED = "(select * from v_team_logs union all select * from v_team_logs where points % 3 = 0)"
_SUMS = ", ".join(f"{n(f'sum(b.{c})')} as {c}" for c in _ALLOWED)


@query(
    "opponent_allowed_repeated",
    ("v_team_logs",),
    f"""with logs as {_REPEATED},
    allowed as (
      select a.game_id, a.team_id, {_SUMS}
      from (select distinct game_id, team_id from logs) a join logs b on a.game_id = b.game_id and a.team_id <> b.team_id
      group by a.game_id, a.team_id)
    select l.game_id, l.team_id, cast(l.game_date as string) as game_date, {', '.join(f'allowed.{c}' for c in _ALLOWED)}
    from logs l join allowed using (game_id, team_id)""",
)
def opponent_allowed_repeated(t):
    logs = t["v_team_logs"]
    return R.opponent_allowed(logs.unionByName(logs.where("points % 3 = 0")))


_PAIRS = "select game_id from v_team_logs group by game_id having count(*) = 2"


@query(
    "opponent_two_teams",
    ("v_team_logs",),
    f"""select a.game_id, a.team_id, cast(a.game_date as string) as game_date, {', '.join(f'{n(f"b.{c}")} as {c}' for c in _ALLOWED)}
    from v_team_logs a join v_team_logs b on a.game_id = b.game_id and a.team_id <> b.team_id
    where a.game_id in ({_PAIRS})""",
)
def opponent_two_teams(t):
    logs = t["v_team_logs"]
    pairs = logs.groupBy("game_id").count().where("count = 2").select("game_id")
    return R.opponent_allowed(logs.join(pairs, "game_id", "left_semi"))


@query(
    "load_mixed_dates",
    ("v_raw_shots",),
    f"""with typed as (
      select case when length(GAME_ID) >= 10 then GAME_ID else lpad(GAME_ID, 10, '0') end as game_id,
        {n('try_cast(GAME_EVENT_ID as double)')} as game_event_id, {n('PLAYER_ID')} as player_id,
        try_cast(MINUTES_REMAINING as bigint) as minutes_remaining, length(GAME_DATE) as digits
      from v_raw_shots)
    select cast(digits > 0 as int) as dated, count(distinct (game_id, game_event_id, player_id)) as shot_rows
    from typed where minutes_remaining is not null and player_id > 0 group by 1""",
)
def load_mixed_dates(t):
    raw = {
        "shot_chart": t["v_raw_shots"], "player_game_logs": t["v_raw_logs"],
        "team_game_logs": t["v_raw_logs"], "play_by_play": t["v_raw_events"],
    }
    shots = build_tables(raw, t["v_teams"])[0]["shots"]
    return shots.groupBy(F.col("game_date").isNotNull().alias("dated")).agg(F.count(F.lit(1)).alias("shot_rows"))
