"""The provided tables seen as shots, games, logs and events.

Each view is one SQL text that Spark and DuckDB both read, so the checking SQL starts from
the same rows as the operators without sharing any of their code. All rows of the tables
take part.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcline.operators.clean import evaluate_once
from arcline.session import small_reads

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)

# name -> (views it reads, SQL). Listed so that a view only reads earlier ones.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_teams": (
        (),
        """select s_suppkey as team_id, s_name as full_name,
                  concat('T', right(s_name, 4)) as abbreviation, s_nationkey as city_id
           from supplier""",
    ),
    "v_games": (
        (),
        """select o.o_orderkey as game_id, cast(year(o.o_orderdate) as string) as season,
                  cast(o.o_orderdate as date) as game_date,
                  l.home_team_id as home_team_id, l.away_team_id as away_team_id
           from orders o join (
               select l_orderkey, min(l_suppkey) as home_team_id, max(l_suppkey) as away_team_id
               from lineitem group by l_orderkey) l on o.o_orderkey = l.l_orderkey""",
    ),
    "v_shots": (
        ("v_games",),
        """select concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string),
                            cast(l_partkey as string), cast(l_suppkey as string)) as shot_id,
                  l_orderkey as game_id, l_linenumber as game_event_id, o_custkey as player_id,
                  l_suppkey as team_id, g.home_team_id as home_team_id, g.away_team_id as away_team_id,
                  g.season as season, g.game_date as game_date,
                  case when l_returnflag = 'R' then '3PT Field Goal' else '2PT Field Goal' end as shot_type,
                  l_linestatus = 'F' as shot_made_flag,
                  cast(l_quantity as bigint) - 1 as shot_distance,
                  l_partkey % 501 - 250 as loc_x, l_partkey % 400 - 50 as loc_y,
                  l_linenumber as period,
                  cast(floor(l_extendedprice) as bigint) % 12 as minutes_remaining,
                  cast(floor(l_extendedprice) as bigint) % 60 as seconds_remaining,
                  case when l_returnflag = 'A' then 'Left Corner 3'
                       when l_returnflag = 'N' then 'Mid-Range' end as shot_zone_basic,
                  l_linestatus as shot_zone_area,
                  case when l_quantity < 17 then 'near' when l_quantity < 34 then 'middle' else 'far' end as shot_zone_range
           from lineitem join orders on l_orderkey = o_orderkey join v_games g on g.game_id = l_orderkey""",
    ),
    "v_scored": (
        ("v_games", "v_shots"),
        """select s.shot_id, s.game_id, s.player_id, s.team_id, s.game_date, s.period,
                  case when s.shot_type = '3PT Field Goal' then 3 else 2 end as shot_value,
                  s.shot_made_flag, s.shot_distance, s.loc_x, s.loc_y,
                  coalesce(s.shot_zone_basic, 'Above the Break') as shot_zone_basic,
                  s.shot_zone_area, s.shot_zone_range,
                  1 / (1 + exp((s.shot_distance - 25) / 31e0 + s.loc_x / 773e0 - s.seconds_remaining / 977e0)) as predicted_make_probability
           from v_shots s""",
    ),
    "v_open": (
        ("v_games", "v_shots", "v_scored"),
        """select s.*, case when s.shot_zone_range = 'far' and s.period = 7 then null
                            else s.shot_made_flag end as outcome
           from v_scored s""",
    ),
    "v_player_logs": (
        (),
        """select o_orderkey as game_id, o_custkey as player_id, cast(o_orderdate as date) as game_date,
                  l.fgm as field_goals_made, l.fga as field_goals_attempted,
                  l.fg3m as three_pointers_made, l.fg3a as three_pointers_attempted,
                  o_totalprice / 9973e0 as minutes, l.pts as points
           from orders join (
               select l_orderkey, cast(sum(case when l_linestatus = 'F' then 1 else 0 end) as bigint) as fgm,
                      count(*) as fga,
                      cast(sum(case when l_linestatus = 'F' and l_returnflag = 'R' then 1 else 0 end) as bigint) as fg3m,
                      cast(sum(case when l_returnflag = 'R' then 1 else 0 end) as bigint) as fg3a,
                      cast(sum(l_quantity) as bigint) as pts
               from lineitem group by l_orderkey) l on l.l_orderkey = o_orderkey""",
    ),
    "v_team_logs": (
        (),
        """select l_orderkey as game_id, l_suppkey as team_id, cast(min(o_orderdate) as date) as game_date,
                  cast(sum(case when l_linestatus = 'F' then 1 else 0 end) as bigint) as field_goals_made,
                  count(*) as field_goals_attempted,
                  cast(sum(case when l_returnflag = 'R' then 1 else 0 end) as bigint) as three_pointers_attempted,
                  cast(sum(l_linenumber) as bigint) as free_throws_attempted,
                  cast(sum(case when l_tax > 0.045 then 1 else 0 end) as bigint) as offensive_rebounds,
                  cast(sum(case when l_discount > 0.065 then 1 else 0 end) as bigint) as turnovers,
                  cast(sum(l_quantity) as bigint) as points
           from lineitem join orders on o_orderkey = l_orderkey group by l_orderkey, l_suppkey""",
    ),
    "v_events": (
        (),
        """select user_id as game_id, event_id as action_number, 1 + day(ts) % 6 as period,
                  case when event_id % 11 = 0 then concat('PT', cast(second(ts) as string), '.25S')
                       when event_id % 13 = 0 then 'late'
                       else concat('PT', cast(minute(ts) % 12 as string), 'M', cast(second(ts) as string), '.50S') end as game_clock,
                  case when event_id % 7 = 0 then null else 1 + event_id % 3 end as team_id,
                  event_type = 'purchase' as is_field_goal,
                  case when event_type = 'purchase' and value > 20 then 'Made'
                       when event_type = 'purchase' then 'Missed' end as shot_result,
                  case when event_type = 'purchase' and value > 20 then cast(floor(value) as bigint) end as score_home,
                  case when event_type = 'signup' and value > 20 then cast(floor(value) as bigint) end as score_away,
                  case when event_type = 'view' then 'Rebound' when event_type = 'click' then 'Turnover'
                       when event_type = 'error' then 'Foul' when event_type = 'signup' then 'Timeout'
                       when value > 100 then 'Jump Ball' end as action_type,
                  case when event_type = 'view' and event_id % 2 = 0 then 'Offensive'
                       when event_type = 'view' then 'Defensive'
                       when event_type = 'click' and event_id % 2 = 0 then 'Steal'
                       when event_type = 'error' and event_id % 4 = 0 then 'Free Throw'
                       when event_type = 'error' and event_id % 4 = 1 then 'Offensive Violation'
                       when event_type = 'signup' and event_id % 5 = 0 then 'Sub: in' end as sub_type
           from events""",
    ),
    "v_event_shots": (
        (),
        """select event_id as shot_id, user_id as game_id,
                  case when event_id % 5 = 0 then event_id + 1 else event_id end as game_event_id,
                  1 + event_id % 2 as team_id, cast(1 as bigint) as home_team_id, cast(2 as bigint) as away_team_id,
                  1 + day(ts) % 6 as period, minute(ts) % 12 as minutes_remaining, second(ts) as seconds_remaining,
                  1 + event_id % 2 = 1 as is_home
           from events where event_type = 'purchase'""",
    ),
    # Every line of an order as an event of its game, typed by its part and flags.
    "v_line_events": (
        (),
        """select l_orderkey as game_id, l_linenumber as action_number, l_linenumber as period,
                  concat('PT', cast(cast(floor(l_extendedprice) as bigint) % 12 as string), 'M',
                         cast(cast(floor(l_extendedprice) as bigint) % 60 as string), '.00S') as game_clock,
                  case when l_partkey % 17 = 0 then null else l_suppkey end as team_id,
                  l_partkey % 3 = 0 as is_field_goal,
                  case when l_partkey % 3 = 0 and l_linestatus = 'F' then 'Made'
                       when l_partkey % 3 = 0 then 'Missed' end as shot_result,
                  case when l_partkey % 2 = 0 then cast(l_linenumber * 3 as bigint) end as score_home,
                  case when l_partkey % 2 = 1 then cast(l_linenumber * 2 as bigint) end as score_away,
                  case when l_partkey % 3 = 0 then null when l_returnflag = 'R' then 'Rebound'
                       when l_returnflag = 'A' then 'Turnover' when l_partkey % 5 = 0 then 'Timeout' else 'Foul' end as action_type,
                  case when l_returnflag = 'R' and l_tax > 0.04 then 'Offensive' when l_returnflag = 'R' then 'Defensive'
                       when l_returnflag = 'A' and l_tax > 0.04 then 'Steal' end as sub_type
           from lineitem""",
    ),
    "v_raw_shots": (
        (),
        """select cast(l_orderkey as string) as GAME_ID, concat(cast(l_linenumber as string), '.0') as GAME_EVENT_ID,
                  cast(o_custkey as string) as PLAYER_ID, cast(l_suppkey as string) as TEAM_ID,
                  cast(l_linenumber as string) as PERIOD,
                  case when l_tax = 0.08 then 'n/a' else cast(l_linenumber % 12 as string) end as MINUTES_REMAINING,
                  '30' as SECONDS_REMAINING, 'Made Shot' as EVENT_TYPE, p_type as ACTION_TYPE,
                  case when l_returnflag = 'R' then '3PT Field Goal' else '2PT Field Goal' end as SHOT_TYPE,
                  l_returnflag as SHOT_ZONE_BASIC, l_linestatus as SHOT_ZONE_AREA, p_brand as SHOT_ZONE_RANGE,
                  cast(cast(l_quantity as bigint) as string) as SHOT_DISTANCE,
                  cast(l_partkey % 501 - 250 as string) as LOC_X, cast(l_suppkey % 400 - 50 as string) as LOC_Y,
                  case when l_discount = 0.1 then null else '1' end as SHOT_ATTEMPTED_FLAG,
                  case when l_linestatus = 'F' then '1' else '0' end as SHOT_MADE_FLAG,
                  case when l_linenumber < 4 then replace(cast(cast(o_orderdate as date) as string), '-', '')
                       else cast(cast(o_orderdate as date) as string) end as GAME_DATE,
                  'AAA' as HTM, 'BBB' as VTM, c_name as PLAYER_NAME, l_shipdate as ignored
           from lineitem join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey
                join customer on c_custkey = o_custkey""",
    ),
    "v_raw_logs": (
        (),
        """select cast(year(o_orderdate) as string) as SEASON_YEAR, cast(o_orderkey as string) as GAME_ID,
                  cast(o_custkey as string) as PLAYER_ID, cast(c_nationkey + 1 as string) as TEAM_ID,
                  cast(cast(o_orderdate as date) as string) as GAME_DATE,
                  concat(' N', right(n_name, 1), 'A vs. XYZ ') as MATCHUP,
                  case when o_orderstatus = 'F' then 'w' when o_orderstatus = 'O' then ' L ' else '?' end as WL,
                  case when o_orderkey % 3 = 0 then concat(cast(o_orderkey % 48 as string), ':30')
                       when o_orderkey % 3 = 1 then cast(o_orderkey % 48 as string) else 'DNP' end as MIN,
                  cast(o_orderkey % 17 as string) as FGM, concat(cast(o_orderkey % 29 as string), '.0') as FGA,
                  cast(o_orderkey % 7 / 8e0 as string) as FG_PCT,
                  cast(o_orderkey % 5 as string) as PTS, concat('Dr ', c_name) as PLAYER_NAME
           from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey""",
    ),
    "v_raw_events": (
        (),
        """select cast(user_id as string) as gameId, cast(floor(value) as string) as actionNumber,
                  cast(event_id as string) as actionId, ' PT05M00.00S ' as clock,
                  cast(1 + event_id % 4 as string) as period, cast(event_id % 4 as string) as teamId,
                  cast(event_id % 3 as string) as personId,
                  case when event_type = 'view' then 'nan' when event_type = 'click' then '  ' else concat(' ', event_type, ' ') end as playerName,
                  case when event_type = 'purchase' then '1' else '0' end as isFieldGoal,
                  case when event_type = 'error' then 'x' else cast(event_id as string) end as scoreHome,
                  event_type as description, event_type as actionType, null as subType
           from events""",
    ),
    # Two log rows per order: the view of each of its first and last supplier. Some orders
    # have one supplier, some rows disagree, some texts are malformed.
    "v_raw_team_logs": (
        ("v_games",),
        """select cast(g.game_id as string) as GAME_ID, g.season as SEASON_YEAR,
                  cast(g.game_date as string) as GAME_DATE,
                  concat('T', chr(cast(65 + g.home_team_id % 26 as int)),
                         case when g.game_id % 19 = 0 then ' versus ' when g.game_id % 23 = 0 then ' @ ' else ' vs. ' end,
                         'T', chr(cast(65 + g.away_team_id % 26 as int))) as MATCHUP,
                  concat('t', lower(chr(cast(65 + g.home_team_id % 26 as int)))) as TEAM_ABBREVIATION
           from v_games g
           union all
           select cast(g.game_id as string), g.season, cast(g.game_date as string),
                  concat('T', chr(cast(65 + g.away_team_id % 26 as int)),
                         case when g.game_id % 29 = 0 then ' vs ' else ' @ ' end,
                         'T', chr(cast(65 + g.home_team_id % 26 as int))),
                  concat('T', chr(cast(65 + g.away_team_id % 26 as int)))
           from v_games g""",
    ),
    "v_letters": (
        (),
        """select cast(n_nationkey + 1 as bigint) as team_id, concat('T', chr(cast(65 + n_nationkey as int))) as abbreviation
           from nation""",
    ),
}


def with_views(names: tuple[str, ...], body: str) -> str:
    """``body`` with the views it needs as common table expressions."""
    needed: list[str] = []
    for name in VIEWS:
        wanted = set(names)
        for other in names:
            wanted |= set(VIEWS[other][0])
        if name in wanted:
            needed.append(name)
    head = ",\n".join(f"{name} as ({VIEWS[name][1]})" for name in needed)
    if not head:
        return body
    stripped = body.lstrip()
    if stripped.lower().startswith("with "):
        return f"with {head},\n{stripped[5:]}"
    return f"with {head}\n{body}"


# Bytes of a table's files per partition where rows are dealt by order.
PART_BYTES = 1 << 20


def dealt_once(rows: DataFrame, parts: int, key: str, text: str) -> DataFrame:
    """Rows dealt by ``key``, with the columns that ``text`` names wherever the result is used.

    Every use would otherwise drop the columns it does not need below the exchange and so deal the table
    again. The condition always holds; it names all columns and cannot move below the exchange. Rows
    without a key go, since views that read both tables join them by it.
    """
    columns = [c for c in rows.columns if re.search(rf"\b{c}\b", text)]
    dealt = rows.select(*columns).where(F.col(key).isNotNull()).repartition(parts, key)
    return dealt.where((F.spark_partition_id() >= 0) | (F.xxhash64(*columns) == 0))


class Tables:
    """DataFrames of the provided tables and of the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getitem__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.together(name)[0]
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def together(self, *names: str, once: bool = True) -> list[DataFrame]:
        """Views that one query reads: orders and lines are dealt by order once for all of them.

        ``once=False`` suits counts over few columns: a view then deals what the count needs.
        """
        self._register(names, once)
        found = []
        for name in names:
            view = self.spark.sql(with_views((name,), f"select * from {name}"))
            # Raw views stand for files: their texts are made once, not per use.
            found.append(evaluate_once(view) if name.startswith("v_raw") else view)
        return found

    def _register(self, names: tuple[str, ...], once: bool) -> None:
        # Views that do not join orders and lines would carry columns of the others for nothing.
        texts = [with_views((name,), "") for name in names]
        by_order = {"orders": "o_orderkey", "lineitem": "l_orderkey"}
        text = "\n".join(texts)
        used = [table for table in TABLES if f" {table}" in text]
        joined = all(f" {table}" in each for table in by_order for each in texts)
        parts = self.parts() if joined else None
        if parts:
            small_reads(self.spark)
        for table in used:
            rows = self[table]
            if table in by_order and parts:
                # Both sides dealt by order: a task of the joins and sums by order stays small.
                key = by_order[table]
                rows = dealt_once(rows, parts, key, text) if once else rows.repartition(parts, key)
            rows.createOrReplaceTempView(table)

    def parts(self) -> int | None:
        """Partitions of rows dealt by order: one for every ``PART_BYTES`` of the lines' files; None for few."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/lineitem.parquet")
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        parts = store.getContentSummary(path).getLength() // PART_BYTES
        return parts if parts > self.spark.sparkContext.defaultParallelism else None
