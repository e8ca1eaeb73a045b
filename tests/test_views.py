"""Tables and views: how rows are read and dealt."""

import datetime
import glob
import time

from arcline import session
from arcline.operators import skew
from workloads import views


def test_files_dealt_by_order_are_read_in_small_parts(spark, tmp_path, monkeypatch):
    """A task that deals lines to many partitions holds what it read, so it reads a bounded part of a file."""
    orders = [(i, i % 5, datetime.datetime(1996, 1, 1 + i % 28), 10.0 * i) for i in range(400)]
    lines = [(i // 3, i % 3, i % 7, 1000 + i % 11, float(i % 50), "F", "R", 0.01 * (i % 9), 0.02) for i in range(1200)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(
        lines,
        "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_quantity double, l_linestatus string, l_returnflag string, l_discount double, l_tax double",
    ).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        tables = views.Tables(spark, str(tmp_path))
        plain = sorted(tables["v_team_logs"].collect())
        whole = tables["lineitem"].rdd.getNumPartitions()
        monkeypatch.setattr(views, "PART_BYTES", 1 << 9)
        monkeypatch.setattr(session, "READ_BYTES", 1 << 9)
        assert sorted(tables["v_team_logs"].collect()) == plain
        assert tables["lineitem"].rdd.getNumPartitions() > whole
        assert int(spark.conf.get("spark.sql.files.maxPartitionBytes")) == 1 << 9
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)


def made_season(spark, folder, orders=400):
    """Orders of one to four lines, a few without a key."""
    spark.range(orders).selectExpr(
        "if(id % 97 = 5, null, id) as o_orderkey", "id % 23 as o_custkey", "id * 7.5D as o_totalprice",
        "timestamp'2024-01-01' + make_dt_interval(cast(id % 60 as int)) as o_orderdate", "'F' as o_orderstatus",
    ).write.parquet(f"{folder}/orders.parquet")
    spark.range(orders).selectExpr("id", "explode(sequence(1, 1 + cast(id % 4 as int))) as l_linenumber").selectExpr(
        "if(id % 89 = 7, null, id) as l_orderkey", "l_linenumber", "id * l_linenumber % 31 as l_partkey",
        "(id + l_linenumber) % 11 as l_suppkey", "cast(id % 50 as double) as l_quantity", "id * 11.3D as l_extendedprice",
        "(id % 9) / 100D as l_tax", "(id % 8) / 100D as l_discount", "if(id % 3 = 0, 'R', 'A') as l_returnflag",
        "if(l_linenumber % 2 = 0, 'F', 'O') as l_linestatus",
    ).write.parquet(f"{folder}/lineitem.parquet")
    spark.range(300).selectExpr(
        "id as event_id", "id % 40 as user_id", "timestamp'2024-01-01' + make_dt_interval(0, 0, cast(id as int)) as ts",
        "if(id % 2 = 0, 'purchase', 'signup') as event_type", "cast(id % 60 as double) as value",
    ).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def rows_of(df):
    return sorted(str(row) for row in df.collect())


def test_views_of_one_query_deal_orders_and_lines_once(spark, tmp_path, monkeypatch):
    from workloads.feature_queries import GOLD_VIEWS, gold

    folder = made_season(spark, tmp_path)
    whole = rows_of(gold(views.Tables(spark, folder)))
    apart = [rows_of(views.Tables(spark, folder)[name]) for name in GOLD_VIEWS[:3]]
    monkeypatch.setattr(views, "PART_BYTES", 64)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        t = views.Tables(spark, folder)
        assert t.parts() > spark.sparkContext.defaultParallelism
        found = t.together(*GOLD_VIEWS[:3])
        assert [rows_of(df) for df in found] == apart
        rows = gold(t)
        assert rows_of(rows) == whole and whole
        # Each table is read for one exchange; the other uses are that exchange again.
        plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("ReusedExchange") >= 7
        assert plan.count("Scan parquet [l_orderkey") == 1
        assert plan.count("Scan parquet [o_orderkey") == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_shuffles_go_when_rows_are_written_or_counted(spark):
    def files():
        return {f for d in manager.localDirs() for f in glob.glob(f"{d.getPath()}/**/shuffle_*.data", recursive=True)}

    def left(before):
        deadline = time.time() + 20
        while files() - before and time.time() < deadline:
            time.sleep(0.1)
        return files() - before

    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    setting, before = spark.conf.get(session.DROP_SHUFFLES), files()
    rows = session.written_once(spark.range(1000).repartition(7, "id"), "dealt")
    assert not left(before) and len(rows.collect()) == 1000
    assert skew.plan_slices(spark.range(1000), ["id"], ["id"]).rows == 1000 and not left(before)
    assert spark.conf.get(session.DROP_SHUFFLES) == setting
