"""The paths for very large keys give the same rows as the plain ones and as brute force."""

import random

import pytest
from pyspark.sql import functions as F

from arcline.operators import ranks, windows
from arcline.operators.metrics import calibration_table
from arcline.operators.sequences import last_events_before
from arcline.operators.skew import plan_slices
from arcline.operators.split import time_split


@pytest.fixture(scope="module")
def log(spark):
    """One key holds a third of the rows; the value is often missing."""
    generator = random.Random(7)
    data = []
    for i in range(900):
        key = 0 if i % 3 == 0 else generator.randint(1, 60)
        data.append((key, generator.randint(0, 200), i, generator.choice([None, None, i * 1.0])))
    return spark.createDataFrame(data, "k long, t int, id long, v double").cache()


def _brute(log):
    groups = {}
    for row in sorted(log.collect(), key=lambda r: (r["k"], r["t"], r["id"])):
        groups.setdefault(row["k"], []).append(row)
    return groups


@pytest.mark.parametrize("limit", [10_000, 20, 3])
def test_shift_roll(log, slices, limit):
    slices(limit)
    got = windows.shift_roll(log, ["k"], ["t", "id"], {"s": ("sum", "v"), "m": ("avg", "v")})
    found = {r["id"]: (r["s"], r["m"]) for r in got.collect()}
    assert len(found) == 900 and got.columns == [*log.columns, "s", "m"]
    for rows in _brute(log).values():
        for i, row in enumerate(rows):
            before = [r["v"] for r in rows[max(0, i - 5) : i] if r["v"] is not None]
            total = sum(before) if before else None
            assert found[row["id"]] == (total, total / len(before) if before else None)


@pytest.mark.parametrize("limit", [10_000, 20, 3])
def test_fill_then_lag(log, slices, limit):
    slices(limit)
    got = windows.fill_then_lag(log, ["k"], ["t", "id"], {"v": ("f", "p")})
    found = {r["id"]: (r["f"], r["p"]) for r in got.collect()}
    assert len(found) == 900
    for rows in _brute(log).values():
        known = None
        for row in rows:
            prior = 0.0 if known is None else known
            known = row["v"] if row["v"] is not None else known
            assert found[row["id"]] == (known, prior)


@pytest.mark.parametrize("limit", [10_000, 20, 3])
def test_last_events_before(log, slices, limit):
    slices(limit)
    left = log.where(F.col("v").isNotNull()).select("k", "id", "t")
    right = log.where(F.col("v").isNull()).select("k", F.col("id").alias("e"), (F.col("t") * 1000 + F.col("id")).alias("t"))
    got = last_events_before(
        left.withColumn("t", F.col("t") * 1000), right, key="k", left_position="t", right_position="t", record=["e"]
    )
    found = {r["id"]: [e["e"] for e in r["events"]] for r in got.collect()}
    expected = {}
    for rows in _brute(log).values():
        events = sorted((r["t"] * 1000 + r["id"], r["id"]) for r in rows if r["v"] is None)
        for row in rows:
            if row["v"] is not None:
                expected[row["id"]] = [e for at, e in events if at < row["t"] * 1000][-5:]
    assert found == expected


@pytest.mark.parametrize("limit", [10_000, 20, 3])
def test_number_rows(log, slices, limit):
    slices(limit)
    got = {r["id"]: r["row_id"] for r in windows.number_rows(log, "k", ["t", "id"]).collect()}
    ordered = sorted(log.collect(), key=lambda r: (r["k"], r["t"], r["id"]))
    assert got == {row["id"]: i + 1 for i, row in enumerate(ordered)}


@pytest.mark.parametrize("limit", [10_000, 25])
def test_prefix_counts_and_quantiles(log, slices, limit):
    slices(limit)
    values = sorted(r["t"] for r in log.collect())
    table = ranks.prefix_counts(log, "t", {"n": F.count(F.lit(1))}).collect()
    for row in table:
        assert row["n"] == values.count(row["t"])
        assert row["n_before"] == sum(v < row["t"] for v in values)
    shares = [0.0, 0.1, 0.5, 0.99, 1.0]
    for share, got in zip(shares, ranks.exact_quantiles(log, "t", shares)):
        at = share * (len(values) - 1)
        low, high = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
        assert got == pytest.approx(low + (high - low) * (at - int(at)))
    assert ranks.nth_smallest(log, "t", 450) == values[449]


@pytest.mark.parametrize("limit", [10_000, 25])
def test_auc_by_brute_force(log, slices, limit):
    slices(limit)
    rows = log.withColumn("y", (F.col("id") * 7 % 5 < 2))
    pairs = [(r["t"], r["y"]) for r in rows.collect()]
    hits, misses = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    expected = sum((h > m) + 0.5 * (h == m) for h in hits for m in misses) / (len(hits) * len(misses))
    assert ranks.rank_auc(rows, "t", "y").first()["auc"] == pytest.approx(expected)
    long = rows.select("y", F.lit("a").alias("f"), F.col("t").cast("double").alias("x"))
    assert ranks.auc_by_feature(long, "f", "x", "y").first()["auc"] == pytest.approx(expected)


def test_split_day_with_many_games(spark, slices):
    games = spark.range(1000).select(
        F.col("id").alias("game_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") > 900).cast("int")).alias("game_date")
    )
    slices(50)
    assert time_split(games, 0.8).where("split = 'train'").agg(F.max("game_id")).first()[0] == 799


def test_hot_keys_are_cut_into_bounded_slices(log, slices):
    slices(20)
    plan = plan_slices(log, ["k"], ["t", "id"])
    sizes = plan.assign(log).groupBy("k", "_slice").count()
    assert plan.hot.count() >= 1
    assert sizes.agg(F.max("count")).first()[0] <= 45  # about 20 rows per slice


@pytest.mark.parametrize("text_ids", [False, True])
def test_one_key_on_one_day_is_cut_too(spark, slices, text_ids):
    ids = F.lpad(F.col("id").cast("string"), 10, "0") if text_ids else F.col("id")
    day = F.lit("2024-01-01").cast("date")
    log = spark.range(1000).select(F.lit(1).alias("k"), day.alias("d"), ids.alias("g"), F.col("id").alias("v"))
    slices(50)
    plan = plan_slices(log, ["k"], ["d", "g"])
    assert plan.assign(log).groupBy("_slice").count().agg(F.max("count")).first()[0] <= 100
    got = windows.shift_roll(log, ["k"], ["d", "g"], {"s": ("sum", "v")})
    found = {r["v"]: r["s"] for r in got.collect()}
    assert found[0] is None and all(found[i] == sum(range(max(0, i - 5), i)) for i in range(1, 1000))


def test_cold_keys_take_the_plain_plan(log):
    plan = plan_slices(log, ["k"], ["t", "id"])
    assert plan.hot is None and plan.assign(log) is log and plan.partition == ["k"]


def test_keep_first_cuts_before_the_shuffle(spark, log):
    kept = windows.keep_first(log, ["k"], ["t"])
    text = kept._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "Partial" in text
    best = {}
    for r in log.collect():
        rank = (r["t"], r["t"], r["id"])
        best[r["k"]] = min(best.get(r["k"], (rank, r["id"])), (rank, r["id"]))
    assert {r["k"]: r["id"] for r in kept.collect()} == {k: v[1] for k, v in best.items()}


def test_many_large_keys_are_cut_by_their_own_rows(spark):
    """A key gets as many slices as it fills, however many other keys are cut."""
    rows = spark.range(2400).selectExpr("id % 200 as k", "cast(pmod(id * 7919, 100003) as int) as t", "id")
    plan = plan_slices(rows, ["k"], ["t", "id"], rows_per_slice=3)
    sliced = plan.assign(rows)
    sizes = sliced.groupBy("k", "_slice").count().collect()
    assert plan.parts == 4 and plan.hot.count() == 200
    assert len(sizes) <= 800 and max(r["count"] for r in sizes) <= 4


def test_rows_of_a_window_are_spread_by_their_number(spark, monkeypatch):
    """The number of partitions follows the rows, so a task sorts no more in a larger table."""
    monkeypatch.setattr("arcline.operators.skew.TASK_ROWS", 20)
    for size in (400, 1600):
        rows = spark.range(size).selectExpr("id % 100 as k", "id as t", "id * 1.0 as v")
        rolled = windows.shift_roll(rows, ["k"], ["t"], {"s": ("sum", "v")})
        text = rolled._jdf.queryExecution().executedPlan().toString()
        assert f"{size // 20}), REPARTITION_BY_NUM" in text and rolled.count() == size


@pytest.mark.parametrize("limit", [10_000, 50])
def test_order_statistics_derive_their_rows_once(spark, slices, limit):
    slices(limit)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(600).selectExpr("(id * 37 % 500) / 500e0 as s", "id % 3 = 0 as y").coalesce(1)
    table = calibration_table(rows.mapInArrow(count, rows.schema), "s", "y")
    assert table.agg(F.sum("shot_count")).first()[0] == 600
    assert seen.value == 600
