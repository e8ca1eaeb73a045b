"""Boosted trees against a plain booster that sorts and scans rows, in both ways of fitting."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcline.operators import boosting as B
from arcline.operators import models as M
from arcline.operators.metrics import classification_metrics, metrics_by_model

FEATURES = ["a", "b", "c"]


def make_rows(n=200, seed=1):
    """Rows (a, b, c, y): b often missing and then mostly a hit, c with few values."""
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        a, b, c = round(float(r.normal()), 2), round(float(r.normal()), 1), float(r.integers(0, 3))
        b = None if r.random() < 0.25 else b
        p = 1 / (1 + math.exp(-(a + (1.5 if b is None else -b) - c)))
        rows.append((a, b, c, float(r.random() < p)))
    return rows


def split_of(rows, config):
    """Best split (gain, feature, value, missing_left) of (x, g, h) rows by trying every one."""

    def part(sum_g, sum_h):
        return sum_g * sum_g / (sum_h + config["reg_lambda"])

    all_g, all_h = (sum(r[i] for r in rows) for i in (1, 2))
    best = None
    for f in config["columns"]:
        for value in sorted({r[0][f] for r in rows if r[0][f] is not None}):
            for missing_left in (False, True):
                left = [r for r in rows if (missing_left if r[0][f] is None else r[0][f] <= value)]
                if min(len(left), len(rows) - len(left)) < config["min_child_samples"]:
                    continue
                g, h = (sum(r[i] for r in left) for i in (1, 2))
                gain = part(g, h) + part(all_g - g, all_h - h) - part(all_g, all_h)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, value, missing_left)
    return best


def plain_boost(rows, config):
    """Margins of all rows after all rounds, each split chosen among all leaves."""
    rate = sum(r[3] for r in rows) / len(rows)
    margin = [math.log(rate / (1 - rate))] * len(rows)
    for _ in range(config["n_estimators"]):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        data = [(rows[i][:3], p[i] - rows[i][3], p[i] * (1 - p[i])) for i in range(len(rows))]
        leaves = [list(range(len(rows)))]
        while len(leaves) < config["num_leaves"]:
            found = [(split_of([data[i] for i in leaf], config), k) for k, leaf in enumerate(leaves)]
            found = [(s, k) for s, k in found if s]
            if not found:
                break
            (_, f, value, missing_left), k = max(found, key=lambda x: x[0][0])
            leaf = leaves.pop(k)
            left = [i for i in leaf if (missing_left if data[i][0][f] is None else data[i][0][f] <= value)]
            leaves += [left, [i for i in leaf if i not in set(left)]]
        for leaf in leaves:
            g, h = (sum(data[i][j] for i in leaf) for j in (1, 2))
            for i in leaf:
                margin[i] -= config["learning_rate"] * g / (h + config["reg_lambda"])
    return margin


CONFIGS = [
    M.tree_config(num_leaves=5, n_estimators=4, min_child_samples=8, colsample_bytree=1.0, columns=[0, 1, 2]),
    M.tree_config(num_leaves=4, n_estimators=3, min_child_samples=20, reg_lambda=1.0, colsample_bytree=1.0, columns=[0, 1, 2]),
    M.tree_config(num_leaves=6, n_estimators=3, min_child_samples=8, colsample_bytree=1.0, columns=[1]),
]


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(make_rows(), "a double, b double, c double, y double")


def margins_of(model, rows):
    columns = [np.array([r[i] for r in rows], float) for i in range(3)]
    return model.margins(np.stack([B.to_bins(v, e) for v, e in zip(columns, model.edges)]))


@pytest.mark.parametrize("block_rows", [1000, 60], ids=["one block", "blocks"])
def test_equals_plain_booster(train, block_rows):
    rows = make_rows()
    models = B.fit_many(train, FEATURES, "y", CONFIGS, block_rows=block_rows, save_rounds=2)
    for model, config in zip(models, CONFIGS):
        assert len(model.trees) == config["n_estimators"]
        assert np.allclose(margins_of(model, rows), plain_boost(rows, config), atol=1e-5)


def test_same_trees_however_rows_are_dealt(train):
    config = [M.tree_config(num_leaves=6, n_estimators=4, min_child_samples=5, subsample_freq=2)]
    fits = [
        B.fit_many(df, FEATURES, "y", config, block_rows=size, save_rounds=3)[0]
        for df, size in ((train, 1000), (train.repartition(5, "a"), 1000), (train.repartition(3, "b"), 50))
    ]
    tables = [list(f.node_rows()) for f in fits]
    assert tables[0] == tables[1] == tables[2]
    drawn = [t.rows[0] for t in fits[0].trees]
    assert drawn[0] == drawn[1] != drawn[2] and 120 < drawn[0] < 190


def test_levels_use_idle_cores_and_bounded_saves(spark, train, tmp_path, monkeypatch):
    dealt = []
    original = B._fit_by_levels
    monkeypatch.setattr(B, "_fit_by_levels", lambda state, *args: dealt.append(state.rdd.getNumPartitions()) or original(state, *args))
    named = B.checkpoint_dir
    monkeypatch.setattr(B, "checkpoint_dir", lambda s: named(s) and str(tmp_path))
    monkeypatch.setattr(B, "TASK_ROWS", 50)
    config = [M.tree_config(num_leaves=5, n_estimators=7, min_child_samples=8)]
    whole = list(B.fit_many(train, FEATURES, "y", config)[0].node_rows())
    for most in (32, 0):  # sums added by the driver, by Spark
        monkeypatch.setattr(B, "DIRECT_TASKS", most)
        assert list(B.fit_many(train, FEATURES, "y", config, block_rows=100, save_rounds=5)[0].node_rows()) == whole
    assert dealt == [4, 4]
    assert sorted(len(list(saves.iterdir())) for saves in tmp_path.iterdir()) == [2, 2]


def test_copies_of_blocks_give_the_same_trees(train):
    whole = B.fit_many(train, FEATURES, "y", CONFIGS)
    parted = B.fit_many(train, FEATURES, "y", CONFIGS, block_rows=100, save_rounds=10)  # two copies on four cores
    assert [list(m.node_rows()) for m in parted] == [list(m.node_rows()) for m in whole]


def test_missing_values_choose_a_side(train):
    tree = M.fit_trees(train, ["b"], "y", num_leaves=2, n_estimators=1, min_child_samples=5).trees[0]
    assert tree.feature[0] == 0
    scored = M.score(M.fit_trees(train, FEATURES, "y", n_estimators=20, min_child_samples=5), train)
    shares = scored.groupBy(F.col("b").isNull().alias("none")).agg(F.avg(M.PROBABILITY).alias("p"), F.avg("y").alias("y"))
    for row in shares.collect():
        assert abs(row["p"] - row["y"]) < 0.1


def test_awkward_rows(spark):
    schema = "a double, b double, y boolean"
    odd = spark.createDataFrame([(1.0, None, True), (float("nan"), None, False), (1.0, None, None), (None, None, True)], schema)
    model = M.fit_trees(odd, ["a", "b"], "y", n_estimators=3, min_child_samples=1)
    got = [r[0] for r in M.score(model, odd).select(M.PROBABILITY).collect()]
    assert len(got) == 4 and all(0 < p < 1 for p in got) and got[0] == got[2]
    alike = spark.createDataFrame([(1.0, 2.0, True)] * 5, schema)
    only = M.fit_trees(alike, ["a", "b"], "y", n_estimators=2)
    assert [len(t.feature) for t in only.trees] == [1, 1]
    assert M.score(only, alike).agg(F.min(M.PROBABILITY)).first()[0] > 0.999
    assert M.score(only, alike.limit(0)).count() == 0
    with pytest.raises(ValueError, match="no labelled"):
        M.fit_trees(alike.limit(0), ["a"], "y")


def test_saved_model_scores_alike(spark, train, tmp_path):
    model = M.fit_trees(train, FEATURES, "y", num_leaves=7, n_estimators=5, min_child_samples=5)
    path = M.save_model(model, str(tmp_path / "m"))
    M.promote(spark, str(tmp_path / "aliases"), "best", path)
    again = M.load_model(spark, str(tmp_path / "aliases"), "best")
    assert list(again.node_rows()) == list(model.node_rows())
    both = [[r[0] for r in M.score(m, train).select(M.PROBABILITY).collect()] for m in (model, again)]
    assert both[0] == both[1]
    splits = {r["feature"]: r["importance"] for r in M.feature_importance(again, FEATURES, "split").collect()}
    assert set(splits) == set(FEATURES)
    assert sum(splits.values()) == sum((t.feature >= 0).sum() for t in model.trees)
    gains = {r["feature"]: r["importance"] for r in M.feature_importance(model, FEATURES).collect()}
    assert abs(sum(gains.values()) - sum(t.gain.sum() for t in model.trees)) < 1e-6


def test_search_ranks_every_configuration(spark):
    rows = [(i // 10, f"2024-01-{1 + i // 100:02d}", *r) for i, r in enumerate(make_rows(1000, 3))]
    df = spark.createDataFrame(rows, "game_id long, game_date string, a double, b double, c double, y double")
    df = df.withColumn("game_date", F.to_date("game_date"))
    train, test = df.where("game_id < 80"), df.where("game_id >= 80")
    configs = [M.tree_config(num_leaves=n, n_estimators=r, min_child_samples=20) for n, r in ((4, 5), (8, 30), (4, 30))]
    model, board, record = M.search_trees(train, test, FEATURES, "y", configs=configs)
    rows = board.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2, 3] and sorted(r["config_index"] for r in rows) == [0, 1, 2]
    assert [r["validation_log_loss"] for r in rows] == sorted(r["validation_log_loss"] for r in rows)
    assert record["best_config_index"] == rows[0]["config_index"] and record["test_auc"] > 0.7
    assert len(model.trees) == configs[record["best_config_index"]]["n_estimators"]


def test_single_features_one_model_each(spark, train):
    leaked = train.withColumn("leak", F.col("y") + 0.5)
    with pytest.raises(KeyError, match="score_margin"):
        M.audit_single_features(leaked, leaked, [*FEATURES, "leak"], "y")
    found = M.audit_single_features(leaked, leaked, [*FEATURES, "leak"], "y", required=(), n_estimators=3, min_child_samples=5)
    rows = {r["feature"]: r for r in found.collect()}
    assert [f for f, r in rows.items() if r["suspicious"]] == ["leak"] and rows["leak"]["auc"] == 1.0
    missing = 100 * sum(r[1] is None for r in make_rows()) / 200
    assert rows["b"]["train_missing_pct"] == missing and rows["a"]["test_missing_pct"] == 0
    alone = M.score(M.fit_trees(leaked, ["b"], "y", n_estimators=3, min_child_samples=5, colsample_bytree=1.0), leaked)
    assert abs(classification_metrics(alone, M.PROBABILITY, "y").first()["log_loss"] - rows["b"]["log_loss"]) < 1e-9


def test_counted_rows_give_the_same_trees(train):
    config = M.tree_config(num_leaves=6, n_estimators=4, min_child_samples=5)
    singles = B.fit_single_features(train, FEATURES, "y", config)
    whole = B.fit_many(train, FEATURES, "y", [{**config, "columns": [i]} for i in range(3)])
    assert [list(m.node_rows()) for m in singles] == [list(m.node_rows()) for m in whole]


def test_metrics_by_model_equal_single_ones(spark):
    r = np.random.default_rng(5)
    rows = [(m, round(float(r.random()), 1), float(r.integers(0, 2))) for m in (0, 1) for _ in range(60)]
    df = spark.createDataFrame(rows, "model int, score double, y double")
    both = {x["model"]: x for x in metrics_by_model(df, "model", "score", "y").collect()}
    for m in (0, 1):
        one = classification_metrics(df.where(F.col("model") == m), "score", "y").first()
        assert all(abs(one[k] - both[m][k]) < 1e-12 for k in ("auc", "log_loss", "brier_score", "accuracy"))


def test_rows_that_one_task_can_hold_need_no_job_per_level(spark, train, tmp_path, monkeypatch):
    """More rows than a block are fitted in one task as far as their bins fit it; the trees stay the same."""
    config = {**CONFIGS[0], "n_estimators": 4}
    levels, plain = [], B._fit_by_levels
    monkeypatch.setattr(B, "_fit_by_levels", lambda *args: levels.append(1) or plain(*args))
    monkeypatch.setattr(B, "BLOCK_ROWS", 60)
    monkeypatch.setattr(B, "checkpoint_dir", lambda _: str(tmp_path))
    held = B.fit_many(train.repartition(3), FEATURES, "y", [config], save_rounds=1)
    assert not levels and not [p for saves in tmp_path.iterdir() for p in saves.iterdir()]
    monkeypatch.setattr(B, "HELD_BYTES", 100)
    parted = B.fit_many(train, FEATURES, "y", [config])
    assert levels and list(held[0].node_rows()) == list(parted[0].node_rows())
