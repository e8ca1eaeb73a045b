"""Network: gradient against finite differences, steps against a plain Adam, early stopping."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcline.operators import models as M
from arcline.operators import network as N
from arcline.operators.metrics import classification_metrics

SCHEMA = "game_id long, game_date date, a double, b double, y double"


def made(n=600, seed=0, late_noise=False):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b = float(r.normal()), None if r.random() < 0.2 else float(r.normal())
        late = late_noise and i >= 0.7 * n
        p = 0.5 if late else 1 / (1 + np.exp(-(2 * a - (b or 0.0))))
        rows.append((i // 10, f"2024-01-{1 + i * 28 // n:02d}", a, b, float(r.random() < p)))
    return rows


@pytest.fixture
def table(spark):
    def build(**options):
        df = spark.createDataFrame(made(**options), "game_id long, game_date string, a double, b double, y double")
        return df.withColumn("game_date", F.to_date("game_date"))

    return build


def test_gradient_equals_finite_differences():
    r = np.random.default_rng(1)
    weights = N.start_weights([3, 5, 4, 1], 7)
    x, y = r.normal(size=(20, 3)), (r.random(20) < 0.5).astype(float)
    for dropout in (0.0, 0.4):
        draw = lambda: np.random.default_rng(3)
        _, gradient = N.loss_and_gradient(weights, x, y, dropout, draw())
        for w, g in zip(weights, gradient):
            for at in [tuple(r.integers(0, s) for s in w.shape) for _ in range(6)]:
                old, sides = w[at], []
                for h in (1e-6, -1e-6):
                    w[at] = old + h
                    sides.append(N.loss_and_gradient(weights, x, y, dropout, draw())[0])
                w[at] = old
                assert abs((sides[0] - sides[1]) / 2e-6 - g[at]) < 1e-4


def test_one_epoch_equals_plain_steps(table):
    """All rows in one step per epoch: the fitted weights are those of a plain Adam loop."""
    df = table()
    fill = {"a": 0.0, "b": 0.25}
    model = N.fit_network(df, ["a", "b"], "y", F.lit(False), fill, hidden=(4,), epochs=3, patience=2, steps=1, learning_rate=0.05, weight_decay=0.01, dropout=0.0, seed=5)
    rows = made()
    raw = np.array([[a, 0.25 if b is None else b] for _, _, a, b, _ in rows])
    x = ((raw - raw.mean(axis=0)) / raw.std(axis=0, ddof=1)).astype(np.float32).astype(float)
    y = np.array([r[4] for r in rows])
    weights = N.start_weights([2, 4, 1], 5)
    state = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    for t in range(1, 4):
        _, gradient = N.loss_and_gradient(weights, x, y)
        for i, (w, g) in enumerate(zip(weights, gradient)):
            g = g / len(y) + 0.01 * w
            m, v = 0.9 * state[i][0] + 0.1 * g, 0.999 * state[i][1] + 0.001 * g * g
            state[i] = m, v
            weights[i] = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(model.weights, weights))
    assert [h["validation_log_loss"] for h in model.history] == [None] * 3


def test_stops_by_itself_and_keeps_the_best_epoch(table):
    train = table(late_noise=True)
    model = M.fit_network(train, ["a", "b"], "y", hidden=(8,), steps=2, epochs=40, patience=3, learning_rate=0.1)
    losses = [h["validation_log_loss"] for h in model.history]
    assert len(losses) < 40 and int(np.argmin(losses)) == len(losses) - 4
    again = M.fit_network(train.repartition(3), ["a", "b"], "y", hidden=(8,), steps=2, epochs=40, patience=3, learning_rate=0.1, dropout=0.0)
    assert len(again.history) <= 40


def test_learns_and_is_saved(spark, table, tmp_path):
    train, test = table(n=1500), table(n=500, seed=9)
    model = M.fit_network(train, ["a", "b"], "y", hidden=(16, 8), epochs=12, steps=4, learning_rate=0.02)
    metrics = classification_metrics(M.score(model, test), M.PROBABILITY, "y").first()
    assert metrics["auc"] > 0.85 and metrics["log_loss"] < 0.5
    M.promote(spark, str(tmp_path / "aliases"), "net", M.save_model(model, str(tmp_path / "net")))
    loaded = M.load_model(spark, str(tmp_path / "aliases"), "net")
    both = [[r[0] for r in M.score(m, test).select(M.PROBABILITY).collect()] for m in (model, loaded)]
    assert both[0] == both[1] and loaded.history == model.history


def test_awkward_rows(spark, table):
    odd = table(n=40).withColumn("b", F.lit(None).cast("double")).withColumn("a", F.when(F.col("game_id") > 0, F.lit(float("nan"))))
    model = M.fit_network(odd, ["a", "b"], "y", hidden=(2,), epochs=1, steps=2)
    assert M.score(model, odd).where(F.col(M.PROBABILITY).between(0, 1)).count() == 40
    assert M.score(model, odd.limit(0)).count() == 0
    with pytest.raises(ValueError, match="no labelled"):
        M.fit_network(odd.where("y is null"), ["a", "b"], "y", epochs=1)


def test_a_step_reads_its_own_rows_only(table, monkeypatch):
    """The jobs of an epoch read every row trained on once; held-out rows are read by the first step."""
    read, plain = [], N._sums

    def sums(blocks, weights, step, *rest):
        read.append((step, blocks.agg(F.sum("n")).first()[0] or 0))
        return plain(blocks, weights, step, *rest)

    monkeypatch.setattr(N, "_sums", sums)
    fill, out = {"a": 0.0, "b": 0.0}, F.col("game_id") >= 50
    options = {"hidden": (4,), "epochs": 1, "patience": 2, "steps": 4, "learning_rate": 0.05, "weight_decay": 0.0, "dropout": 0.2, "seed": 5}
    N.fit_network(table(), ["a", "b"], "y", out, fill, **options)
    first_epoch = read[:4]
    assert [step for step, _ in first_epoch] == [0, 1, 2, 3]
    assert sum(n for _, n in first_epoch) == 600 and first_epoch[0][1] > 100
    # One row: most steps have none, and the weights stay as they are.
    model = N.fit_network(table(n=1), ["a", "b"], "y", F.lit(False), fill, **options)
    assert all(np.isfinite(w).all() for w in model.weights)


def test_rows_are_neither_kept_nor_written_at_full_width(spark, table, tmp_path, monkeypatch):
    """Games of one date need no join, so nothing is cached; blocks of few-valued inputs are written packed."""
    train = table().withColumn("game_date", F.expr("date_add(date'2024-01-01', cast(game_id as int))"))
    flags = [f"f{i}" for i in range(40)]
    train = train.withColumns({c: ((F.col("game_id") + i) % 3 == 0).cast("double") for i, c in enumerate(flags)})
    written, plain = [], N.written_once

    def once(df, name, by=None):
        written.append(plain(df, name, by))
        return written[-1]

    monkeypatch.setattr(N, "written_once", once)
    monkeypatch.setattr(type(train), "persist", lambda *_: pytest.fail("rows are kept"))
    model = M.fit_network(train, flags, "y", hidden=(4,), epochs=1, steps=2)
    assert len(model.history) == 1 and len(written) == 1
    rows, size = written[0].agg(F.sum("n"), F.sum(F.length("x"))).first()
    assert rows == 600 and size < rows * len(flags) * 4 / 3


def test_games_of_two_dates_are_on_one_side(table):
    rows = table().withColumn("game_date", F.when(F.col("a") > 0, F.col("game_date")))
    sides = M._sides(rows, 0.5).groupBy("game_id").agg(F.countDistinct("_side").alias("n"), F.count_if(F.col("_side").isNull()).alias("none"))
    assert sides.where("n <> 1 or none > 0").count() == 0
