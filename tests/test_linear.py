"""Fold statistics against fits on the rows themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import linear as L
from plumbline.operators.model import AutoMLConfig, draw_trials


def rows():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 3)) * [1, 30, 0.01] + [1e4, -5, 2]
    y = x @ [2, -0.3, 50] + rng.normal(size=500)
    return x, y


def ridge(x, y, penalty):
    mean, spread = x.mean(0), x.std(0)
    z = (x - mean) / spread
    w = np.linalg.solve(z.T @ z / len(y) + penalty * np.eye(x.shape[1]), z.T @ (y - y.mean()) / len(y)) / spread
    return w, y.mean() - w @ mean


def test_search_equals_fits_on_the_rows(spark):
    x, y = rows()
    made = [(i, *map(float, v), 7.0, float(t)) for i, (v, t) in enumerate(zip(x, y))] + [(1, None, 1.0, 1.0, 7.0, 1.0), (2, 1.0, float("nan"), 1.0, 7.0, 1.0), (3, 1.0, 1.0, 1.0, 7.0, None)]
    df = spark.createDataFrame(made, "id long, a double, b double, `c.d` double, flat double, y double").repartition(4)
    config = AutoMLConfig("regression", trials=7)
    got = L.linear_search(df, ["a", "b", "c.d", "flat"], "y", ["id"], config, fold=F.col("id") % 5, held_out=F.col("id") % 7 == 0)
    i = np.arange(500)
    train, fold = i % 7 != 0, i % 5
    want = []
    for t, params in enumerate(draw_trials(config)):
        scores = []
        for f in range(5):
            w, b = ridge(x[train & (fold != f)], y[train & (fold != f)], params["learning_rate"])
            own = train & (fold == f)
            scores.append(np.sqrt(np.mean((y[own] - x[own] @ w - b) ** 2)))
        want.append((np.mean(scores), t, params["learning_rate"], scores))
    want.sort()
    found = got.trials.collect()
    assert [r["trial"] for r in found] == [t for _, t, _, _ in want]
    for r, (score, _, penalty, scores) in zip(found, want):
        assert r["score"] == pytest.approx(score, rel=1e-7) and r["penalty"] == penalty and r["fold_scores"] == pytest.approx(scores, rel=1e-7)
    w, b = ridge(x, y, want[0][2])
    assert [got.weights[c] for c in ("a", "b", "c.d")] == pytest.approx(list(w), rel=1e-6) and got.weights["flat"] == 0
    assert got.intercept == pytest.approx(b, rel=1e-6)
    w, b = ridge(x[train], y[train], want[0][2])
    mse = np.mean((y[~train] - x[~train] @ w - b) ** 2)
    metrics = {r["metric"]: r["value"] for r in got.metrics.collect()}
    assert metrics["mse"] == pytest.approx(mse, rel=1e-7) and metrics["r2"] == pytest.approx(1 - mse / y[~train].var(), rel=1e-7)
    one = df.filter("id = 10 AND a IS NOT NULL").select(got.prediction().alias("p")).first()["p"]
    assert one == pytest.approx(x[10] @ [got.weights[c] for c in ("a", "b", "c.d")] + got.intercept, rel=1e-9)


def test_default_folds_need_no_columns_and_the_documented_budget_is_used(spark):
    x, y = rows()
    df = spark.createDataFrame([(i, float(v[0]), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, a double, y double")
    got = L.linear_search(df, ["a"], "y", ["id"])
    assert got.trials.count() == 30 and all(len(r["fold_scores"]) == 5 for r in got.trials.collect()) and got.metrics.count() == 3


def test_what_sums_cannot_give_raises(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0)], "id long, a double, y double")
    for config in (AutoMLConfig("regression", metric="mae"), AutoMLConfig("classification")):
        with pytest.raises(ValueError):
            L.linear_search(df, ["a"], "y", ["id"], config)
    with pytest.raises(ValueError):
        L.linear_search(df, ["a"], "y", ["id"])
