"""Empty, all-null, constant, NaN, tied and nested inputs; invariants on seeded random tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators import cleaning as C
from plumbline.operators import drift as D
from plumbline.operators import features as X
from plumbline.operators import metrics as M
from plumbline.operators import profile as P
from plumbline.operators import ranks as R
from plumbline.operators import sampling as S
from plumbline.operators.diff import diff
from plumbline.plans.cleaning import clean


@pytest.fixture(scope="module")
def noisy(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([None, rng.gauss(0, 1), 3.0]), rng.choice(["x", "y", "z", None]), rng.randint(0, 9)) for i in range(3000)]
    return spark.createDataFrame(rows, "i bigint, v double, c string, k int").repartition(5)


def test_empty_table(spark):
    df = spark.createDataFrame([], "a bigint, b string")
    assert [r["null_percent"] for r in P.load_stats(df).collect()] == [None, None]
    assert {r["n_unique"] for r in P.profile(df).collect()} == {0}
    assert P.quality_score(df).first()["score"] == 0.0
    assert P.quality_issues(df).count() == 0
    assert clean(df).df.count() == 0
    assert C.remove_outliers(df, ["a"]).count() == 0
    assert C.fill_missing(df, "a", "mean").count() == 0


def test_all_null_constant_and_nested(spark):
    df = spark.createDataFrame([(1, None, {"a": 1}, [1.0]), (1, None, {"a": 1}, [2.0])], "c int, n double, m map<string,int>, l array<double>")
    rows = {r["column"]: r for r in P.profile(df).collect()}
    assert rows["n"]["n_unique"] == 1 and rows["n"]["median"] is None and rows["m"]["n_unique"] == 1 and rows["l"]["n_unique"] == 2
    issues = {(r["column"], r["type"]) for r in P.quality_issues(df).collect()}
    assert {("n", "missing_values"), ("n", "constant"), ("c", "constant"), ("m", "constant")} <= issues
    assert C.remove_duplicates(df.drop("l")).count() == 1
    assert P.correlations(df.select("c", "n"), threshold=0).count() == 0
    report = {r["column"]: r["action"] for r in X.fit_features(df, X.FeaturePlan(None, ["c", "n"])).report(spark).collect()}
    assert report["n"] == "dropped: all null"


def test_nan_is_not_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (2.0,)], "v double")
    assert C.drop_missing(df).count() == 3
    assert D.psi_numeric(df, df).first()["score"] == 0.0
    assert D.drift(df, df).first()["nan_count"] == 2


@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_quantiles_against_numpy(spark, method, monkeypatch):
    monkeypatch.setattr(R, "SAMPLE_ROWS", 300)
    monkeypatch.setattr(R, "BRACKET_ROWS", 50)
    rng = np.random.default_rng(3)
    data = {"normal": rng.normal(size=4000), "heavy": np.exp(rng.normal(size=4000) * 4), "ties": rng.integers(0, 4, 4000).astype(float),
            "hot": np.where(rng.random(4000) < 0.4, 1.0, rng.random(4000) * 10)}
    df = spark.createDataFrame(list(zip(*[map(float, v) for v in data.values()])), list(data)).repartition(6)
    qs = [0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = R.quantile_values(df, {c: qs for c in data}, method)
    for c, values in data.items():
        ordered = np.sort(values)
        for q in qs:
            want = np.quantile(values, q) if method == "linear" else ordered[math.floor((len(values) - 1) * q + 0.5)]
            assert got[c, q] == pytest.approx(want, abs=1e-12), (c, q)


def test_quantile_brackets_are_recounted_when_wide(spark, monkeypatch):
    monkeypatch.setattr(R, "SAMPLE_ROWS", 200)
    monkeypatch.setattr(R, "BRACKET_ROWS", 10)
    values = np.random.default_rng(5).normal(size=20000)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    calls = []
    recount = R._recount
    monkeypatch.setattr(R, "_recount", lambda *a: calls.append(1) or recount(*a))
    got = R.quantile_values(df, {"v": [0.1, 0.5, 0.9]})
    assert calls and [got["v", q] for q in (0.1, 0.5, 0.9)] == pytest.approx(list(np.quantile(values, [0.1, 0.5, 0.9])))


def test_running_matches_a_window_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else rng.choice([None, "a", "b"]), i, rng.choice([None, rng.random()])) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, t int, v double").repartition(7)
    got = R.running(df, ["k"], ["t"], sums={"s": "v"}, maxes={"m": "v"}, firsts={"f": "v"}, lags={"p": "v"}, partitions=9)
    w = W.partitionBy("k").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    want = df.select("t", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("m"), F.first("v").over(w).alias("f"),
                     F.lag("v").over(W.partitionBy("k").orderBy("t")).alias("p"))
    a, b = ({r.t: r for r in x.collect()} for x in (got, want))
    assert len(a) == len(b) == 4000
    for t, r in b.items():
        assert (a[t].m, a[t].f, a[t].p) == (r.m, r.f, r.p)
        assert a[t].s == pytest.approx(r.s) if r.s is not None else a[t].s is None


def test_running_over_the_whole_table_and_over_one_key(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["x"] * 5 + [None, "y", "z"]), None if i % 97 == 0 else i // 2, i, rng.choice([None, 1, 2, 3])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v int").repartition(6)
    for keys in ([], ["k"]):
        got = R.running(df, keys, ["t", "i"], sums={"s": "v"}, maxes={"m": "v"}, firsts={"f": "v"}, lags={"p": "v"}, partitions=11)
        w = W.partitionBy(*(keys or [F.lit(0)])).orderBy("t", "i")
        upto = w.rowsBetween(W.unboundedPreceding, 0)
        want = df.select("i", F.sum("v").over(upto).alias("s"), F.max("v").over(upto).alias("m"), F.first("v").over(upto).alias("f"), F.lag("v").over(w).alias("p"))
        a, b = ({r.i: (r.s, r.m, r.f, r.p) for r in x.collect()} for x in (got, want))
        assert a == b and len(a) == 3000
    assert R.running(df.limit(0), ["k"], ["t"], sums={"s": "v"}).count() == 0


def test_drift_of_a_table_with_itself_is_zero(noisy):
    for formula in ("standard", "reference"):
        assert {r["score"] for r in D.drift(noisy, noisy, formula=formula).collect()} == {0.0}
    assert {r["score"] for r in D.js_divergence(noisy, noisy).collect()} == {0.0}
    assert {r["statistic"] for r in D.ks_two_sample(noisy, noisy).collect()} == {0.0}


def test_psi_against_numpy(spark):
    rng = np.random.default_rng(0)
    ref, cur = rng.normal(size=500), rng.normal(0.4, 2, size=400)
    counts, edges = np.histogram(ref, 10)
    p, q = (np.clip(np.histogram(x, edges)[0] / len(x), 1e-4, None) for x in (ref, cur))
    want = min(float(np.sum((q - p) * np.log(q / p))), 1.0)
    frames = [spark.createDataFrame([(float(v),) for v in x], "v double") for x in (ref, cur)]
    assert D.psi_numeric(*frames).first()["score"] == pytest.approx(want)
    flat = spark.createDataFrame([(5.0,)] * 4, "v double")
    assert [r["count"] for r in D.histogram(flat).orderBy("bin").collect()] == [0] * 5 + [4] + [0] * 4


def test_cleaning_twice_changes_nothing(noisy):
    plan = [{"operation": "remove_duplicates"}, {"operation": "handle_missing", "target": "all", "strategy": "drop"}]
    once = clean(noisy, plan).df
    twice = clean(once, plan).df
    assert diff(once, twice).count() == 0


def test_unknown_operation_raises(noisy):
    with pytest.raises(ValueError):
        clean(noisy, [{"operation": "polish"}])
    with pytest.raises(ValueError):
        clean(noisy, [{"operation": "handle_missing", "target": "nope", "strategy": "mean"}])


def test_scaling_and_onehot_invariants(noisy):
    plan = X.FeaturePlan(None, ["v", "k"], categorical=["c"])
    out = X.fit_features(noisy, plan).transform(noisy)
    row = out.agg(F.avg("numeric__v"), F.stddev_pop("numeric__v"), F.avg("numeric__k"), F.stddev_pop("numeric__k")).first()
    assert list(row) == pytest.approx([0, 1, 0, 1], abs=1e-9)
    hot = [c for c in out.columns if c.startswith("categorical__c_")]
    assert out.filter(sum(F.col(c) for c in hot) != 1).count() == 0 and "categorical__c_missing" in hot


def test_unknown_categories(spark):
    train = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "c string, y double")
    new = spark.createDataFrame([("z", 1.0)], "c string, y double")
    make = lambda **kw: X.fit_features(train, X.FeaturePlan("y", categorical=["c"], **kw))
    assert list(make().transform(new).first())[:2] == [0.0, 0.0]
    assert make(encoding="label").transform(new).first()["categorical__c"] == -1.0
    assert make(encoding="target").transform(new).first()["categorical__c"] == 1.5
    assert make(encoding="onehot_sparse").transform(new).first()["categorical__c"].toArray().tolist() == [0.0, 0.0]
    with pytest.raises(Exception, match="unknown category"):
        make(handle_unknown="error").transform(new).collect()
    with pytest.raises(ValueError, match="onehot_sparse"):
        make(max_categories=1)


def test_feature_model_round_trip(spark, noisy, tmp_path):
    for encoding in ("onehot", "label"):
        model = X.fit_features(noisy, X.FeaturePlan("k", ["v"], categorical=["c"], encoding=encoding))
        model.save(str(tmp_path / encoding), spark)
        again = X.FeatureModel.load(str(tmp_path / encoding), spark)
        assert diff(model.transform(noisy), again.transform(noisy)).count() == 0


def test_constant_columns_scale_to_zero(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    for scaling in ("standard", "minmax", "robust"):
        assert X.fit_features(df, X.FeaturePlan(None, ["v"], scaling=scaling)).transform(df).first()[0] == 0.0


def test_results_do_not_depend_on_partitioning(noisy):
    other = noisy.repartition(11, "k")
    for make in (lambda d: S.sample_rows(d, 100, ["i"]), lambda d: S.hash_split(d, ["i"])[0],
                 lambda d: S.sample_strata(d, ["c"], ["i"], per_stratum=20), lambda d: S.sample_systematic(d, ["i"], 9)):
        assert diff(make(noisy), make(other)).count() == 0


def test_metrics_edges(spark):
    perfect = spark.createDataFrame([(1, 1.0), (0, 0.0)], "label int, prediction double")
    assert list(M.classification_metrics(perfect).first()) == [1.0, 1.0, 1.0, 1.0]
    never = spark.createDataFrame([(1, 0), (0, 0)], "label int, prediction int")
    row = M.classification_metrics(never).first()
    assert (row["precision"], row["recall"]) == (0.25, 0.5)
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5)], "label int, score double")
    assert M.roc_auc(tied).first()[0] == 0.5
    single = spark.createDataFrame([(1, 0.5)], "label int, score double")
    assert M.roc_auc(single).first()[0] is None


def test_diff_by_key(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (4, "z")], "k int, v string")
    assert {(r.k, r.change, r.old, r.new) for r in diff(a, b, ["k"]).collect()} == {
        (2, "changed", "y", None), (3, "removed", None, None), (4, "added", None, None)}


def test_wide_correlations_with_nulls_against_pandas(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=400)
    values = {f"c{i:02d}": base * rng.normal() + rng.normal(size=400) + 1e6 for i in range(14)}
    for i in (3, 7, 9):
        values[f"c{i:02d}"][rng.random(400) < 0.3] = np.nan
    import pandas as pd

    frame = pd.DataFrame(values)
    rows = [tuple(None if math.isnan(v) else float(v) for v in r) for r in frame.itertuples(index=False)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in frame))
    want = frame.corr()
    got = P.correlations(df, threshold=0.0, digits=9).collect()
    assert len(got) == 14 * 13 // 2
    for r in got:
        assert r.correlation == pytest.approx(want.loc[r.column_a, r.column_b], abs=1e-7)


def test_fills_on_different_columns_are_fitted_together(noisy, monkeypatch):
    calls = []
    fit = C.fit_fills
    monkeypatch.setattr(C, "fit_fills", lambda df, fills: calls.append(fills) or fit(df, fills))
    plan = [{"operation": "handle_missing", "target": "v", "strategy": "mean"}, {"operation": "handle_missing", "target": "c", "strategy": "mode"}]
    done = clean(noisy, plan)
    assert calls == [{"v": "mean", "c": "mode"}] and done.df.filter("v IS NULL OR c IS NULL").count() == 0
