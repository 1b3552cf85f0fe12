"""Hand-derived results on the ten-row table and small records."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import scores as SC
from plumbline.operators import drift as D
from plumbline.operators import features as X
from plumbline.operators import history as H
from plumbline.operators import profile as P


def one(df, column):
    return df.first()[column]


def test_profile(sample):
    rows = {r["column"]: r for r in P.profile(sample).collect()}
    f1, f3 = rows["feature1"], rows["feature3"]
    assert f1["mean"] == pytest.approx(0.485) and f1["std"] == pytest.approx(0.262520, abs=1e-6)
    assert (f1["median"], f1["q25"], f1["q75"]) == pytest.approx((0.45, 0.3125, 0.675))
    assert f3["mean"] == pytest.approx(19.6) and f3["std"] == pytest.approx(6.669999, abs=1e-6)
    assert (f3["median"], f3["q25"], f3["q75"]) == pytest.approx((19.0, 15.25, 24.25))
    near = {r["column"]: r for r in P.profile(sample, quantile_method="nearest").collect()}
    assert (near["feature1"]["q25"], near["feature1"]["q75"]) == (0.3, 0.7)
    assert (near["feature3"]["q25"], near["feature3"]["q75"]) == (15, 25)
    assert rows["feature2"]["n_unique"] == 3 and rows["feature2"]["mean"] is None


def test_quality_and_issues(sample):
    assert one(P.quality_score(sample), "score") == pytest.approx(0.94)
    assert P.quality_issues(sample).count() == 0


def test_top_values_and_correlations(sample):
    assert [(r["value"], r["count"]) for r in P.top_values(sample).orderBy("rank").collect()] == [("a", 4), ("b", 3), ("c", 3)]
    found = [(r["column_a"], r["column_b"], r["correlation"]) for r in P.correlations(sample).collect()]
    assert found == [("feature1", "target", 0.863), ("feature1", "feature3", 0.313)]
    every = {(r["column_a"], r["column_b"]): r["correlation"] for r in P.correlations(sample, threshold=0, digits=4).collect()}
    assert every["id", "feature3"] == 0.2916 and every["id", "target"] == -0.1741
    assert every["feature3", "target"] == 0.0948 and every["id", "feature1"] == -0.0384


def test_drift(sample):
    early, late = sample.filter("id <= 5"), sample.filter("id > 5")
    numeric = {r["column"]: r["score"] for r in D.psi_numeric(early, late, ["feature1", "feature3"]).collect()}
    assert numeric == {"feature1": 1.0, "feature3": 1.0}
    assert one(D.psi_categorical(early, late, ["feature2"], "reference"), "score") == pytest.approx(0.30)
    assert one(D.psi_categorical(early, late, ["feature2"]), "score") == pytest.approx(0.277259, abs=1e-6)


def test_features(sample):
    assert X.infer_target(sample) == "target"
    plan = X.default_feature_plan(sample, "target")
    model = X.fit_features(sample, plan)
    out = model.transform(sample)
    assert out.columns == ["numeric__id", "numeric__feature1", "numeric__feature3", "categorical__feature2_a",
                           "categorical__feature2_b", "categorical__feature2_c", "target"]
    assert model.widths["feature1"] == pytest.approx(0.249048, abs=1e-6)
    assert model.widths["feature3"] == pytest.approx(6.327717, abs=1e-6)


def test_infer_target_order(spark):
    make = lambda cols: spark.createDataFrame([tuple(range(len(cols)))], cols)
    assert X.infer_target(make(["y", "label", "z"])) == "label"
    assert X.infer_target(make(["Outcome", "z"])) == "Outcome"
    assert X.infer_target(make(["a", "b"])) == "b"


def test_weighted_score(spark):
    rows = spark.createDataFrame([(0.8, 0.7, 0.9, 1.0), (None, None, None, None), (0.95, None, None, None)],
                                 "success_rate double, user_satisfaction double, efficiency double, safety double")
    got = rows.select(SC.weighted_score({c: F.col(c) for c in rows.columns}).alias("s"))
    assert [r.s for r in got.collect()] == pytest.approx([0.81, 0.5, 0.95])
    maps = spark.createDataFrame([({"success_rate": 0.95, "other": 0.1},), ({},)], "m map<string,double>")
    assert [r.s for r in maps.select(SC.weighted_score(F.col("m")).alias("s")).collect()] == pytest.approx([0.95, 0.5])


def test_history(spark):
    rows = [("k", f"v{i}", s, i) for i, s in enumerate([0.3, 0.9, 0.5, 0.9, 0.1])]
    df = spark.createDataFrame(rows, "key string, content string, score double, generation int")
    order = ["generation"]
    assert one(H.latest(df, ["key"], order), "content") == "v4"
    assert one(H.best(df, ["key"], "score", order), "content") == "v1"
    assert one(H.rollback(df.filter("generation < 3"), ["key"], order), "content") == "v1"
    assert H.rollback(df.filter("generation < 1"), ["key"], order).count() == 0
    assert sorted(r.content for r in H.retain(df, ["key"], order, 3).collect()) == ["v2", "v3", "v4"]
    top = H.top_k(df.filter("generation < 3"), "score", 2).collect()
    assert [r.score for r in top] == [0.9, 0.5]


def test_alert_levels(spark):
    df = spark.createDataFrame([(0.05,), (0.1,), (0.2,), (0.3,)], "s double")
    assert [r.a for r in df.select(SC.alert_level(F.col("s")).alias("a")).collect()] == ["NONE", "LOW", "MEDIUM", "HIGH"]
