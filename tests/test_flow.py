"""Models, search, the build flow and the log tables."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as TX
from plumbline.operators import features as X
from plumbline.operators import model as ML
from plumbline.operators import records as R
from plumbline.plans import flow as FL
from plumbline.plans.cleaning import clean, register_cleaner

SPACE = {"n_estimators": ("int", 3, 6), "max_depth": ("int", 2, 4), "learning_rate": ("log", 0.05, 0.3)}


@pytest.fixture(scope="module")
def flowers(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((i, None if i % 50 == 0 else a, b, rng.choice("xyz"), int(a + 0.2 * b > 0)))
    return spark.createDataFrame(rows + rows[:20], "id bigint, a double, b double, c string, target bigint")


def test_build_and_score(spark, flowers):
    plan = [{"operation": "remove_duplicates"}, {"operation": "handle_missing", "target": "a", "strategy": "mean"}]
    features = X.FeaturePlan("target", ["a", "b"], categorical=["c"])
    config = ML.AutoMLConfig("classification", trials=2, folds=2, space=SPACE)
    done = FL.build(spark, flowers, ["id"], plan, features, model=config)
    assert done.cleaned.report().orderBy("step").first()["rows_affected"] == 20
    assert done.table.count() == 600
    metrics = {r.metric: r.value for r in done.model.metrics.collect()}
    assert set(metrics) == {"accuracy", "precision", "recall", "f1", "roc_auc"} and metrics["accuracy"] > 0.85
    assert done.model.importance.first()["feature"] == "numeric__a"
    assert done.model.trials.count() == 2
    scored = ML.score(flowers, done.features, done.model.model, ["id"])
    assert scored.count() == 620 and scored.filter("probability < 0.5 OR probability > 1").count() == 0
    runs = done.runs.collect()
    assert [r.agent_name for r in runs] == ["loader", "cleaning", "profile", "features", "model"]
    assert R.stage_metrics(done.runs).filter("success_rate = 1").count() == 5


def test_search_repeats_and_honours_the_metric(flowers):
    data = flowers.dropDuplicates().fillna(0.0)
    config = ML.AutoMLConfig("classification", ["gbt", "logistic"], "accuracy", trials=2, folds=2, space=SPACE)
    one, two = (ML.automl(data.repartition(n), ["a", "b"], "target", ["id"], config) for n in (2, 2))
    assert one.params == two.params and one.score == pytest.approx(two.score, abs=0.02)
    with pytest.raises(ValueError):
        ML.AutoMLConfig("classification", metric="rmse")
    with pytest.raises(ValueError):
        ML.learner_for("boost", "regression")


def test_regression_search_picks_the_lowest_error(flowers):
    data = flowers.dropDuplicates().dropna().withColumn("y", F.col("a") * 3 + F.col("b"))
    config = ML.AutoMLConfig("regression", ["random_forest", "linear"], trials=2, folds=2, space={**SPACE, "learning_rate": ("log", 1e-6, 1e-5)})
    found = ML.automl(data, ["a", "b"], "y", ["id"], config)
    assert found.params["algorithm"] == "linear"
    assert {r.metric: r.value for r in found.metrics.collect()}["rmse"] < 0.01
    assert found.score == min(r.score for r in found.trials.collect())


def test_more_than_two_classes_are_boosted_one_against_the_rest(flowers):
    data = flowers.dropDuplicates().dropna().withColumn("y", F.when(F.col("a") > 0.5, 2).when(F.col("a") < -0.5, 0).otherwise(1))
    config = ML.AutoMLConfig("classification", ["gbt"], "accuracy", trials=1, folds=2, space={"n_estimators": ("int", 4, 4), "max_depth": ("int", 3, 3)})
    found = ML.automl(data, ["a", "b"], "y", ["id"], config)
    assert type(found.model).__name__ == "OneVsRestModel" and found.score > 0.9
    assert found.importance.first()["feature"] == "a"
    with pytest.raises(ValueError, match="index them first"):
        ML.automl(data.withColumn("y", F.col("y") + 1), ["a", "b"], "y", ["id"], config)


def test_settings_of_a_trial():
    settings = ML.settings_for(ML.learner_for("gbt", "regression"), {"n_estimators": 7, "subsample": 0.7, "colsample": 0.8})
    assert {p.name: v for p, v in settings.items()} == {"maxIter": 7, "subsamplingRate": 0.7, "featureSubsetStrategy": "0.8"}


def test_permutation_importance_finds_the_feature(flowers):
    data = flowers.dropDuplicates().dropna().withColumn("y", F.col("a") * 3.0)
    model = ML.LinearRegression().fit(ML.assemble(data, ["a", "b"], "y"))
    drops = {r.feature: r["drop"] for r in ML.permutation_importance(model, data, ["a", "b"], "y", ["id"], "regression").collect()}
    assert drops["a"] > 1 and abs(drops["b"]) < 0.01


def test_monitor(spark, flowers):
    metrics = spark.createDataFrame([("loader", 0.95), ("features", 0.6)], "agent string, success_rate double")
    feedback = spark.createDataFrame([("please improve feature engineering and the API",)], "text string")
    moved = flowers.withColumn("b", F.col("b") + 3)
    found = FL.monitor(flowers, moved, metrics, feedback)
    assert {r.target for r in found.targets.collect()} == {"features", "serving"}
    assert found.alerts.filter("feature = 'b' AND level = 'HIGH'").count() == 1
    assert FL.monitor(flowers, flowers, metrics).summary.first()["drift_detected"] is False


def test_user_cleaners_and_expressions(spark, flowers):
    register_cleaner("only_x", lambda df: df.filter("c = 'x'"))
    done = clean(flowers, [{"operation": "only_x"}, {"operation": "expr", "target": "a2", "expr": "a * 2"}, {"operation": "remove_outliers", "target": "all"}])
    assert done.df.filter("c <> 'x'").count() == 0 and "a2" in done.df.columns
    rows = done.report().orderBy("step").collect()
    assert [r.operation for r in rows] == ["only_x", "expr_a2", "remove_outliers_all"] and rows[2].rows_affected == 0


def test_preflight(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        FL.preflight(spark, str(tmp_path / "nothing"))
    with pytest.raises(ValueError):
        FL.preflight(spark, str(tmp_path), "https://example.com/out")


def test_optimisation_records(spark):
    empty = spark.createDataFrame([], "improvement double, original_reward double")
    assert R.optimization_summary(empty).first().asDict() == {"optimized": 0, "total_improvement": 0.0, "average_reward": 0.0}


def test_user_score_runs_in_batches(spark):
    df = spark.range(100).withColumn("text", F.concat(F.lit("t"), F.col("id").cast("string")))
    got = TX.score_with(df, lambda text, i: text.str.len() * 1.0 + i, ["text", "id"])
    assert got.filter(F.col("score") != F.length("text") + F.col("id")).count() == 0


def test_target_encoding_of_noise_predicts_nothing(spark):
    import random

    from plumbline.operators.features import FeaturePlan
    from plumbline.operators.model import AutoMLConfig, automl_with_features

    rng = random.Random(9)
    rows = [(i, f"c{rng.randrange(300)}", rng.randrange(2)) for i in range(600)]
    df = spark.createDataFrame(rows, "id bigint, c string, y bigint")
    config = AutoMLConfig("classification", ["logistic"], trials=1, folds=2, space={})
    found, _ = automl_with_features(df, FeaturePlan("y", [], categorical=["c"], encoding="target"), ["id"], config)
    metrics = {r["metric"]: r["value"] for r in found.metrics.collect()}
    auc = next(v for k, v in metrics.items() if "auc" in k)
    assert 0.3 < auc < 0.7


def test_written_tables_go_with_their_block(spark):
    import os

    from plumbline.session import intermediates, shared_dir, written

    with intermediates(spark):
        assert written(spark.range(5)).count() == 5
        held = {f for f in os.listdir(shared_dir(spark).removeprefix("file:")) if f.startswith("table-")}
    left = {f for f in os.listdir(shared_dir(spark).removeprefix("file:")) if f.startswith("table-")}
    assert len(held - left) == 1


def test_json_written_here_is_read_whole(spark, tmp_path):
    from plumbline.sources.readers import load
    from plumbline.sources.writers import save

    rows = spark.createDataFrame([(i, f"t{i}") for i in range(1500)], "i bigint, t string")
    save(rows, str(tmp_path / "x.json"))
    assert load(spark, str(tmp_path / "x.json")).count() == 1500
    (tmp_path / "doc.json").write_text('[{"i": 1},\n {"i": 2}]')
    assert load(spark, str(tmp_path / "doc.json")).count() == 2
    (tmp_path / "one.json").write_text('{\n "i": 1,\n "t": "a"\n}')
    assert load(spark, str(tmp_path / "one.json")).count() == 1


def test_search_fits_every_trial_in_every_fold_as_drawn(flowers):
    """The scores are those of Spark's own forest with the drawn settings, on rows dealt into the given number of tasks."""
    data = flowers.dropDuplicates().fillna(0.0)
    space = {**SPACE, "subsample": ("float", 0.6, 1.0), "colsample": ("float", 0.6, 1.0)}
    config = ML.AutoMLConfig("classification", ["logistic", "random_forest"], trials=4, folds=3, space=space, rows_per_task=1000)
    found = ML.automl(data, ["a", "b"], "target", ["id"], config)
    keyed = data.withColumn("_fold", (ML.hash_number(["id"], config.seed + 1) % 3).cast("int"))
    made = ML.assemble(keyed, ["a", "b"], "target", keep=["id", "_fold"]).repartition(1).sortWithinPartitions("id")
    train = ML.hash_split(made, ["id"], 0.8, config.seed)[0].select("features", "label", "_fold").persist()
    judge = ML.MulticlassClassificationEvaluator(metricName="f1")
    got = {r.trial: (r.algorithm, r.score) for r in found.trials.collect()}
    for i, p in enumerate(ML.draw_trials(config)):
        if p["algorithm"] == "logistic":
            learner = ML.LogisticRegression(regParam=p["learning_rate"])
        else:
            learner = ML.RandomForestClassifier(numTrees=p["n_estimators"], maxDepth=p["max_depth"], seed=config.seed, subsamplingRate=p["subsample"],
                                                featureSubsetStrategy=str(p["colsample"]))
        scores = [judge.evaluate(learner.fit(train.filter(f"_fold <> {f}")).transform(train.filter(f"_fold = {f}"))) for f in range(3)]
        assert got[i] == (p["algorithm"], pytest.approx(sum(scores) / 3, abs=1e-9))
    with pytest.raises(ValueError, match="fold 0 is empty"):
        ML.automl(data.filter((ML.hash_number(["id"], config.seed + 1) % 3) != 0), ["a", "b"], "target", ["id"], config)


def test_forests_make_their_trees_only_when_asked(flowers):
    rows = ML.assemble(flowers.fillna(0.0), ["a", "b"], "target")
    for task, kind in (("classification", "Classification"), ("regression", "Regression")):
        model = ML.learner_for("random_forest", task).fit(rows, {})
        assert "trees" not in vars(model) and "trees" not in vars(model.copy())
        assert [type(t).__name__ for t in model.trees] == [f"DecisionTree{kind}Model"] * 20
        assert ML.feature_importance(model, ["a", "b"], flowers).first()["feature"] == "a"
