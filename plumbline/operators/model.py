"""Training, search, importance and batch scoring on Spark ML."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressionModel,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.columns import numeric_columns, ref, union_all
from plumbline.operators.features import FeatureModel, FeaturePlan, fit_features
from plumbline.operators.metrics import classification_metrics, regression_metrics, roc_auc
from plumbline.operators.ranks import running
from plumbline.operators.sampling import hash_number, hash_split
from plumbline.session import materialize

# The search space and its budget.
SEARCH_SPACE = {
    "n_estimators": ("int", 50, 300),
    "max_depth": ("int", 3, 10),
    "learning_rate": ("log", 0.01, 0.3),
    "subsample": ("float", 0.6, 1.0),
    "colsample": ("float", 0.6, 1.0),
}
TRIALS = 30
FOLDS = 5
SEED = 42
MAX_CLASSES = 1000


class ForestClassificationModel(RandomForestClassificationModel):
    """``trees`` as a plain property: the cached one is read whenever params are listed, so each fit and copy wraps every tree in Python."""

    trees = property(lambda self: [DecisionTreeClassificationModel(m) for m in self._call_java("trees")])


class ForestRegressionModel(RandomForestRegressionModel):
    trees = property(lambda self: [DecisionTreeRegressionModel(m) for m in self._call_java("trees")])


class ForestClassifier(RandomForestClassifier):
    def _create_model(self, java_model) -> ForestClassificationModel:
        return ForestClassificationModel(java_model)


class ForestRegressor(RandomForestRegressor):
    def _create_model(self, java_model) -> ForestRegressionModel:
        return ForestRegressionModel(java_model)


CLASSIFIERS = {"gbt": GBTClassifier, "random_forest": ForestClassifier, "logistic": LogisticRegression}
REGRESSORS = {"gbt": GBTRegressor, "random_forest": ForestRegressor, "linear": LinearRegression}
CLASS_METRICS = {"f1": "f1", "accuracy": "accuracy", "precision": "weightedPrecision", "recall": "weightedRecall"}
NUMBER_METRICS = ("rmse", "mse", "mae", "r2")


@dataclass
class AutoMLConfig:
    task: str = "classification"
    algorithms: list[str] = field(default_factory=lambda: ["gbt"])
    metric: str | None = None
    trials: int = TRIALS
    folds: int = FOLDS
    seed: int = SEED
    space: dict[str, tuple] = field(default_factory=lambda: dict(SEARCH_SPACE))
    parallelism: int = 4
    rows_per_task: int | None = None  # None leaves the rows in the partitions they come in

    def __post_init__(self) -> None:
        self.metric = self.metric or ("f1" if self.task == "classification" else "rmse")
        known = CLASS_METRICS if self.task == "classification" else NUMBER_METRICS
        if self.metric not in known:
            raise ValueError(f"metric {self.metric!r} is not one of {list(known)}")


def default_automl_config(task: str) -> AutoMLConfig:
    return AutoMLConfig(task)


def assemble(df: DataFrame, features: list[str], target: str | None = None, keep: list[str] | None = None, invalid: str = "error") -> DataFrame:
    """``features`` vector and ``label`` column; rows without a label are left out.

    A null or NaN feature is an error, as it should be imputed first; ``invalid="skip"`` leaves its row out.
    """
    inputs = df.select(*[ref(c) for c in dict.fromkeys(features + (keep or []))],
                       *([ref(target).cast("double").alias("label")] if target else []))
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid=invalid)
    made = assembler.transform(inputs)
    if target:
        made = made.filter(F.col("label").isNotNull())
    extra = [ref(c) for c in keep or []]
    return made.select(*extra, "features", *(["label"] if target else []))


def draw_trials(config: AutoMLConfig) -> list[dict[str, Any]]:
    """Seeded random settings from the search space."""
    rng = random.Random(config.seed)
    out = []
    for i in range(config.trials):
        params: dict[str, Any] = {"algorithm": config.algorithms[i % len(config.algorithms)]}
        for name, (kind, low, high) in config.space.items():
            if kind == "int":
                params[name] = rng.randint(low, high)
            elif kind == "log":
                params[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
            else:
                params[name] = rng.uniform(low, high)
        out.append(params)
    return out


def learner_for(algorithm: str, task: str, classes: int = 2, seed: int = SEED):
    """An untuned Spark ML estimator. Boosting is binary in Spark, so more classes are boosted one against the rest."""
    family = CLASSIFIERS if task == "classification" else REGRESSORS
    if algorithm not in family:
        raise ValueError(f"algorithm {algorithm!r} is not one of {list(family)}")
    made = family[algorithm]()
    made = made.setSeed(seed) if made.hasParam("seed") else made
    if algorithm == "random_forest":
        made = made.setCacheNodeIds(True)  # the same trees; else every task of every level gets the forest grown so far
    if task == "classification" and algorithm == "gbt" and classes > 2:
        return OneVsRest(classifier=made)
    return made


def settings_for(learner, params: dict[str, Any]) -> dict:
    """The parameters of one trial that this learner has; linear families search the penalty."""
    if isinstance(learner, OneVsRest):
        inner = learner.getClassifier()
        return {learner.classifier: inner.copy(settings_for(inner, params))}
    wanted = {
        "maxIter" if learner.hasParam("stepSize") else "numTrees": params.get("n_estimators"),
        "maxDepth": params.get("max_depth"),
        "stepSize" if learner.hasParam("stepSize") else "regParam": params.get("learning_rate"),
        "subsamplingRate": params.get("subsample"),
        "featureSubsetStrategy": str(params["colsample"]) if "colsample" in params else None,
    }
    return {learner.getParam(k): v for k, v in wanted.items() if v is not None and learner.hasParam(k)}


def _evaluator(config: AutoMLConfig):
    if config.task == "classification":
        return MulticlassClassificationEvaluator(metricName=CLASS_METRICS[config.metric])
    return RegressionEvaluator(metricName=config.metric)


@dataclass
class AutoMLResult:
    model: Model
    params: dict[str, Any]
    score: float
    trials: DataFrame  # trial, algorithm, params, score: best first
    metrics: DataFrame  # on rows held out before the search
    importance: DataFrame


def _dealt(rows: DataFrame, per_task: int) -> DataFrame:
    """``rows`` in even, ordered partitions: each task of a forest sends counts for every open node, however few rows it has."""
    made = materialize(rows)
    tasks = max(1, math.ceil(made.count() / per_task))
    return materialize(made.repartition(tasks).sortWithinPartitions(*[ref(c) for c in made.columns]))


def automl(
    df: DataFrame, features: list[str], target: str, key: list[str], config: AutoMLConfig | None = None
) -> AutoMLResult:
    """Hold out a fifth, search on the rest with folds fixed by key hash, report on the held-out rows.

    The returned model is refitted on all rows.
    """
    config = config or AutoMLConfig()
    keyed = df.withColumn("_fold", (hash_number(key, config.seed + 1) % config.folds).cast("int"))
    data = assemble(keyed, features, target, keep=[*key, "_fold"])
    if config.rows_per_task:
        data = _dealt(data, config.rows_per_task)
    train, test = hash_split(data, key, 0.8, config.seed)
    train, test = train.select("features", "label", "_fold"), test.select("features", "label")
    classes = 2
    if config.task == "classification":
        labels = [r[0] for r in data.select("label").distinct().orderBy("label").limit(MAX_CLASSES + 1).collect()]
        if len(labels) > MAX_CLASSES or labels != [float(i) for i in range(len(labels))]:
            raise ValueError(f"class labels must be 0, 1, ... below {MAX_CLASSES} without gaps (index them first), not {labels[:20]}")
        classes = max(2, len(labels))
    train = train.persist()
    judge = _evaluator(config)
    larger = judge.isLargerBetter()
    trials = list(enumerate(draw_trials(config)))
    learners = {a: learner_for(a, config.task, classes, config.seed) for a in dict.fromkeys(p["algorithm"] for _, p in trials)}
    sizes = dict(map(tuple, train.groupBy("_fold").count().collect()))
    for f in range(config.folds):
        if set(sizes) <= {f}:
            raise ValueError(f"The training data at fold {f} is empty.")
        if f not in sizes:
            raise ValueError(f"The validation data at fold {f} is empty.")

    def fit(params: dict[str, Any], rows: DataFrame) -> Model:
        learner = learners[params["algorithm"]]
        return learner.fit(rows, settings_for(learner, params))

    def scored(one: tuple[int, dict[str, Any]]) -> float:
        f, params = one
        return judge.evaluate(fit(params, train.filter(F.col("_fold") != f)).transform(train.filter(F.col("_fold") == f)))

    # one queue of all fits, so that no fold or family waits for the slowest fit of the one before
    with ThreadPool(config.parallelism) as pool:
        found = pool.map(inheritable_thread_target(df.sparkSession)(scored), [(f, p) for _, p in trials for f in range(config.folds)], chunksize=1)
    scores = [sum(found[k:k + config.folds]) / config.folds for k in range(0, len(found), config.folds)]
    tried, winner = [], None
    for algorithm in learners:
        mine = [(i, p, s) for (i, p), s in zip(trials, scores) if p["algorithm"] == algorithm]
        tried += mine
        top = max(mine, key=lambda t: t[2] if larger else -t[2])
        if winner is None or (top[2] > winner[2]) == larger and top[2] != winner[2]:
            winner = top
    tried.sort(key=lambda t: -t[2] if larger else t[2])
    _, best_params, best_score = winner
    held_out = fit(best_params, train).transform(test)  # fitted on the training rows only
    train.unpersist()
    metrics = model_metrics(held_out, config.task, classes)
    final = fit(best_params, data.select("features", "label"))
    return AutoMLResult(final, best_params, best_score, _history(df.sparkSession, tried), metrics, feature_importance(final, features, df))


def automl_with_features(
    df: DataFrame, plan: FeaturePlan, key: list[str], config: AutoMLConfig | None = None
) -> tuple[AutoMLResult, FeatureModel]:
    """Search over raw rows, with the features fitted inside it.

    A fifth is held out first. In every fold the features are fitted on the fold's training rows only, so nothing of a
    row's target reaches its own features; the reported metrics come from features and a model that never saw the
    held-out rows. Both are then refitted on all rows.
    """
    config = config or AutoMLConfig()
    train, test = hash_split(df, key, 0.8, config.seed)
    fold = hash_number(key, config.seed + 1) % config.folds
    judge = _evaluator(config)
    larger = judge.isLargerBetter()
    trials = list(enumerate(draw_trials(config)))
    classes = 2
    if config.task == "classification":
        classes = max(2, df.select(F.countDistinct(ref(plan.target))).first()[0])
    learners = {a: learner_for(a, config.task, classes, config.seed) for a in dict.fromkeys(config.algorithms)}

    def prepared(fit_on: DataFrame, *tables: DataFrame) -> tuple[FeatureModel, list[str], list[DataFrame]]:
        fitted = fit_features(fit_on, plan)
        made = [fitted.transform(t) for t in tables]
        names = fitted.feature_names(made[0])
        return fitted, names, [assemble(m, names, plan.target) for m in made]

    def fit(params: dict[str, Any], rows: DataFrame) -> Model:
        learner = learners[params["algorithm"]]
        return learner.fit(rows, settings_for(learner, params))

    totals = [0.0] * len(trials)
    for f in range(config.folds):
        inside = train.filter(fold != f)
        _, _, (rows, checked) = prepared(inside, inside, train.filter(fold == f))
        rows, checked = rows.persist(), checked.persist()
        with ThreadPool(config.parallelism) as pool:
            found = pool.map(inheritable_thread_target(df.sparkSession)(lambda t: judge.evaluate(fit(t[1], rows).transform(checked))), trials)
        totals = [a + b for a, b in zip(totals, found)]
        rows.unpersist()
        checked.unpersist()
    tried = sorted(((i, p, s / config.folds) for (i, p), s in zip(trials, totals)), key=lambda t: -t[2] if larger else t[2])
    _, best_params, best_score = tried[0]
    _, _, (rows, unseen) = prepared(train, train, test)
    metrics = model_metrics(fit(best_params, rows).transform(unseen), config.task, classes)
    fitted, names, (everything,) = prepared(df, df)
    final = fit(best_params, everything)
    history = _history(df.sparkSession, tried)
    return AutoMLResult(final, best_params, best_score, history, metrics, feature_importance(final, names, df)), fitted


def _history(spark: SparkSession, tried: list[tuple]) -> DataFrame:
    rows = [(i, p["algorithm"], {k: str(v) for k, v in p.items()}, float(s)) for i, p, s in tried]
    return spark.createDataFrame(rows, "trial int, algorithm string, params map<string,string>, score double")


def model_metrics(predictions: DataFrame, task: str, classes: int = 2) -> DataFrame:
    """``metric, value`` for scored rows."""
    if task != "classification":
        one = regression_metrics(predictions)
    else:
        one = classification_metrics(predictions)
    parts = [_metric_rows(one)]
    if task == "classification" and classes == 2 and "probability" in predictions.columns:
        scored = predictions.withColumn("score", vector_to_array("probability")[1])
        parts.append(_metric_rows(roc_auc(scored)))
    return union_all(parts)


def _metric_rows(one: DataFrame) -> DataFrame:
    slots = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one.columns]
    return one.select(F.inline(F.array(*slots)))


def feature_importance(model: Model, names: list[str], df: DataFrame) -> DataFrame:
    """``feature, importance``: tree importance, or absolute coefficients, largest first."""
    if hasattr(model, "models"):
        values = sum(m.featureImportances.toArray() for m in model.models) / len(model.models)
    elif hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    elif getattr(model, "numClasses", 2) > 2:
        values = abs(model.coefficientMatrix.toArray()).max(axis=0)
    else:
        values = abs(model.coefficients.toArray())
    ranked = sorted(zip(names, (float(v) for v in values)), key=lambda p: (-p[1], p[0]))
    return df.sparkSession.createDataFrame(ranked, "feature string, importance double")


def permutation_importance(
    model: Model, df: DataFrame, features: list[str], target: str, key: list[str],
    task: str = "classification", seed: int = SEED,
) -> DataFrame:
    """``feature, base, shuffled, drop``: what the metric loses when one feature is shuffled.

    Every row is paired with another by ranking the table in two hash orders; one join serves all
    features.
    """
    rows = df.select(*[ref(c) for c in dict.fromkeys(key + features)], ref(target).alias("_target"))

    def ranked(shift: int, name: str) -> DataFrame:
        hashed = rows.withColumns({"_h": hash_number(key, seed + shift), "_one": F.lit(1)})
        return running(hashed, [], ["_h", *key], sums={name: "_one"}).drop("_h", "_one")

    left = ranked(1, "_rank")
    right = ranked(2, "_rank").select("_rank", *[ref(c).alias(f"_p_{c}") for c in features])
    paired = left.join(right, "_rank").persist()
    column = "f1" if task == "classification" else "rmse"
    metrics = classification_metrics if task == "classification" else regression_metrics

    def scored(swap: str | None) -> DataFrame:
        cols = [ref(f"_p_{c}" if c == swap else c).alias(c) for c in features]
        table = assemble(paired.select(*cols, "_target"), features, "_target")
        return metrics(model.transform(table)).select(F.lit(swap).alias("feature"), F.col(column).alias("value"))

    base = scored(None).first()["value"]
    out = union_all([scored(c) for c in features])
    sign = 1 if task == "classification" else -1
    return out.select("feature", F.lit(base).alias("base"), F.col("value").alias("shuffled"),
                      (sign * (F.lit(base) - F.col("value"))).alias("drop"))


def ensemble(
    predictions: list[DataFrame], key: list[str], value: str, weights: list[float] | None = None,
    vote: bool = False,
) -> DataFrame:
    """``key..., value``: weighted average of several models' outputs, or their majority vote.

    Vote ties go to the smaller value.
    """
    weights = weights or [1.0] * len(predictions)
    stacked = union_all([
        p.select(*[ref(c) for c in key], ref(value).alias("_v"), F.lit(w).alias("_w"))
        for p, w in zip(predictions, weights)
    ])
    keys = [ref(c) for c in key]
    if not vote:
        return stacked.groupBy(*keys).agg((F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias(value))
    tally = stacked.groupBy(*keys, "_v").agg(F.sum("_w").alias("_n"))
    return tally.groupBy(*keys).agg(F.min_by("_v", F.struct(-F.col("_n"), F.col("_v"))).alias(value))


def score(df: DataFrame, features: FeatureModel | None, model: Model | PipelineModel, keep: list[str] | None = None) -> DataFrame:
    """Raw rows to ``keep..., prediction`` and, for classifiers, the top class ``probability``.

    Works on tables and streams.
    """
    if features is None:
        table, names = df, [c for c in numeric_columns(df) if c not in (keep or [])]
    else:
        table = features.transform(df, keep)
        names = features.feature_names(table)
    vectors = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(table)
    scored = model.transform(vectors)
    out = [*(ref(c) for c in keep or []), F.col("prediction")]
    if "probability" in scored.columns:
        out.append(F.array_max(vector_to_array("probability")).alias("probability"))
    return scored.select(*out)
