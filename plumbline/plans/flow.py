"""The whole flow: load, clean, profile, features, model; and monitoring of a later table."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators.drift import drift, drift_alerts, drift_summary
from plumbline.operators.features import FeatureModel, FeaturePlan, default_feature_plan, fit_features, infer_target
from plumbline.operators.model import AutoMLConfig, AutoMLResult, automl_with_features
from plumbline.operators.profile import correlations, load_stats, profile, quality_issues
from plumbline.operators.records import optimization_targets
from plumbline.plans.cleaning import Cleaned, clean
from plumbline.sources.readers import load, resolve_source
from plumbline.sources.writers import save_stage

STAGE_SCHEMA = """agent_name string, status string, started_at timestamp, completed_at timestamp,
duration_seconds double, calls int, cost double, tokens_used bigint, error string"""


def preflight(spark: SparkSession, source: str, dest: str | None = None) -> None:
    """Fail early when a file source has no data or the destination cannot be understood."""
    spec = resolve_source(source)
    if spec.kind in ("file", "cloud"):
        spark.read.format("binaryFile").load(spec.uri).select("path").limit(1).collect()
    if dest is not None and resolve_source(dest).kind == "api":
        raise ValueError(f"cannot write to {dest}")


def stage_runs(spark: SparkSession, runs: list[tuple]) -> DataFrame:
    """The stage log as a table."""
    return spark.createDataFrame(runs, STAGE_SCHEMA)


@dataclass
class BuildResult:
    stats: DataFrame
    cleaned: Cleaned
    issues: DataFrame
    profile: DataFrame
    correlations: DataFrame
    features: FeatureModel
    table: DataFrame
    model: AutoMLResult | None
    runs: DataFrame


def build(
    spark: SparkSession, source: str | DataFrame, key: list[str], cleaning: list[dict] | None = None,
    features: FeaturePlan | None = None, target: str | None = None, model: AutoMLConfig | None = None,
    stage_path: str | None = None,
) -> BuildResult:
    """Run every stage on one table; a stage that fails raises.

    The cleaned table feeds several stages, so it is written to ``stage_path`` when one is given and
    kept in memory and on disk otherwise.
    """
    runs: list[tuple] = []

    def stage(name: str, work):
        start = datetime.now(timezone.utc)
        made = work()
        end = datetime.now(timezone.utc)
        runs.append((name, "completed", start, end, (end - start).total_seconds(), 0, 0.0, 0, None))
        return made

    raw = stage("loader", lambda: load(spark, source))
    stats = load_stats(raw)
    done = stage("cleaning", lambda: clean(raw, cleaning))
    issues = quality_issues(raw)
    table = save_stage(done.df, stage_path) if stage_path else done.df.persist()
    described, related = stage("profile", lambda: (profile(table), correlations(table)))
    goal = target or (features.target if features and features.target else infer_target(table))
    plan = features or default_feature_plan(table, goal)
    plan.target = goal
    fitted = stage("features", lambda: fit_features(table, plan))
    trained = None
    if model is not None:
        # the search fits the features again inside every fold; what it returns is fitted on all rows
        trained, fitted = stage("model", lambda: automl_with_features(table, plan, key, model))
    made = fitted.transform(table, keep=key)
    return BuildResult(stats, done, issues, described, related, fitted, made, trained, stage_runs(spark, runs))


@dataclass
class MonitorResult:
    scores: DataFrame
    summary: DataFrame
    alerts: DataFrame
    targets: DataFrame


def monitor(
    reference: DataFrame, current: DataFrame, metrics: DataFrame, feedback: DataFrame | None = None,
    formula: str = "standard",
) -> MonitorResult:
    """Drift, its alerts, and the stages worth improving."""
    scores = drift(reference, current, formula=formula)
    summary = drift_summary(scores)
    return MonitorResult(scores, summary, drift_alerts(scores), optimization_targets(metrics, feedback, summary))
