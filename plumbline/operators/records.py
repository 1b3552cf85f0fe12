"""Roll-ups over the engine's own log tables: jobs, artifacts, calls and stage runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.columns import event_time, ref, union_all
from plumbline.functions.text import KEYWORD_STAGES, tag_keywords
from plumbline.operators.ranks import running


def recent_jobs(df: DataFrame, status: str | None = None, limit: int = 100) -> DataFrame:
    """Newest jobs first, optionally of one status."""
    chosen = df if status is None else df.filter(F.col("status") == status)
    return chosen.orderBy(F.desc("created_at"), "id").limit(limit)


def filter_artifacts(
    df: DataFrame, job_id: str | None = None, agent: str | None = None, type: str | None = None,
    tags: list[str] | None = None,
) -> DataFrame:
    """Artifacts equal in each field named and holding any of ``tags``."""
    for name, value in (("job_id", job_id), ("agent", agent), ("type", type)):
        if value:
            df = df.filter(F.col(name) == value)
    if tags:
        df = df.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    return df


def artifact_sizes(df: DataFrame, job_id: str | None = None) -> DataFrame:
    """``job_id, artifacts, total_bytes`` per job, and for all jobs together (null job)."""
    chosen = df if job_id is None else df.filter(F.col("job_id") == job_id)
    return chosen.rollup("job_id").agg(
        F.count(F.lit(1)).alias("artifacts"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"),
    )


def provider_of(model: Column) -> Column:
    """The part of a model name before its first slash, or ``unknown``."""
    return F.when(F.contains(model, F.lit("/")), F.split_part(model, F.lit("/"), F.lit(1))).otherwise("unknown")


def usage_rollup(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Calls, tokens, cost and latency for every combination of ``by``; null means all.

    Rows are added up by all keys first, so only these sums are multiplied into combinations.
    """
    keys = by or ["agent", "model", "provider"]
    if "provider" in keys and "provider" not in calls.columns:
        calls = calls.withColumn("provider", provider_of(F.col("model")))
    sums = calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"),
        F.sum("latency_ms").alias("_latency"), F.count("latency_ms").alias("_timed"), F.max("latency_ms").alias("max_latency_ms"),
    )
    return sums.cube(*keys).agg(
        F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"),
        F.try_divide(F.sum("_latency"), F.sum("_timed")).alias("avg_latency_ms"), F.max("max_latency_ms").alias("max_latency_ms"),
    )


def stage_metrics(runs: DataFrame, success: str = "completed") -> DataFrame:
    """Per stage: runs, success and failure rate, run time, tokens and cost."""
    ok = (F.col("status") == success).cast("double")
    return runs.groupBy("agent_name").agg(
        F.count(F.lit(1)).alias("runs"), F.avg(ok).alias("success_rate"), (1 - F.avg(ok)).alias("failure_rate"),
        F.avg("duration_seconds").alias("avg_seconds"), F.max("duration_seconds").alias("max_seconds"),
        F.sum("tokens_used").alias("tokens"), F.sum("cost").alias("cost"),
    )


def optimization_summary(df: DataFrame) -> DataFrame:
    """One row: how many were optimised, total improvement and average original reward (0 if none)."""
    return df.agg(
        F.count(F.lit(1)).alias("optimized"),
        F.coalesce(F.sum("improvement"), F.lit(0.0)).alias("total_improvement"),
        F.coalesce(F.avg("original_reward"), F.lit(0.0)).alias("average_reward"),
    )


def optimization_targets(
    metrics: DataFrame, feedback: DataFrame | None = None, drift_summary: DataFrame | None = None,
    mapping: dict[str, str] | None = None, drift_target: str = "features",
) -> DataFrame:
    """``target``: stages with weak metrics, named in feedback, or touched by drift; each once.

    ``metrics`` has agent, success_rate, user_satisfaction (null counts as 1.0); ``feedback`` has text.
    """
    full = F.lit(1.0)
    satisfaction = F.col("user_satisfaction") if "user_satisfaction" in metrics.columns else F.lit(None)
    weak = (F.coalesce("success_rate", full) < 0.8) | (F.coalesce(satisfaction, full) < 0.7)
    frames = [metrics.filter(weak).select(F.col("agent").alias("target"))]
    if feedback is not None:
        tags = tag_keywords(F.col("text"), mapping or KEYWORD_STAGES)
        frames.append(feedback.select(F.explode(tags).alias("target")))
    if drift_summary is not None:
        frames.append(drift_summary.filter("drift_detected").select(F.lit(drift_target).alias("target")))
    return union_all(frames).distinct()


def budget_status(
    calls: DataFrame, ts: str = "ts", cost: str = "cost", period: str = "day", tie: list[str] | None = None,
    alert: float = 10.0, limit: float = 50.0,
) -> DataFrame:
    """Every call with what its period has spent so far and ``ok``, ``alert`` or ``blocked``."""
    stamped = calls.withColumn("period_start", F.date_trunc(period, ref(ts)))
    spent = running(stamped, ["period_start"], [ts, *(tie or [])], sums={"spent": cost})
    status = F.when(F.col("spent") >= limit, "blocked").when(F.col("spent") >= alert, "alert").otherwise("ok")
    return spent.withColumn("status", status)


def limit_breaches(
    calls: DataFrame, ts: str = "ts", key: list[str] | None = None, tokens: str = "tokens",
    requests_per_minute: int = 60, tokens_per_minute: int = 100_000,
) -> DataFrame:
    """Minutes (per key) over either limit; works on tables and on watermarked streams."""
    minute = F.window(event_time(calls, ts), "1 minute")
    counted = calls.groupBy(minute.alias("minute"), *[ref(c) for c in key or []]).agg(
        F.count(F.lit(1)).alias("requests"), F.sum(ref(tokens)).alias("tokens")
    )
    over = (F.col("requests") > requests_per_minute) | (F.col("tokens") > tokens_per_minute)
    return counted.filter(over).select(
        F.col("minute.start").alias("minute"), *[ref(c) for c in key or []], "requests", "tokens")
