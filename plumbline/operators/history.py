"""Versioned records: latest, best, roll back, retain, top-k and progress per key.

Rank filters let Spark keep only the wanted rows per key before the shuffle. Running values go
through ``ranks.running``, which spreads a busy key over several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.columns import ref
from plumbline.operators.ranks import running

GROUP_LIMIT = 1000  # spark.sql.optimizer.windowGroupLimitThreshold
SLICES = 64


def _ranked(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*[ref(c) for c in by]).orderBy(*order)))


def _first(df: DataFrame, by: list[str], order: list[Column], n: int, ties: list[str]) -> DataFrame:
    """The first ``n`` rows per key. Above the size Spark limits by itself, slices of a key go first."""
    if n > GROUP_LIMIT:
        slot = F.pmod(F.xxhash64(*[ref(c) for c in ties]), F.lit(SLICES))
        sliced = W.partitionBy(*[ref(c) for c in by], slot).orderBy(*order)
        df = df.withColumn("_slice_rank", F.row_number().over(sliced)).filter(F.col("_slice_rank") <= n).drop("_slice_rank")
    return _ranked(df, by, order).filter(F.col("_rank") <= n)


def _newest_first(order: list[str]) -> list[Column]:
    return [ref(c).desc() for c in order]


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest version per key."""
    return _ranked(df, key, _newest_first(order)).filter("_rank = 1").drop("_rank")


def best(df: DataFrame, key: list[str], score: str, order: list[str]) -> DataFrame:
    """The highest score per key; the earliest version wins a tie."""
    by_score = [ref(score).desc_nulls_last(), *[ref(c).asc() for c in order]]
    return _ranked(df, key, by_score).filter("_rank = 1").drop("_rank")


def rollback(df: DataFrame, key: list[str], order: list[str], steps: int = 1) -> DataFrame:
    """The version ``steps`` before the newest; keys with too few versions give no row."""
    return _first(df, key, _newest_first(order), steps + 1, order).filter(F.col("_rank") == steps + 1).drop("_rank")


def retain(df: DataFrame, key: list[str], order: list[str], n: int = 10) -> DataFrame:
    """The newest ``n`` versions per key."""
    return _first(df, key, _newest_first(order), n, order).drop("_rank")


def top_k(
    df: DataFrame, score: str, k: int = 3, by: list[str] | None = None, tie: list[str] | None = None
) -> DataFrame:
    """The ``k`` best rows overall, or per group; ``tie`` orders equal scores."""
    order = [ref(score).desc_nulls_last(), *[ref(c).asc() for c in tie or []]]
    if not by:
        return df.orderBy(*order).limit(k)
    return _first(df, by, order, k, [score, *(tie or [])]).drop("_rank")


def improvement(
    df: DataFrame, key: list[str], round_col: str, score: str, min_improvement: float = 0.05, patience: int = 2
) -> DataFrame:
    """Per key and round: best so far, gain on the first round, and whether to stop early.

    Candidates of one round collapse to their best before anything is ordered.
    """
    rounds = df.groupBy(*[ref(c) for c in key], ref(round_col)).agg(F.max(ref(score)).alias("_score"))
    run = running(rounds, key, [round_col], maxes={"best_score": "_score"}, firsts={"original_score": "_score"})
    stalled = F.col("best_score") <= F.col("original_score") + min_improvement
    return run.select(
        *[ref(c) for c in key], ref(round_col), "original_score", "best_score",
        (F.col("best_score") - F.col("original_score")).alias("improvement"),
        (stalled & (ref(round_col) > patience)).alias("stop"),
    )


def regressions(df: DataFrame, key: list[str], order: list[str], score: str) -> DataFrame:
    """Versions that score below the one before: candidates for an automatic roll back."""
    run = running(df, key, order, lags={"previous_score": score})
    return run.filter(ref(score) < F.col("previous_score"))
