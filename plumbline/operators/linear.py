"""Search over ridge regressions by fold statistics: one scan of the table, whatever the number of trials and folds.

A linear model and its squared errors depend on the rows only through the sums of products of (1, features, target). These are added up
once for every fold; the rows a trial trains on are then all folds' sums less its own fold's, and its errors on that fold come from the fold's sums.
So 30 trials x 5 folds, the held-out metrics and the refit on all rows are small matrix solves on the driver.

The penalty is on standardised features in the label's units: with one feature, the slope is divided by 1 + penalty. Rows with a null, NaN or
infinite target or feature take no part. Constant features get the weight 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.columns import finite, ref
from plumbline.operators.model import AutoMLConfig, draw_trials
from plumbline.operators.sampling import hash_number

HELD_OUT = -1
SUMMED = ("rmse", "mse", "r2")


def fold_sums(df: DataFrame, features: list[str], target: str, fold: Column) -> dict[int, np.ndarray]:
    """fold -> sums of products of (1, features, target), each less a fixed value near its mean, and those values under ``None``.

    Tasks add up their batches; the sums of a cell meet in one aggregation, so the driver sees one number for each fold and pair of columns.
    """
    columns = [*features, target]
    size = len(columns) + 1
    rows = df.select(fold.cast("int").alias("fold"), *[finite(ref(c)).alias(f"x{i}") for i, c in enumerate(columns)]).na.drop()
    # products of values far from zero would lose digits; which rows give the shift makes no difference beyond rounding
    first = rows.limit(1000).agg(*[F.avg(f"x{i}") for i in range(len(columns))]).first()
    shift = np.array([0.0, *((v or 0.0) for v in first)])
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            folds = batch.column("fold").to_numpy(zero_copy_only=False)
            x = np.column_stack([np.ones(len(folds)), *(batch.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(len(columns)))]) - shift
            for f in np.unique(folds).tolist():
                mine = x[folds == f]
                sums[f] = sums.get(f, 0.0) + mine.T @ mine
        for f, total in sums.items():
            yield pa.record_batch([pa.array([f] * len(upper[0]), pa.int32()), pa.array(range(len(upper[0])), pa.int32()), pa.array(total[upper])], names=["fold", "cell", "value"])

    out: dict = {None: shift}
    for r in rows.mapInArrow(run, "fold int, cell int, value double").groupBy("fold", "cell").agg(F.sum("value").alias("value")).collect():
        square = out.setdefault(r["fold"], np.zeros((size, size)))
        i, j = upper[0][r["cell"]], upper[1][r["cell"]]
        square[i, j] = square[j, i] = r["value"]
    return out


def ridge(sums: np.ndarray, penalty: float) -> np.ndarray:
    """(intercept, weights) on shifted columns."""
    n = sums[0, 0]
    mean = sums[0, 1:] / n
    cov = sums[1:, 1:] / n - np.outer(mean, mean)
    x, y = cov[:-1, :-1], cov[:-1, -1]
    spread = np.diag(x).copy()
    used = spread > 1e-12 * np.maximum(1.0, mean[:-1] ** 2)
    weights = np.zeros(len(spread))
    if used.any():
        scale = np.sqrt(spread[used])
        corr = x[np.ix_(used, used)] / np.outer(scale, scale) + penalty * np.eye(int(used.sum()))
        weights[used] = np.linalg.lstsq(corr, y[used] / scale, rcond=1e-12)[0] / scale
    return np.concatenate(([mean[-1] - weights @ mean[:-1]], weights))


def errors(sums: np.ndarray, model: np.ndarray) -> dict[str, float]:
    """rmse, mse and r2 of a model on the rows behind ``sums``."""
    n = sums[0, 0]
    residual = np.concatenate((-model, [1.0]))
    mse = max(0.0, float(residual @ sums @ residual / n))
    spread = sums[-1, -1] / n - (sums[0, -1] / n) ** 2
    return {"rmse": float(np.sqrt(mse)), "mse": mse, "r2": float(1 - mse / spread) if spread > 0 else float("nan")}


@dataclass
class LinearSearch:
    intercept: float
    weights: dict[str, float]
    penalty: float
    score: float
    trials: DataFrame  # trial, penalty, fold_scores, score: best first
    metrics: DataFrame  # metric, value on the held-out rows

    def prediction(self) -> Column:
        """The model as an expression over the raw columns."""
        out = F.lit(self.intercept)
        for name, weight in self.weights.items():
            out = out + ref(name).cast("double") * F.lit(weight)
        return out


def linear_search(
    df: DataFrame, features: list[str], target: str, key: list[str], config: AutoMLConfig | None = None,
    fold: Column | None = None, held_out: Column | None = None,
) -> LinearSearch:
    """The documented search (trials, folds, a fifth held out) over ridge penalties, drawn from the space's learning rates.

    Folds and held-out rows follow from the key's hash unless ``fold`` (0 to folds - 1) and ``held_out`` name them. The
    model is refitted on all rows.
    """
    config = config or AutoMLConfig("regression")
    if config.task != "regression" or config.metric not in SUMMED:
        raise ValueError(f"fold statistics give {SUMMED} of a regression, not {config.metric!r} of {config.task}")
    apart = held_out if held_out is not None else hash_number(key, config.seed) % 5 == 4
    number = fold if fold is not None else hash_number(key, config.seed + 1) % config.folds
    sums = fold_sums(df, features, target, F.when(apart, HELD_OUT).otherwise(number))
    shift = sums.pop(None)
    kept = {f: s for f, s in sums.items() if f != HELD_OUT}
    if len(kept) < 2:
        raise ValueError("a search needs rows in two folds at least")
    train = sum(kept.values())
    tried = []
    for i, params in enumerate(draw_trials(config)):
        penalty = params["learning_rate"]
        scores = [errors(own, ridge(train - own, penalty))[config.metric] for _, own in sorted(kept.items())]
        tried.append((i, penalty, scores, float(np.mean(scores))))
    tried.sort(key=lambda t: (-t[3] if config.metric == "r2" else t[3], t[0]))
    _, penalty, _, score = tried[0]
    spark = df.sparkSession
    unseen = errors(sums[HELD_OUT], ridge(train, penalty)) if HELD_OUT in sums else {}
    model = ridge(sum(sums.values()), penalty)
    weights = dict(zip(features, model[1:].tolist()))
    intercept = float(model[0] + shift[-1] - model[1:] @ shift[1:-1])
    return LinearSearch(intercept, weights, penalty, score,
                        spark.createDataFrame(tried, "trial int, penalty double, fold_scores array<double>, score double"),
                        spark.createDataFrame(list(unseen.items()), "metric string, value double"))
