"""Model metrics and comparison of variants, from counts and one-pass aggregates."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.columns import ref
from plumbline.functions.scores import normal_cdf
from plumbline.operators.ranks import running


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``label, prediction, count``; two numeric columns are compared as doubles."""
    numeric = all(isinstance(df.schema[c].dataType, T.NumericType) for c in (label, prediction))
    kind = "double" if numeric else "string"
    return df.groupBy(ref(label).cast(kind).alias("label"), ref(prediction).cast(kind).alias("prediction")).agg(
        F.count(F.lit(1)).alias("count")
    )


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy and label-weighted precision, recall and F1 (0 where undefined)."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0)
    zero = F.lit(0)
    shares = F.array(
        F.struct(F.col("label").alias("class"), hit.alias("hits"),
                 F.col("count").alias("support"), zero.alias("predicted")),
        F.struct(F.col("prediction").alias("class"), zero.alias("hits"),
                 zero.alias("support"), F.col("count").alias("predicted")),
    )
    counted = confusion(df, label, prediction)
    per_class = counted.select(F.inline(shares)).groupBy("class").agg(
        F.sum("hits").alias("hits"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted")
    )
    precision = F.coalesce(F.col("hits") / F.nullif("predicted", F.lit(0)), F.lit(0.0))
    recall = F.coalesce(F.col("hits") / F.nullif("support", F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(2.0 * F.col("hits") / F.nullif(F.col("predicted") + F.col("support"), F.lit(0)), F.lit(0.0))
    rows = F.sum("support")
    return per_class.agg(
        (F.sum("hits") / rows).alias("accuracy"),
        (F.sum(precision * F.col("support")) / rows).alias("precision"),
        (F.sum(recall * F.col("support")) / rows).alias("recall"),
        (F.sum(f1 * F.col("support")) / rows).alias("f1"),
    )


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", positive: object = 1) -> DataFrame:
    """One row ``roc_auc``: rank statistic over counts per distinct score, ties averaged."""
    is_positive = (ref(label) == F.lit(positive)).cast("long")
    counts = df.groupBy(ref(score).cast("double").alias("score")).agg(
        F.sum(is_positive).alias("positives"), F.sum(1 - is_positive).alias("negatives")
    )
    ranked = running(counts, [], ["score"], sums={"upto": "negatives"})
    won = F.col("positives") * (F.col("upto") - F.col("negatives") / 2)
    return ranked.agg(
        (F.sum(won) / F.nullif(F.sum("positives") * F.sum("negatives").cast("double"), F.lit(0.0))).alias("roc_auc")
    )


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: mse, rmse, mae, r2."""
    y, p = ref(label).cast("double"), ref(prediction).cast("double")
    mse = F.avg((y - p) * (y - p))
    return df.agg(
        mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(y - p)).alias("mae"),
        (1 - mse / F.nullif(F.var_pop(y), F.lit(0.0))).alias("r2"),
    )


def ab_test(
    df: DataFrame, variant: str, metric: str, control: object, treatment: object,
    confidence: float = 0.95, sample_size: int = 100,
) -> DataFrame:
    """One row comparing two variants: scores, Welch z, two-sided p-value and the verdict.

    A verdict needs ``sample_size`` rows on each side.
    """
    m = ref(metric).cast("double")
    sides = {"control": F.when(ref(variant) == F.lit(control), m),
             "treatment": F.when(ref(variant) == F.lit(treatment), m)}
    aggs = []
    for side, value in sides.items():
        aggs += [F.count(value).alias(f"{side}_rows"), F.avg(value).alias(f"{side}_score"),
                 F.var_samp(value).alias(f"{side}_var")]
    one = df.filter(ref(variant).isin(control, treatment)).agg(*aggs)
    spread = F.sqrt(F.col("control_var") / F.col("control_rows") + F.col("treatment_var") / F.col("treatment_rows"))
    z = (F.col("treatment_score") - F.col("control_score")) / F.nullif(spread, F.lit(0.0))
    enough = F.least("control_rows", "treatment_rows") >= sample_size
    critical = NormalDist().inv_cdf(0.5 + confidence / 2)
    return one.withColumn("z", z).select(
        "control_rows", "treatment_rows", "control_score", "treatment_score", "z",
        (2 * (1 - normal_cdf(F.abs("z")))).alias("p_value"),
        F.coalesce(enough & (F.abs("z") > critical), F.lit(False)).alias("is_significant"),
    )
