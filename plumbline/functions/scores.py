"""Scores and small statistics as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reward weights and defaults.
REWARD_WEIGHTS = {"success_rate": 0.4, "user_satisfaction": 0.3, "efficiency": 0.2, "safety": 0.1}
COMPOSITE_WEIGHTS = {"success_rate": 0.4, "user_satisfaction": 0.4, "efficiency": 0.2}
COMPOSITE_DEFAULTS = {"success_rate": 0.8, "user_satisfaction": 0.7, "efficiency": 0.8}
NEUTRAL_SCORE = 0.5


def weighted_score(metrics: dict[str, Column] | Column, weights: dict[str, float] | None = None) -> Column:
    """Weighted mean of the metrics present (each clipped to [0, 1]); 0.5 when none is.

    ``metrics`` is a dictionary of columns or one map column.
    """
    weights = weights or REWARD_WEIGHTS
    found = {}
    for name in weights:
        value = metrics.get(name) if isinstance(metrics, dict) else metrics.getItem(name)
        if value is not None:
            found[name] = value
    if not found:
        return F.lit(NEUTRAL_SCORE)
    zero = F.lit(0.0)
    points, mass = zero, zero
    for name, value in found.items():
        clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value.cast("double")))
        points = points + F.coalesce(F.when(value.isNotNull(), clipped * weights[name]), zero)
        mass = mass + F.when(value.isNotNull(), F.lit(weights[name])).otherwise(zero)
    return F.when(mass > 0, points / mass).otherwise(NEUTRAL_SCORE)


def composite_reward(success_rate: Column, user_satisfaction: Column, efficiency: Column) -> Column:
    """Weighted sum with a default for each missing metric, rounded to three digits."""
    values = {"success_rate": success_rate, "user_satisfaction": user_satisfaction, "efficiency": efficiency}
    terms = [F.coalesce(v, F.lit(COMPOSITE_DEFAULTS[k])) * COMPOSITE_WEIGHTS[k] for k, v in values.items()]
    return F.round(terms[0] + terms[1] + terms[2], 3)


def alert_level(score: Column) -> Column:
    """NONE below 0.1, LOW below 0.2, MEDIUM below 0.3, else HIGH."""
    return (
        F.when(score < 0.1, "NONE").when(score < 0.2, "LOW").when(score < 0.3, "MEDIUM").otherwise("HIGH")
    )


def duration_seconds(start: Column, end: Column, now: Column) -> Column:
    """Seconds from start to end, or to ``now`` while open; NULL before the start."""
    stop = F.coalesce(end, now)
    return F.timestamp_diff("MICROSECOND", start, stop) / F.lit(1_000_000.0)


def progress_percent(step: Column, total: Column) -> Column:
    return F.when(total > 0, step / total * 100).otherwise(0.0)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function (Abramowitz and Stegun 26.2.17, error below 7.5e-8)."""
    x = F.abs(z)
    t = 1 / (1 + x * 0.2316419)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) * 0.3989422804014327 * series
    return F.when(z < 0, upper).otherwise(1 - upper)


def log_gamma(a: Column) -> Column:
    """Logarithm of the gamma function for a > 0: Stirling's series eight places up, then stepped down (error below 1e-11)."""
    high = a + 8.0
    inverse = 1.0 / (high * high)
    series = (1.0 / 12 - inverse * (1.0 / 360 - inverse * (1.0 / 1260 - inverse * (1.0 / 1680)))) / high
    down = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0.0), lambda acc, i: acc + F.log(a + i))
    return (high - 0.5) * F.log(high) - high + 0.5 * math.log(2 * math.pi) + series - down


def gamma_upper(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function Q(a, x) for a > 0 and x >= 0.

    Below a + 1 the power series of the lower part, above it the continued fraction of the upper part, both with enough
    terms for double precision: their number grows with the root of ``a``.
    """
    a, x = a.cast("double"), x.cast("double")
    terms = F.sequence(F.lit(1), (F.lit(60) + 12 * F.sqrt(a)).cast("int"))
    front = F.exp(a * F.log(x) - x - log_gamma(a))

    grown = F.struct((1.0 / a).alias("term"), (1.0 / a).alias("total"))
    series = F.aggregate(terms, grown, lambda s, i: F.struct(
        (s["term"] * x / (a + i)).alias("term"), (s["total"] + s["term"] * x / (a + i)).alias("total")))

    # the fraction's terms by ratios of its convergents (Lentz): c and d replace numerators and denominators
    tiny = F.lit(1e-300)

    def kept(value: Column) -> Column:
        return F.when(F.abs(value) < tiny, tiny).otherwise(value)

    def step(s: Column, i: Column) -> Column:
        top, bottom = -i * (i - a), x + 2 * i + 1 - a
        d, c = 1.0 / kept(top * s["d"] + bottom), kept(bottom + top / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    start = 1.0 / kept(x + 1 - a)
    fraction = F.aggregate(terms, F.struct((1.0 / tiny).alias("c"), start.alias("d"), start.alias("h")), step)
    value = F.when(x <= 0, 1.0).when(x < a + 1, 1 - front * series["total"]).otherwise(front * fraction["h"])
    return F.when((a > 0) & x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def chi2_p_value(statistic: Column, dof: Column) -> Column:
    """Upper tail of the chi-squared distribution; NULL without degrees of freedom."""
    free = F.when(dof > 0, dof)
    return gamma_upper(free / 2, statistic / 2)


def kolmogorov_p_value(statistic: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov tail probability."""
    size = F.sqrt(n * m / (n + m))
    scale = (size + 0.12 + 0.11 / size) * statistic
    tail = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * scale * scale),
    )
    return F.when(scale < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * tail)))
