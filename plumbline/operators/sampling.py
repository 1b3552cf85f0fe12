"""Samples and splits that stay the same however the rows are partitioned."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.columns import pick, ref
from plumbline.operators.ranks import running
from plumbline.session import materialize

HASH_RANGE = 2**52


def hash_number(cols: list[str], seed: int = 42) -> Column:
    """A whole number in [0, 2**52) from the MD5 of the seed and the key columns."""
    key = F.concat_ws("|", F.lit(str(seed)), *[ref(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint")


def hash_fraction(df: DataFrame, fraction: float, key: list[str], seed: int = 42) -> DataFrame:
    """About ``fraction`` of the rows, chosen by key: no shuffle."""
    return df.filter(hash_number(key, seed) < int(fraction * HASH_RANGE))


def hash_split(
    df: DataFrame, key: list[str], train: float = 0.8, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by the key's hash modulo 100."""
    slot = hash_number(key, seed) % 100
    cut = round(train * 100)
    return df.filter(slot < cut), df.filter(slot >= cut)


def sample_rows(df: DataFrame, size: int, key: list[str], seed: int = 42) -> DataFrame:
    """Exactly ``size`` rows (all, if fewer): those with the smallest key hashes.

    Hashes are even, so all but a thin band around the cut are decided by a filter; only the band
    is sorted.
    """
    h = hash_number(key, seed)
    total = df.count()
    if total <= size:
        return df
    reach = 6 * math.sqrt(size) + 10
    while True:
        low = max(0, int((size - reach) / total * HASH_RANGE))
        high = min(HASH_RANGE, int((size + reach) / total * HASH_RANGE))
        below, upto = df.agg(F.count_if(h < low), F.count_if(h <= high)).first()
        if below <= size <= upto:
            break
        reach *= 4  # uneven keys
    band = df.filter(h.between(low, high)).orderBy(h, *[ref(c) for c in key]).limit(size - below)
    return df.filter(h < low).unionByName(band)


def sample_strata(
    df: DataFrame, by: list[str], key: list[str], size: int | None = None, per_stratum: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """``per_stratum`` rows of each stratum, or ``size`` rows shared out in proportion.

    Rows that are hardly among a stratum's smallest hashes are dropped before anything is ranked, so
    a stratum holding a third of the table sends only about its quota to one task. The rows left are
    counted: where repeated keys make hashes uneven, a stratum's cut is widened until its quota is there. Equal
    keys are ordered by the remaining columns.
    """
    if (size is None) == (per_stratum is None):
        raise ValueError("give either size or per_stratum")
    keys = pick(df, by, [])
    counts = df.groupBy(*[ref(c).alias(f"_s{i}") for i, c in enumerate(keys)]).agg(
        F.count(F.lit(1)).alias("_rows"))
    if per_stratum is not None:
        quota = F.lit(per_stratum)
    else:
        total = df.count()
        quota = F.round(F.col("_rows") * F.lit(size / max(total, 1))).cast("bigint")
    spare = 10 * F.sqrt(F.col("_quota")) + 100
    counts = counts.withColumn("_quota", quota).withColumn(
        "_cut", (F.col("_quota") + spare) / F.col("_rows") * HASH_RANGE)
    match = F.lit(True)
    for i, c in enumerate(keys):
        match = match & ref(c).eqNullSafe(F.col(f"_s{i}"))
    strata = [f"_s{i}" for i in range(len(keys))]
    hashed = df.withColumn("_h", hash_number(key, seed))
    while True:
        near = hashed.join(counts, match).filter(F.col("_h") <= F.col("_cut"))
        held = near.groupBy(*[F.col(c).alias(f"_g{c}") for c in strata]).agg(F.count(F.lit(1)).alias("_n"))
        same = F.lit(True)
        for c in strata:
            same = same & F.col(c).eqNullSafe(F.col(f"_g{c}"))
        checked = materialize(counts.join(held, same, "left").select(*counts.columns, F.coalesce("_n", F.lit(0)).alias("_held")))
        short = F.col("_held") < F.least("_quota", "_rows")
        if checked.filter(short).isEmpty():
            break
        counts = checked.withColumn("_cut", F.when(short, F.col("_cut") * 8 + HASH_RANGE / 64).otherwise(F.col("_cut"))).drop("_held")
    rest = [c for c, kind in df.dtypes if c not in key and not kind.startswith("map")]
    place = W.partitionBy(*strata).orderBy("_h", *[ref(c) for c in key + rest])
    return near.withColumn("_n", F.row_number().over(place)).filter("_n <= _quota").select(
        *[ref(c) for c in df.columns])


def sample_systematic(df: DataFrame, order_by: list[str], every: int) -> DataFrame:
    """Every ``every``-th row in ``order_by`` order (which must be unique), starting with the first."""
    numbered = running(df.withColumn("_one", F.lit(1)), [], order_by, sums={"_index": "_one"})
    return numbered.filter((F.col("_index") - 1) % every == 0).select(*[ref(c) for c in df.columns])


def auto_sample(
    df: DataFrame, key: list[str], threshold: int, size: int, method: str = "random",
    seed: int = 42, by: list[str] | None = None, order_by: list[str] | None = None,
) -> DataFrame:
    """The table itself up to ``threshold`` rows, else a sample of ``size`` rows."""
    rows = df.count()
    if rows <= threshold:
        return df
    if method == "random":
        return sample_rows(df, size, key, seed)
    if method == "stratified":
        return sample_strata(df, by or [], key, size=size, seed=seed)
    if method == "systematic":
        return sample_systematic(df, order_by or key, math.ceil(rows / size))
    raise ValueError(f"unknown sampling method {method!r}")
