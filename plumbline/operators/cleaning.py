"""Cleaning operators. Statistics are fitted by an aggregate and applied as literals, so fences and
null tests can reach the scan and no row is ever joined to its own table's totals."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.columns import comparable, numeric_columns, pick, ref, string_columns, union_all
from plumbline.operators.profile import load_stats
from plumbline.operators.ranks import quantile_values

FILLS = ("mean", "median", "mode")


def remove_duplicates(
    df: DataFrame, subset: list[str] | None = None, order_by: list[str] | None = None
) -> DataFrame:
    """Whole-row distinct, or the first row per ``subset`` in ``order_by`` order."""
    keys = pick(df, subset, df.columns)
    named = {f"_key{i}": comparable(df, c) for i, c in enumerate(keys)}
    if order_by:
        place = W.partitionBy(*named.values()).orderBy(*[ref(c) for c in order_by])
        ranked = df.withColumn("_place", F.row_number().over(place))
        return ranked.filter(F.col("_place") == 1).drop("_place")
    maps = [c for c in keys if isinstance(df.schema[c].dataType, T.MapType)]
    if not maps:
        return df.dropDuplicates(subset)
    return df.withColumns(named).dropDuplicates(list(named)).drop(*named)


def drop_missing(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows with no null in ``cols`` (all columns by default). NaN is not null."""
    for c in pick(df, cols, df.columns):
        df = df.filter(ref(c).isNotNull())
    return df


def fit_mode(df: DataFrame, col: str) -> Any:
    """Most frequent value, smallest on ties: counted per value, so no task holds the column."""
    counts = df.filter(ref(col).isNotNull()).groupBy(ref(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    first = counts.orderBy(F.desc("n"), F.asc("v")).first()
    return None if first is None else first["v"]


def fit_fills(df: DataFrame, fills: dict[str, str]) -> dict[str, Any]:
    """Fill value per column for strategies mean, median and mode; means share one aggregate."""
    unknown = {s for s in fills.values()} - set(FILLS)
    if unknown:
        raise ValueError(f"unknown fill strategies: {sorted(unknown)}")
    numeric = set(numeric_columns(df, "all"))
    out: dict[str, Any] = {}
    means = [c for c, s in fills.items() if s == "mean" and c in numeric]
    if means:
        row = df.agg(*[F.avg(ref(c).cast("double")) for c in means]).first()
        out.update(zip(means, row))
    medians = [c for c, s in fills.items() if s == "median" and c in numeric]
    if medians:
        found = quantile_values(df, {c: [0.5] for c in medians})
        out.update({c: found.get((c, 0.5)) for c in medians})
    out.update({c: fit_mode(df, c) for c, s in fills.items() if s == "mode"})
    return out


def apply_fills(df: DataFrame, values: dict[str, Any]) -> DataFrame:
    """Replace nulls by fitted values; whole-number columns filled with a fraction become double."""
    changed = {}
    for c, value in values.items():
        if value is None:
            continue
        wide = isinstance(value, float) and not isinstance(df.schema[c].dataType, T.FloatType)
        column = ref(c).cast("double") if wide else ref(c)
        changed[c] = F.coalesce(column, F.lit(value).cast("double" if wide else df.schema[c].dataType))
    return df.withColumns(changed) if changed else df


def fill_missing(df: DataFrame, col: str | list[str], strategy: str = "mean") -> DataFrame:
    """Fill nulls with the mean, median (numeric columns only) or mode."""
    cols = [col] if isinstance(col, str) else list(col)
    return apply_fills(df, fit_fills(df, dict.fromkeys(pick(df, cols, []), strategy)))


def fit_fences(
    df: DataFrame, cols: list[str] | None = None, k: float = 1.5, quantile_method: str = "linear"
) -> dict[str, tuple[float, float]]:
    """Tukey fences ``q25 - k*IQR, q75 + k*IQR`` per numeric column."""
    numeric = set(numeric_columns(df, "all"))
    chosen = [c for c in pick(df, cols, numeric_columns(df)) if c in numeric]
    found = quantile_values(df, {c: [0.25, 0.75] for c in chosen}, quantile_method) if chosen else {}
    fences = {}
    for c in chosen:
        low, high = found.get((c, 0.25)), found.get((c, 0.75))
        if low is not None and high is not None:
            fences[c] = (low - k * (high - low), high + k * (high - low))
    return fences


def apply_fences(df: DataFrame, fences: dict[str, tuple[float, float]]) -> DataFrame:
    """Keep rows inside every fence, ends included; null fails the test."""
    for c, (low, high) in fences.items():
        df = df.filter(ref(c).between(low, high))
    return df


def remove_outliers(
    df: DataFrame, cols: list[str], k: float = 1.5, quantile_method: str = "linear"
) -> DataFrame:
    return apply_fences(df, fit_fences(df, cols, k, quantile_method))


def impute_by_group(df: DataFrame, col: str, by: list[str], strategy: str = "mean") -> DataFrame:
    """Fill nulls with the group's mean or mode, falling back to the whole column's.

    Group values come from a pre-aggregated table joined back; adaptive execution broadcasts it
    when it is small and splits hot groups when it is not.
    """
    overall = fit_fills(df, {col: strategy})[col]
    known = df.filter(ref(col).isNotNull())
    keys = [ref(c).alias(f"_g{i}") for i, c in enumerate(by)]
    if strategy == "mean":
        stats = known.groupBy(*keys).agg(F.avg(ref(col).cast("double")).alias("_fill"))
        value = ref(col).cast("double")
    elif strategy == "mode":
        counts = known.groupBy(*keys, ref(col).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        stats = counts.groupBy(*[f"_g{i}" for i in range(len(by))]).agg(
            F.min_by("_v", F.struct(-F.col("_n"), F.col("_v"))).alias("_fill")
        )
        value = ref(col)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    match = F.lit(True)
    for i, c in enumerate(by):
        match = match & ref(c).eqNullSafe(F.col(f"_g{i}"))
    filled = F.coalesce(value, F.col("_fill"), F.lit(overall))
    joined = df.join(stats, match, "left")
    return joined.select(*[filled.alias(c) if c == col else ref(c) for c in df.columns])


# Types tried on text columns, most specific first, with the text each accepts.
TYPE_PATTERNS = {
    "bigint": r"^\s*[+-]?[0-9]{1,18}\s*$",
    "double": r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$",
    "boolean": r"^\s*([tT][rR][uU][eE]|[fF][aA][lL][sS][eE])\s*$",
    "date": r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}\s*$",
    "timestamp": r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?\s*$",
}


def _parsed(value: Column, kind: str) -> Column:
    return F.when(value.rlike(TYPE_PATTERNS[kind]), F.trim(value).try_cast(kind))


def type_ratios(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``column, type, ratio``: share of non-null text values that parse as each type."""
    chosen = pick(df, cols, string_columns(df))
    aggs, structs = [], []
    for i, c in enumerate(chosen):
        aggs.append(F.count(ref(c)).alias(f"n{i}"))
        for kind in TYPE_PATTERNS:
            aggs.append(F.count(_parsed(ref(c), kind)).alias(f"{kind}{i}"))
            structs.append(F.struct(
                F.lit(c).alias("column"), F.lit(kind).alias("type"),
                (F.col(f"{kind}{i}") / F.nullif(F.col(f"n{i}"), F.lit(0))).alias("ratio"),
            ))
    if not chosen:
        return df.sparkSession.createDataFrame([], "column string, type string, ratio double")
    return df.agg(*aggs).select(F.inline(F.array(*structs)))


def fix_types(df: DataFrame, cols: list[str] | None = None, min_ratio: float = 0.99) -> DataFrame:
    """Cast text columns to the first type at least ``min_ratio`` of their values parse as."""
    best: dict[str, str] = {}
    order = list(TYPE_PATTERNS)
    for r in type_ratios(df, cols).collect():  # a few rows per text column
        known = best.get(r["column"])
        if r["ratio"] is not None and r["ratio"] >= min_ratio:
            if known is None or order.index(r["type"]) < order.index(known):
                best[r["column"]] = r["type"]
    return df.withColumns({c: _parsed(ref(c), kind) for c, kind in best.items()}) if best else df


def validate_schema(df: DataFrame, expected: T.StructType, null_threshold: float = 0.5) -> DataFrame:
    """Violations ``column, rule, detail, ratio``: missing, unexpected, wrong type, too many nulls."""
    want = {f.name: f.dataType.simpleString() for f in expected}
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    found = [(c, "missing_column", kind, None) for c, kind in want.items() if c not in have]
    found += [(c, "unexpected_column", kind, None) for c, kind in have.items() if c not in want]
    found += [(c, "wrong_type", f"{have[c]}, expected {kind}", None)
              for c, kind in want.items() if c in have and have[c] != kind]
    fixed = df.sparkSession.createDataFrame(found, "column string, rule string, detail string, ratio double")
    ratio = F.col("null_count") / F.nullif(F.col("row_count"), F.lit(0))
    nulls = load_stats(df).filter(ratio > null_threshold).select(
        "column", F.lit("too_many_nulls").alias("rule"),
        F.concat(F.lit("limit "), F.lit(str(null_threshold))).alias("detail"), ratio.alias("ratio"),
    )
    required = [f.name for f in expected if not f.nullable and f.name in have]
    frames = [fixed, nulls]
    if required:
        frames.append(
            load_stats(df).filter(F.col("column").isin(required) & (F.col("null_count") > 0)).select(
                "column", F.lit("null_in_required").alias("rule"), F.lit("not nullable").alias("detail"),
                ratio.alias("ratio"))
        )
    return union_all(frames)
