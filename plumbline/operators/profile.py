"""Table profile, quality score and quality issues: one wide aggregate instead of a pass per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.columns import (
    NESTED,
    comparable,
    numeric_columns,
    pick,
    ref,
    rows_from,
    slices,
    string_columns,
    text,
    union_all,
)
from plumbline.operators.pairs import pair_correlations
from plumbline.operators.ranks import quantiles

# Weights of completeness, uniqueness and validity, and the assumed validity.
COMPLETENESS_WEIGHT = 0.4
UNIQUENESS_WEIGHT = 0.3
VALIDITY_WEIGHT = 0.3
DEFAULT_VALIDITY = 0.8


def dtype_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part`` of ``whole`` in percent; NULL for an empty table."""
    return F.round(F.when(whole > 0, part / whole * 100), digits)


def load_stats(df: DataFrame) -> DataFrame:
    """Row and column counts plus dtype and nulls per column, from one aggregate."""
    frames = []
    for cols in slices(df.columns):
        one = df.agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.count_if(ref(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)],
        )
        structs = [
            F.struct(
                F.lit(c).alias("column"),
                F.lit(dtype_of(df, c)).alias("dtype"),
                F.col("rows").alias("row_count"),
                F.lit(len(df.columns)).alias("column_count"),
                F.col(f"n{i}").alias("null_count"),
                percent(F.col(f"n{i}"), F.col("rows")).alias("null_percent"),
            )
            for i, c in enumerate(cols)
        ]
        frames.append(rows_from(one, structs))
    return union_all(frames)


def _family(df: DataFrame, name: str) -> str:
    """Columns of one family share a value slot when their values are counted together."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return "bigint"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "double"
    return "string" if isinstance(kind, NESTED) else kind.simpleString()


def _count_row(df: DataFrame, c: str, rows: Column, nulls: Column, unique: Column) -> Column:
    return F.struct(
        F.lit(c).alias("column"), F.lit(dtype_of(df, c)).alias("dtype"), rows.alias("row_count"),
        nulls.alias("null_count"), unique.alias("n_unique"),
    )


def column_counts(df: DataFrame, distinct: str = "exact", cols: list[str] | None = None) -> DataFrame:
    """``column, dtype, row_count, null_count, n_unique`` per column; null counts as one value.

    Exact counting groups by (column, value) with one scan per type family, so every value is
    counted where it hashes to and columns of one type share the pass.
    """
    chosen = pick(df, cols, df.columns)
    frames = []
    if distinct == "approx":
        for part in slices(chosen, 25):
            one = df.agg(
                F.count(F.lit(1)).alias("rows"),
                *[F.count_if(ref(c).isNull()).alias(f"n{i}") for i, c in enumerate(part)],
                *[F.approx_count_distinct(comparable(df, c)).alias(f"u{i}") for i, c in enumerate(part)],
            )
            frames.append(rows_from(one, [
                _count_row(df, c, F.col("rows"), F.col(f"n{i}"),
                           F.col(f"u{i}") + (F.col(f"n{i}") > 0).cast("int"))
                for i, c in enumerate(part)
            ]))
        return union_all(frames)
    if distinct != "exact":
        raise ValueError(f"unknown distinct mode {distinct!r}")
    families: dict[str, list[str]] = {}
    for c in chosen:
        families.setdefault(_family(df, c), []).append(c)
    for kind, members in families.items():
        slots = F.array(*[F.struct(F.lit(c).alias("column"), comparable(df, c).cast(kind).alias("v"))
                          for c in members])
        counts = df.select(F.inline(slots)).groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
        per_column = counts.groupBy("column").agg(
            F.sum("n").alias("row_count"),
            F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
            F.count(F.lit(1)).alias("n_unique"),
        )
        # an empty table has no groups, yet still has columns
        names = df.sparkSession.createDataFrame([(c, dtype_of(df, c)) for c in members],
                                                "column string, dtype string")
        zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("row_count", "null_count", "n_unique")]
        frames.append(names.join(per_column, "column", "left").select("column", "dtype", *zero))
    return union_all(frames)


def numeric_summary(df: DataFrame, cols: list[str] | None = None, quantile_method: str = "linear") -> DataFrame:
    """``column, mean, std, min, max, median, q25, q75`` of the numeric columns."""
    chosen = pick(df, cols, numeric_columns(df))
    frames = []
    for part in slices(chosen, 10):
        aggs, structs = [], []
        for i, c in enumerate(part):
            v = ref(c).cast("double")
            aggs += [F.avg(v).alias(f"a{i}"), F.stddev_samp(v).alias(f"s{i}"),
                     F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}")]
            structs.append(F.struct(
                F.lit(c).alias("column"), F.col(f"a{i}").alias("mean"), F.col(f"s{i}").alias("std"),
                F.col(f"l{i}").alias("min"), F.col(f"h{i}").alias("max"),
            ))
        frames.append(rows_from(df.agg(*aggs), structs))
    middle = "approx" if quantile_method == "approx" else "linear"
    if middle == quantile_method:
        cut = quantiles(df, {c: [0.25, 0.5, 0.75] for c in chosen}, quantile_method)
    else:
        cut = quantiles(df, {c: [0.5] for c in chosen}, middle).unionByName(
            quantiles(df, {c: [0.25, 0.75] for c in chosen}, quantile_method)
        )
    wide = cut.groupBy("column").agg(
        F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("median"),
        F.max(F.when(F.col("q") == 0.25, F.col("value"))).alias("q25"),
        F.max(F.when(F.col("q") == 0.75, F.col("value"))).alias("q75"),
    )
    return union_all(frames).join(wide, "column", "left")


def profile(
    df: DataFrame, distinct: str = "exact", quantile_method: str = "linear", numeric: str = "core"
) -> DataFrame:
    """One row per column: type, nulls, distinct values and, for numbers, the summary."""
    counts = column_counts(df, distinct).select(
        "column", "dtype", "null_count",
        percent(F.col("null_count"), F.col("row_count")).alias("null_percent"), "n_unique",
    )
    chosen = numeric_columns(df, numeric)
    if not chosen:
        empty = F.lit(None).cast("double")
        return counts.select("*", *[empty.alias(c) for c in
                                    ("mean", "std", "min", "max", "median", "q25", "q75")])
    return counts.join(numeric_summary(df, chosen, quantile_method), "column", "left")


def planning_summary(df: DataFrame, max_cols: int | None = None) -> DataFrame:
    """The short column summary that feature planning reads; ``max_cols`` names a prefix of the columns."""
    return column_counts(df, cols=df.columns[:max_cols]).select(
        "column", "dtype", "n_unique",
        percent(F.col("null_count"), F.col("row_count"), 1).alias("null_pct"),
    )


def unpivot(df: DataFrame, cols: list[str], carry: list[str] | None = None) -> DataFrame:
    """``column, value`` rows (text values) without an extra pass per column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), comparable(df, c).cast("string").alias("value"))
                      for c in cols])
    return df.select(*[ref(c) for c in carry or []], F.inline(pairs))


def value_counts(df: DataFrame, cols: list[str] | None = None, nulls: bool = False) -> DataFrame:
    """``column, value, count``; null values are left out unless asked for."""
    chosen = pick(df, cols, string_columns(df))
    long = unpivot(df, chosen)
    if not nulls:
        long = long.filter(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def top_values(df: DataFrame, cols: list[str] | None = None, k: int = 5) -> DataFrame:
    """The ``k`` most frequent values per string column (null is a value); ties go to the smaller text.

    The rank filter lets Spark keep only ``k`` rows per column and task before the shuffle.
    """
    order = W.partitionBy("column").orderBy(F.desc("count"), F.asc_nulls_last("value"))
    return (
        value_counts(df, cols, nulls=True)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("column", "rank", "value", "count")
    )


def correlations(
    df: DataFrame,
    cols: list[str] | None = None,
    threshold: float = 0.3,
    max_cols: int | None = None,
    digits: int = 3,
) -> DataFrame:
    """Pearson correlation of every numeric pair above ``threshold``, strongest first.

    Rows with a null in either column of a pair do not count for it. All pairs come from one scan of the columns
    (``pairs``); a pair with a column without spread, with NaN or with infinities has no correlation.
    """
    chosen = pick(df, cols, numeric_columns(df))[:max_cols]
    if len(chosen) < 2:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, correlation double")
    gathered = pair_correlations(df, chosen)
    strong = F.abs("r") > threshold
    return (
        gathered.filter(strong)
        .orderBy(F.abs("r").desc(), "column_a", "column_b")
        .select("column_a", "column_b", F.round("r", digits).alias("correlation"))
    )


def highest_correlation(df: DataFrame, **options) -> DataFrame:
    """The strongest pair only."""
    found = correlations(df, digits=options.pop("digits", 3), **options)
    return found.limit(1)


def _row_groups(df: DataFrame) -> DataFrame:
    """One row per distinct table row with its copies and null cells: a single shuffle."""
    keys = [comparable(df, c).alias(f"k{i}") for i, c in enumerate(df.columns)]
    nulls = sum((ref(c).isNull().cast("int") for c in df.columns), F.lit(0))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(nulls).alias("nulls"))


def table_quality(df: DataFrame, uniqueness: str = "exact", validity: float = DEFAULT_VALIDITY) -> DataFrame:
    """One row: row_count, null_cells, distinct_rows, completeness, uniqueness, score."""
    width = len(df.columns)
    if uniqueness == "approx":
        nulls = sum((ref(c).isNull().cast("int") for c in df.columns), F.lit(0))
        row_key = F.xxhash64(*[comparable(df, c) for c in df.columns])
        base = df.agg(
            F.count(F.lit(1)).alias("row_count"),
            F.coalesce(F.sum(nulls), F.lit(0)).alias("null_cells"),
            F.approx_count_distinct(row_key).alias("distinct_rows"),
        )
    else:
        base = _row_groups(df).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
            F.coalesce(F.sum(F.col("n") * F.col("nulls")), F.lit(0)).alias("null_cells"),
            F.count(F.lit(1)).alias("distinct_rows"),
        )
    filled = base.select(
        "*",
        (1 - F.col("null_cells") / (F.nullif(F.col("row_count"), F.lit(0)) * width)).alias("completeness"),
        (F.col("distinct_rows") / F.nullif(F.col("row_count"), F.lit(0))).alias("uniqueness"),
    )
    score = F.least(
        F.lit(1.0),
        F.col("completeness") * COMPLETENESS_WEIGHT
        + F.col("uniqueness") * UNIQUENESS_WEIGHT
        + F.lit(validity) * VALIDITY_WEIGHT,
    )
    return filled.select("*", F.when(F.col("row_count") > 0, score).otherwise(0.0).alias("score"))


def quality_score(df: DataFrame, validity: float = DEFAULT_VALIDITY, uniqueness: str = "exact") -> DataFrame:
    return table_quality(df, uniqueness, validity).select("completeness", "uniqueness", "score")


def quality_gate(df: DataFrame, threshold: float = 0.8, validity: float = DEFAULT_VALIDITY) -> DataFrame:
    """Score against the threshold: ``score, threshold, passed``."""
    return quality_score(df, validity).select(
        "score", F.lit(threshold).alias("threshold"), (F.col("score") >= threshold).alias("passed")
    )


def quality_issues(df: DataFrame, id_pattern: str = "id", distinct: str = "exact") -> DataFrame:
    """``column, type, severity, ratio`` of missing values, repeated ids, constants and copied rows."""
    counts = column_counts(df, distinct)
    nulls = F.col("null_count") / F.nullif(F.col("row_count"), F.lit(0))
    unique = F.col("n_unique") / F.nullif(F.col("row_count"), F.lit(0))
    looks_like_id = F.contains(F.lower("column"), F.lit(id_pattern.lower()))

    def issue(name: str, when: Column, severity: Column, ratio: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("type"), severity.alias("severity"), ratio.alias("ratio")))

    found = F.array(
        issue("missing_values", nulls > 0.1,
              F.when(nulls > 0.5, "HIGH").otherwise("MEDIUM"), nulls),
        issue("duplicates", looks_like_id & (unique < 0.99), F.lit("HIGH"), 1 - unique),
        issue("constant", F.col("n_unique") == 1, F.lit("LOW"), 1 - unique),
    )
    by_column = counts.select("column", F.inline(F.filter(found, lambda x: x.isNotNull())))
    copies = 1 - F.col("uniqueness")
    by_row = table_quality(df, distinct).filter(copies > 0.01).select(
        F.lit("_all_").alias("column"), F.lit("duplicate_rows").alias("type"),
        F.when(copies < 0.1, "MEDIUM").otherwise("HIGH").alias("severity"), copies.alias("ratio"),
    )
    return by_column.unionByName(by_row)


def missing_patterns(df: DataFrame) -> DataFrame:
    """Which columns are null together: ``pattern, rows``."""
    pattern = F.concat_ws(",", *[F.when(ref(c).isNull(), F.lit(c)) for c in df.columns])
    return df.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("rows"))
