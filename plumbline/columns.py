"""Which columns count as numeric or categorical, and small Column helpers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORE_NUMERIC = (T.FloatType, T.DoubleType, T.IntegerType, T.LongType)
WIDE_NUMERIC = CORE_NUMERIC + (T.ShortType, T.ByteType, T.DecimalType)
NESTED = (T.MapType, T.StructType, T.ArrayType)

# Aggregates over wider tables are built in slices, so generated code stays small.
AGG_WIDTH = 100


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ref(name: str) -> Column:
    """Column by exact name, also when the name holds dots."""
    return F.col(quoted(name))


def numeric_columns(df: DataFrame, numeric: str = "core") -> list[str]:
    kinds = WIDE_NUMERIC if numeric == "all" else CORE_NUMERIC
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def pick(df: DataFrame, cols: Iterable[str] | None, default: Iterable[str]) -> list[str]:
    """``cols`` checked against the schema, or ``default`` when none are named."""
    chosen = list(default) if cols is None else list(cols)
    missing = [c for c in chosen if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return chosen


def comparable(df: DataFrame, name: str) -> Column:
    """A column that can be grouped and compared: nested values become JSON text."""
    kind = df.schema[name].dataType
    return F.to_json(ref(name)) if isinstance(kind, NESTED) else ref(name)


def finite(value: Column) -> Column:
    """The value as double, or NULL for null, NaN and the infinities."""
    as_double = value.cast("double")
    return F.when(F.abs(as_double) < F.lit(float("inf")), as_double)


def event_time(df: DataFrame, ts: str) -> Column:
    """The time column as a zoned timestamp; left alone if it is one, so its watermark is kept."""
    return ref(ts) if isinstance(df.schema[ts].dataType, T.TimestampType) else ref(ts).cast("timestamp")


def slices(items: list, width: int = AGG_WIDTH) -> list[list]:
    return [items[i : i + width] for i in range(0, len(items), width)] or [[]]


def rows_from(aggregated: DataFrame, structs: list[Column]) -> DataFrame:
    """Turn a one-row aggregate into one row per struct."""
    return aggregated.select(F.inline(F.array(*structs)))


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
