"""What changed between two versions of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.columns import comparable, ref


def diff(before: DataFrame, after: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Changes from ``before`` to ``after``.

    With ``keys`` (unique per row): ``keys..., change, column, old, new``, one row per changed cell
    and one per added or removed row. Without: the rows that differ, with ``change`` and ``copies``.
    """
    return _by_row(before, after) if keys is None else _by_key(before, after, keys)


def _by_row(before: DataFrame, after: DataFrame) -> DataFrame:
    """Multiset difference from one shuffle: copies after minus copies before per distinct row."""
    nested = [c for c in before.columns if isinstance(before.schema[c].dataType, T.MapType)]
    sides = []
    for frame, sign in ((before, -1), (after, 1)):
        flat = frame.select(*[comparable(frame, c).alias(c) if c in nested else ref(c)
                              for c in before.columns])
        sides.append(flat.withColumn("_sign", F.lit(sign)))
    net = sides[0].unionByName(sides[1]).groupBy(*[ref(c) for c in before.columns]).agg(
        F.sum("_sign").alias("_net")
    )
    return net.filter(F.col("_net") != 0).select(
        *[ref(c) for c in before.columns],
        F.when(F.col("_net") > 0, "added").otherwise("removed").alias("change"),
        F.abs("_net").alias("copies"),
    )


def _by_key(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    cells = [c for c in before.columns if c in after.columns and c not in keys]

    def side(frame: DataFrame, tag: str) -> DataFrame:
        return frame.select(
            *[ref(c).alias(f"_{tag}k{i}") for i, c in enumerate(keys)],
            *[comparable(frame, c).cast("string").alias(f"_{tag}{i}") for i, c in enumerate(cells)],
            F.lit(True).alias(f"_{tag}here"),
        )

    match = F.lit(True)
    for i in range(len(keys)):
        match = match & F.col(f"_bk{i}").eqNullSafe(F.col(f"_ak{i}"))
    joined = side(before, "b").join(side(after, "a"), match, "full_outer")
    none = F.lit(None).cast("string")

    def change(kind: str, column, old, new):
        return F.struct(F.lit(kind).alias("change"), column.alias("column"), old.alias("old"), new.alias("new"))

    changed = F.filter(
        F.array(*[
            F.when(~F.col(f"_b{i}").eqNullSafe(F.col(f"_a{i}")),
                   change("changed", F.lit(c), F.col(f"_b{i}"), F.col(f"_a{i}")))
            for i, c in enumerate(cells)
        ]) if cells else F.array().cast("array<struct<change:string,column:string,old:string,new:string>>"),
        lambda x: x.isNotNull(),
    )
    events = (
        F.when(F.col("_bhere").isNull(), F.array(change("added", none, none, none)))
        .when(F.col("_ahere").isNull(), F.array(change("removed", none, none, none)))
        .otherwise(changed)
    )
    return joined.select(
        *[F.coalesce(F.col(f"_bk{i}"), F.col(f"_ak{i}")).alias(c) for i, c in enumerate(keys)],
        F.inline(events),
    )
