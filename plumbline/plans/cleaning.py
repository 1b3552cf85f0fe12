"""Ordered cleaning plans: operations by name, user operations, SQL expressions, and the report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.columns import numeric_columns, union_all
from plumbline.operators import cleaning as ops
from plumbline.operators.profile import table_quality
from plumbline.session import written

Cleaner = Callable[[DataFrame], DataFrame]
_CLEANERS: dict[str, Cleaner] = {}

# Fixed value: the plan used when none is given.
DEFAULT_PLAN = [{"operation": "remove_duplicates", "target": "all", "strategy": "keep_first"}]


def register_cleaner(name: str, fn: Cleaner) -> None:
    """Make ``fn`` (DataFrame to DataFrame) available to plans under ``name``."""
    _CLEANERS[name] = fn


@dataclass
class Step:
    operation: str
    df: DataFrame
    changes_rows: bool
    fill_value: str | None = None
    lower: float | None = None
    upper: float | None = None


@dataclass
class Cleaned:
    """The cleaned table, what each step fitted, and the report on demand."""

    source: DataFrame
    df: DataFrame
    steps: list[Step] = field(default_factory=list)

    def report(self) -> DataFrame:
        """``step, operation, rows_before, rows_after, rows_affected, fill_value, lower, upper``.

        Rows are counted with plain aggregates, which stay exact when tasks are run again.
        """
        spark = self.source.sparkSession
        counts = [self.source.agg(F.lit(0).alias("step"), F.count(F.lit(1)).alias("rows"))]
        counted = {0: 0}
        for i, step in enumerate(self.steps, start=1):
            counted[i] = i if step.changes_rows else counted[i - 1]
            if step.changes_rows:
                counts.append(step.df.agg(F.lit(i).alias("step"), F.count(F.lit(1)).alias("rows")))
        rows = union_all(counts)
        facts = spark.createDataFrame(
            [(i, s.operation, counted[i - 1], counted[i], s.fill_value, s.lower, s.upper)
             for i, s in enumerate(self.steps, start=1)],
            "step int, operation string, b int, a int, fill_value string, lower double, upper double",
        )
        before = rows.select(F.col("step").alias("b"), F.col("rows").alias("rows_before"))
        after = rows.select(F.col("step").alias("a"), F.col("rows").alias("rows_after"))
        return facts.join(before, "b").join(after, "a").select(
            "step", "operation", "rows_before", "rows_after",
            (F.col("rows_before") - F.col("rows_after")).alias("rows_affected"), "fill_value", "lower", "upper",
        )

    def summary(self) -> DataFrame:
        """One row: rows, columns and quality before and after."""
        def side(df: DataFrame, tag: str) -> DataFrame:
            return table_quality(df).select(
                F.lit(1).alias("one"), F.col("row_count").alias(f"rows_{tag}"),
                F.lit(len(df.columns)).alias(f"cols_{tag}"), F.col("score").alias(f"quality_{tag}"))

        both = side(self.source, "before").join(side(self.df, "after"), "one").drop("one")
        return both.select(
            "*", (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"),
            (F.col("quality_after") - F.col("quality_before")).alias("quality_improvement"),
        )


def clean(df: DataFrame, plan: list[dict[str, Any]] | dict[str, Any] | None = None) -> Cleaned:
    """Apply a plan in order, each step on the result of the one before.

    A step has ``operation`` and, where it applies, ``target`` (a column or ``all``), ``strategy`` and
    ``expr``. Fills on different columns that follow each other are fitted together. Unknown
    operations raise; a column the table lacks is an error too.

    A step that shuffles whole rows (or a user's own, of unknown cost) is written to the shared folder
    when a later step has to fit on it, so the shuffle happens once and fits read only their columns.
    """
    steps = plan.get("cleaning_operations", []) if isinstance(plan, dict) else plan
    todo = list(DEFAULT_PLAN if steps is None else steps)
    out = Cleaned(df, df)
    while todo:
        batch = [todo.pop(0)]
        if _is_fill(batch[0]):
            seen = {batch[0]["target"]}
            while todo and _is_fill(todo[0]) and todo[0]["target"] not in seen:
                seen.add(todo[0]["target"])
                batch.append(todo.pop(0))
            _fill(out, batch)
        else:
            _apply(out, batch[0])
            costly = batch[0].get("operation") == "remove_duplicates" or batch[0].get("operation") in _CLEANERS
            if costly and any(_needs_fit(op) for op in todo):
                out.df = written(out.df)
                out.steps[-1].df = out.df
    return out


def _needs_fit(op: dict[str, Any]) -> bool:
    return _is_fill(op) or op.get("operation") in ("remove_outliers", "fix_types", "fix_data_types")


def _is_fill(op: dict[str, Any]) -> bool:
    return (op.get("operation") == "handle_missing" and op.get("target", "all") != "all"
            and op.get("strategy", "drop") in ops.FILLS)


def _column(df: DataFrame, op: dict[str, Any]) -> str:
    target = op.get("target", "all")
    if target not in df.columns:
        raise ValueError(f"no column {target!r} for {op.get('operation')}")
    return target


def _fill(out: Cleaned, batch: list[dict[str, Any]]) -> None:
    values = ops.fit_fills(out.df, {_column(out.df, op): op["strategy"] for op in batch})
    for op in batch:
        c = op["target"]
        out.df = ops.apply_fills(out.df, {c: values.get(c)})
        shown = None if values.get(c) is None else str(values[c])
        out.steps.append(Step(f"fill_{op['strategy']}_{c}", out.df, False, shown))


def _apply(out: Cleaned, op: dict[str, Any]) -> None:
    name, target = op.get("operation", ""), op.get("target", "all")
    df = out.df
    if name in _CLEANERS:
        out.df = df.transform(_CLEANERS[name])
        out.steps.append(Step(name, out.df, True))
    elif name == "remove_duplicates":
        out.df = ops.remove_duplicates(df, op.get("subset"), op.get("order_by"))
        out.steps.append(Step(name, out.df, True))
    elif name == "handle_missing" and op.get("strategy", "drop") == "drop":
        out.df = ops.drop_missing(df, None if target == "all" else [_column(df, op)])
        out.steps.append(Step("drop_null_rows" if target == "all" else f"drop_nulls_{target}", out.df, True))
    elif name == "remove_outliers":
        if target == "all" or _column(df, op) not in numeric_columns(df):
            out.steps.append(Step(f"remove_outliers_{target}", df, False))
            return
        fences = ops.fit_fences(df, [target])
        low, high = fences.get(target, (None, None))
        out.df = ops.apply_fences(df, fences)
        out.steps.append(Step(f"remove_outliers_{target}", out.df, True, None, low, high))
    elif name in ("fix_types", "fix_data_types"):
        out.df = ops.fix_types(df, None if target == "all" else [_column(df, op)])
        out.steps.append(Step("fix_types", out.df, False))
    elif name == "expr":
        if target == "all":
            out.df = df.filter(F.expr(op["expr"]))
        else:
            out.df = df.withColumn(target, F.expr(op["expr"]))
        out.steps.append(Step(f"expr_{target}", out.df, target == "all"))
    else:
        raise ValueError(f"unknown cleaning operation {op!r}")
