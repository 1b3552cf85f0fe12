"""Moments of all column pairs from one scan, by states that add up.

A state holds, for every pair (a, b) over the rows where neither is null: the rows n, the means of a and of b, their
summed squares about the mean and their summed product about the means. Tasks build states from Arrow batches as matrix
products, and states merge pairwise without loss of digits, so one shuffle of a few numbers a pair and task is enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.columns import ref, union_all

# Columns of one side of a state: five square matrices of this width are what a task holds.
BLOCK = 500
# Rows that enter one matrix product, and the most tasks that merge states before the last merge.
CHUNK = 20_000
FAN = 256

STATE = "task long, a int, n array<double>, mean_a array<double>, mean_b array<double>, sq_a array<double>, sq_b array<double>, prod array<double>, odd array<double>"
FIELDS = ("n", "mean_a", "mean_b", "sq_a", "sq_b", "prod", "odd")


@dataclass
class Moments:
    """The matrices of a state, or one row of them; ``odd`` counts rows in which a or b is NaN or infinite."""

    n: np.ndarray
    mean_a: np.ndarray
    mean_b: np.ndarray
    sq_a: np.ndarray
    sq_b: np.ndarray
    prod: np.ndarray
    odd: np.ndarray

    @staticmethod
    def of(x: np.ndarray, known_x: np.ndarray, y: np.ndarray, known_y: np.ndarray) -> Moments:
        """The state of some rows; what is not known holds 0 in ``x`` and ``y``.

        Values are taken about their column's mean in these rows first, so large offsets cost no digits.
        """
        fine_x, fine_y = known_x & np.isfinite(x), known_y & np.isfinite(y)
        if fine_x.all() and fine_y.all():  # every pair has the same rows
            shift_x, shift_y = x.mean(0), y.mean(0)
            x, y = x - shift_x, y - shift_y
            like = np.ones((x.shape[1], y.shape[1]))
            return Moments(like * len(x), like * shift_x[:, None], like * shift_y, like * (x * x).sum(0)[:, None], like * (y * y).sum(0), x.T @ y, like * 0)
        mx, my = fine_x.astype(float), fine_y.astype(float)
        x, y = np.where(fine_x, x, 0.0), np.where(fine_y, y, 0.0)
        shift_x = x.sum(0) / np.maximum(mx.sum(0), 1)
        shift_y = y.sum(0) / np.maximum(my.sum(0), 1)
        x, y = (x - shift_x) * mx, (y - shift_y) * my
        n = mx.T @ my
        rows = np.maximum(n, 1)
        mean_a, mean_b = x.T @ my / rows, mx.T @ y / rows
        both = known_x.astype(float).T @ known_y.astype(float)
        return Moments(
            n, mean_a + shift_x[:, None] * (n > 0), mean_b + shift_y * (n > 0),
            np.maximum((x * x).T @ my - n * mean_a**2, 0.0), np.maximum(mx.T @ (y * y) - n * mean_b**2, 0.0),
            x.T @ y - n * mean_a * mean_b, both - n,
        )

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        rows = np.maximum(n, 1)
        gap_a, gap_b = other.mean_a - self.mean_a, other.mean_b - self.mean_b
        share, cross = other.n / rows, self.n * other.n / rows
        return Moments(
            n, self.mean_a + gap_a * share, self.mean_b + gap_b * share, self.sq_a + other.sq_a + gap_a**2 * cross,
            self.sq_b + other.sq_b + gap_b**2 * cross, self.prod + other.prod + gap_a * gap_b * cross, self.odd + other.odd,
        )


def _columns(batch: pa.RecordBatch, at: range) -> tuple[np.ndarray, np.ndarray]:
    cells = [batch.column(i) for i in at]
    known = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in cells])
    values = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in cells])
    return values, known


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = [("task", pa.int64()), ("a", pa.int32()), *[(f, pa.list_(pa.float64())) for f in FIELDS]]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))


def _rows(task: int, state: dict[int, Moments]) -> Iterator[pa.RecordBatch]:
    """One row for each column a, so that wide states never make a large cell."""
    for a, row in state.items():
        yield _batch([{"task": task, "a": a, **{f: getattr(row, f) for f in FIELDS}}])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the rows of equal a as they come: one state is held, however many arrive."""
    state: dict[int, Moments] = {}
    for batch in batches:
        for r in batch.to_pylist():
            row = Moments(*[np.array(r[f]) for f in FIELDS])
            state[r["a"]] = state[r["a"]] + row if r["a"] in state else row
    yield from _rows(0, state)


def _states(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """Rows of STATE, one for each column of ``left`` in the end, by one scan of the columns."""
    same = left == right
    cells = [ref(c).cast("double").alias(f"x{i}") for i, c in enumerate(left)]
    cells += [] if same else [ref(c).cast("double").alias(f"y{i}") for i, c in enumerate(right)]

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                x, known_x = _columns(part, range(len(left)))
                y, known_y = (x, known_x) if same else _columns(part, range(len(left), len(left) + len(right)))
                one = Moments.of(x, known_x, y, known_y)
                total = one if total is None else total + one
        if total is not None:
            by_row = {a: Moments(*[getattr(total, f)[a] for f in FIELDS]) for a in range(len(left))}
            yield from _rows(TaskContext.get().partitionId(), by_row)

    return df.select(*cells).mapInArrow(gathered, STATE)


def _merge(states: DataFrame) -> DataFrame:
    """The states of all tasks as one, through at most FAN merging tasks."""
    some = states.repartition(F.col("task") % FAN).mapInArrow(_merged, STATE)
    return some.repartition("a").mapInArrow(_merged, STATE)


def pair_correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """``column_a, column_b, r`` of every pair of ``cols`` in their order, one scan for every pair of column blocks.

    Rows with a null in either column do not count for a pair. ``r`` is null without two rows, for a column without
    spread, and for a pair that meets NaN or infinities; a table without rows has no pairs.
    """
    blocks = [cols[i : i + BLOCK] for i in range(0, len(cols), BLOCK)]
    parts = []
    for i, left in enumerate(blocks):
        for right in blocks[i:]:

            def solved(batches: Iterator[pa.RecordBatch], left=left, right=right) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for r in batch.to_pylist():
                        a = r["a"]
                        m = Moments(*[np.array(r[f]) for f in FIELDS])
                        spread = np.sqrt(m.sq_a) * np.sqrt(m.sq_b)
                        # a constant column may keep a trace of rounding: far below any true spread of its digits
                        noise_a = m.n * (1e-15 * np.abs(m.mean_a)) ** 2
                        noise_b = m.n * (1e-15 * np.abs(m.mean_b)) ** 2
                        good = (m.n > 1) & (m.odd == 0) & (m.sq_a > noise_a) & (m.sq_b > noise_b) & (spread > 0)
                        value = np.clip(m.prod / np.where(good, spread, 1.0), -1.0, 1.0)
                        first = a + 1 if left == right else 0
                        yield pa.RecordBatch.from_pydict({
                            "column_a": pa.array([left[a]] * (len(right) - first), pa.string()),
                            "column_b": pa.array(right[first:], pa.string()),
                            "r": pa.array([float(v) if g else None for v, g in zip(value[first:], good[first:])], pa.float64()),
                        })

            merged = _merge(_states(df, left, right))
            parts.append(merged.mapInArrow(solved, "column_a string, column_b string, r double"))
    return union_all(parts)
