"""Exact order statistics and running values that never put one group into one task.

``quantile_values`` places a bracket around each wanted rank from a sample, then one pass counts what
lies below each bracket and lists the few values inside, which proves the answer. ``running``
cuts (keys, order) into slices, so a key holding a third of the rows is spread over many tasks,
and carries totals across slices.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.columns import quoted, ref, slices

ACCURACY = 10_000
SAMPLE_ROWS = 150_000
LARGE_SAMPLE_ROWS = 10_000_000
# A bracket expected to hold more rows than this is narrowed again before its values are listed.
BRACKET_ROWS = 100_000
PART = "_part"
# Running values: rows of a slice, the most slices of a table, and the rows from which their boundaries are fitted.
SLICE_ROWS = 250_000
MAX_SLICES = 2_000
SAMPLED = 20_000


@dataclass
class Bracket:
    """The values of ``column`` among which rank ``rank`` (zero-based) is known or hoped to be."""

    column: str
    rank: int
    inside: int  # rows between low and high
    below: int = 0
    low: float | None = None  # None: open end
    high: float | None = None
    slack: float = 1.0  # widens the margins after a miss
    spread: tuple[float, float] = (0.0, 1.0)  # share of the rows inside kept by the last narrowing
    narrowed: bool = True

    def expected(self) -> float:
        return self.inside * (min(1.0, self.spread[1]) - max(0.0, self.spread[0]))

    def value(self) -> Column:
        return ref(self.column).cast("double")

    def contains(self) -> Column:
        test = self.value().isNotNull()
        if self.low is not None:
            test = test & (self.value() >= self.low)
        if self.high is not None:
            test = test & (self.value() <= self.high)
        return test


def _narrow(df: DataFrame, brackets: list[Bracket], seed: int) -> None:
    """Tighten each bracket around its rank, judging by a sample of the rows inside."""
    widest = max(b.inside for b in brackets)
    share = min(1.0, max(SAMPLE_ROWS, min(widest // 1000, LARGE_SAMPLE_ROWS)) / widest)
    sampled = df.sample(share, seed=seed) if share < 1 else df
    same: dict[tuple, list[Bracket]] = {}
    for b in brackets:
        same.setdefault((b.column, b.low, b.high), []).append(b)
    for part in slices(list(same.values()), 20):
        exprs = []
        for group in part:
            probs = []
            for b in group:
                drawn = max(b.inside * share, 1.0)
                margin = b.slack * (2.5 * math.sqrt(1 - share) / math.sqrt(drawn) + 2 / ACCURACY + 1 / drawn)
                spot = (b.rank - b.below) / max(b.inside - 1, 1)
                b.spread = (spot - margin, spot + margin)
                probs += [max(0.0, spot - margin), min(1.0, spot + margin)]
            inside = F.when(group[0].contains(), group[0].value())
            exprs.append(F.percentile_approx(inside, probs, ACCURACY))
        for group, ends in zip(part, sampled.agg(*exprs).first()):
            for i, b in enumerate(group):
                if ends:
                    # a sample cannot see the outermost values, so an end it reaches stays open
                    b.low = float(ends[2 * i]) if b.spread[0] > 0 else b.low
                    b.high = float(ends[2 * i + 1]) if b.spread[1] < 1 else b.high


def _merged(brackets: list[Bracket]) -> list[tuple[float, float]]:
    """Disjoint spans covering the brackets; NaN, which Spark sorts last, is an open upper end."""
    spans: list[list[float]] = []
    for b in sorted(brackets, key=lambda b: -math.inf if b.low is None else b.low):
        low = -math.inf if b.low is None else b.low
        high = math.nan if b.high is None else b.high
        if spans and not low > spans[-1][1]:
            spans[-1][1] = math.nan if math.isnan(high) else max(spans[-1][1], high)
        else:
            spans.append([low, high])
    return [(low, high) for low, high in spans]


def _doubles(values: list[float | None]) -> str:
    return "array(" + ", ".join("CAST(NULL AS DOUBLE)" if v is None else f"double('{v!r}')"
                                for v in values) + ")"


def _segments(df: DataFrame, brackets: list[Bracket], cols: list[str], listed: bool) -> DataFrame:
    """``id, seg, v, n``: rows per segment of each column, split by value inside the brackets.

    Segments count up from 0: even in the gap before a span, odd inside one; values above the last
    span are dropped. Bounds sit in literal arrays indexed by column, which keeps the code small.
    """
    spans = [_merged([b for b in brackets if b.column == c]) for c in cols]
    cases = ""
    for i in range(max(len(s) for s in spans)):
        lows = _doubles([s[i][0] if i < len(s) else None for s in spans])
        highs = _doubles([s[i][1] if i < len(s) else None for s in spans])
        cases += f" WHEN v < {lows}[id] THEN {2 * i} WHEN v <= {highs}[id] THEN {2 * i + 1}"
    slots = ", ".join(f"struct({i} AS id, CAST({quoted(c)} AS DOUBLE) AS v)" for i, c in enumerate(cols))
    long = df.select(F.expr(f"inline(array({slots}))")).filter("v IS NOT NULL")
    placed = long.withColumn("seg", F.expr(f"CASE{cases} END")).filter("seg IS NOT NULL")
    value = F.expr("CASE WHEN seg % 2 = 1 THEN v END") if listed else F.lit(None).cast("double")
    return placed.groupBy("id", "seg", value.alias("v")).agg(F.count(F.lit(1)).alias("n"))


def _list_values(df: DataFrame, brackets: list[Bracket]) -> dict[tuple[str, int], float]:
    """Values at the wanted ranks; a rank that falls outside its bracket is left out."""
    cols = sorted({b.column for b in brackets})
    wanted = F.array(*[
        F.array(*[F.lit(r) for r in sorted({b.rank for b in brackets if b.column == c})]) for c in cols
    ])
    order = W.partitionBy("id").orderBy("seg", "v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = _segments(df, brackets, cols, listed=True).withColumn("upto", F.sum("n").over(order))
    hit = F.filter(wanted[F.col("id")], lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))
    rows = ranked.filter(F.col("v").isNotNull()).select("id", "v", F.explode(hit).alias("rank")).collect()
    return {(cols[r["id"]], r["rank"]): r["v"] for r in rows}


def _recount(df: DataFrame, brackets: list[Bracket]) -> None:
    """Exact rows below and inside each bracket; one that misses its rank is opened up again."""
    cols = sorted({b.column for b in brackets})
    rows = _segments(df, brackets, cols, listed=False).collect()  # a few rows per column
    for b in brackets:
        spans = _merged([x for x in brackets if x.column == b.column])
        at = next(i for i, (_, high) in enumerate(spans)
                  if math.isnan(high) or b.high is not None and b.high <= high)
        counts = {r["seg"]: r["n"] for r in rows if cols[r["id"]] == b.column}
        b.low = None if spans[at][0] == -math.inf else spans[at][0]
        b.high = None if math.isnan(spans[at][1]) else spans[at][1]
        below = sum(n for seg, n in counts.items() if seg < 2 * at + 1)
        inside = counts.get(2 * at + 1, 0)
        if below <= b.rank < below + inside:
            b.narrowed = inside < b.inside / 2
            b.below, b.inside = below, inside
        else:
            b.below, b.inside = 0, below + sum(n for seg, n in counts.items() if seg > 2 * at) + inside
            b.low = b.high = None
            b.slack *= 4


def values_at(df: DataFrame, ranks: dict[str, list[int]], rows: dict[str, int]) -> dict[tuple[str, int], float]:
    """Exact values at zero-based ranks of numeric columns (as double, nulls ignored)."""
    brackets = [Bracket(c, r, rows[c]) for c, rs in ranks.items() for r in sorted(set(rs))]
    total = dict(rows)
    found: dict[tuple[str, int], float] = {}
    seed = 1
    pending = brackets
    while pending:
        wide = [b for b in pending if b.inside > BRACKET_ROWS and b.narrowed]
        if wide:
            _narrow(df, wide, seed)
            seed += 1
            if max(b.expected() for b in wide) > 20 * BRACKET_ROWS:
                _recount(df, wide)
                continue
        found.update(_list_values(df, pending))
        missed = [b for b in pending if (b.column, b.rank) not in found]
        for b in missed:
            b.low = b.high = None
            b.below, b.inside, b.narrowed = 0, total[b.column], True
            b.slack *= 4
        pending = missed
    return found


def quantile_values(
    df: DataFrame, targets: dict[str, list[float]], method: str = "linear"
) -> dict[tuple[str, float], float]:
    """Quantiles per (column, q); nulls are ignored and an all-null column gives no entry.

    ``method`` is ``linear`` (interpolated), ``nearest`` (a value of the column) or ``approx``
    (one bounded sketch pass, for very large tables).
    """
    if method not in ("linear", "nearest", "approx"):
        raise ValueError(f"unknown quantile method {method!r}")
    cols = list(targets)
    out: dict[tuple[str, float], float] = {}
    if method == "approx":
        for part in slices(cols, 25):
            row = df.agg(*[F.percentile_approx(ref(c).cast("double"), list(targets[c]), ACCURACY)
                           for c in part]).first()
            out.update({(c, q): v for c, vs in zip(part, row) if vs for q, v in zip(targets[c], vs)})
        return out
    rows: dict[str, int] = {}
    for part in slices(cols):
        if part:
            rows.update(zip(part, df.agg(*[F.count(ref(c)) for c in part]).first()))
    spots = {}
    for c in cols:
        for q in targets[c]:
            if rows[c]:
                spot = (rows[c] - 1) * q
                near = math.floor(spot + 0.5)
                spots[c, q] = (near, near, 0.0) if method == "nearest" else (
                    math.floor(spot), math.ceil(spot), spot - math.floor(spot))
    wanted: dict[str, list[int]] = {}
    for (c, _), (first, last, _) in spots.items():
        wanted.setdefault(c, []).extend([first, last])
    values = values_at(df, wanted, rows) if wanted else {}
    for (c, q), (first, last, weight) in spots.items():
        low, high = values[c, first], values[c, last]
        out[c, q] = low if weight == 0 else low + (high - low) * weight
    return out


def quantiles(df: DataFrame, targets: dict[str, list[float]], method: str = "linear") -> DataFrame:
    """``quantile_values`` as rows ``column, q, value``: one per quantile asked for."""
    found = [(c, float(q), v) for (c, q), v in quantile_values(df, targets, method).items()]
    return df.sparkSession.createDataFrame(found, "column string, q double, value double")


def slice_bounds(df: DataFrame, keys: list[str], order: list[str], slices: int | None = None) -> list:
    """Rows of (keys, order) that cut ``df`` into about equal slices, fitted in one pass over these columns and a count.

    The driver sees at most SAMPLED rows, and keeps MAX_SLICES - 1 of them at most. (The count is no ``observe``: once a
    session observes, models that hold it can't be sent to tasks any more.)
    """
    narrow = df.select(*[ref(c).alias(f"c{i}") for i, c in enumerate(keys + order)])
    names = narrow.columns
    some = narrow.orderBy(F.xxhash64(*names)).limit(SAMPLED).orderBy(*names).collect()
    rows = len(some) if len(some) < SAMPLED or slices else narrow.count()
    n = slices or min(MAX_SLICES, -(-rows // SLICE_ROWS))
    picked = [some[i * len(some) // n] for i in range(1, n)] if some else []
    return [row for i, row in enumerate(picked) if not i or row != picked[i - 1]]


def slice_of(df: DataFrame, columns: list[str], bounds: list) -> Column:
    """How many of the sorted ``bounds`` a row of ``columns`` has reached: a function of its values only."""
    if not bounds:
        return F.lit(0)
    kind = T.StructType([T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(columns)])
    listed = F.array(*[F.struct(*[F.lit(bytes(v) if isinstance(v, bytearray) else v).cast(f.dataType).alias(f.name) for v, f in zip(row, kind.fields)]) for row in bounds])
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]
    here = F.struct(*[ref(c).alias(f"c{i}") for i, c in enumerate(columns)])
    reached = lambda at: F.when(at <= len(bounds), F.get(listed, at - 1) <= here).otherwise(False)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda low, step: F.when(reached(low + step), low + step).otherwise(low))


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, str] | None = None,
    maxes: dict[str, str] | None = None,
    firsts: dict[str, str] | None = None,
    lags: dict[str, str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Running sum / max, first value and previous value per key in ``order`` (ascending).

    Each argument maps an output column to an input column. (keys, order) is cut into slices of about SLICE_ROWS rows (or
    ``partitions`` slices) at boundaries fitted from a sample; a row's slice follows from its values, so nothing is written and whole
    rows are shuffled once, by (keys, slice). Only keys that hold a boundary reach into several slices: their totals, at most two
    rows a slice, are added up first and the carried ones broadcast. ``df`` is read three times (sample, totals, result) and has to
    give the same rows each time. Rows equal in (keys, order) must be few: they share a slice.
    """
    sums, maxes, firsts, lags = sums or {}, maxes or {}, firsts or {}, lags or {}
    bounds = slice_bounds(df, keys, order, partitions)
    spread = df.withColumn(PART, slice_of(df, keys + order, bounds))
    local = W.partitionBy(*[ref(c) for c in keys], PART).orderBy(*[ref(c) for c in order])
    upto = local.rowsBetween(W.unboundedPreceding, W.currentRow)
    windowed = spread.select(
        "*",
        *[F.sum(ref(c)).over(upto).alias(f"_ws_{o}") for o, c in sums.items()],
        *[F.max(ref(c)).over(upto).alias(f"_wm_{o}") for o, c in maxes.items()],
        *[F.first(F.struct(ref(c))).over(upto).alias(f"_wf_{o}") for o, c in firsts.items()],
        *[F.lag(F.struct(ref(c))).over(local).alias(f"_wl_{o}") for o, c in lags.items()],
    )
    if not bounds:
        return windowed.select(
            *[ref(c) for c in df.columns],
            *[ref(f"_ws_{o}").alias(o) for o in sums],
            *[ref(f"_wm_{o}").alias(o) for o in maxes],
            *[ref(f"_wf_{o}")[c].alias(o) for o, c in firsts.items()],
            *[ref(f"_wl_{o}")[c].alias(o) for o, c in lags.items()],
        )
    place = F.struct(*[ref(c) for c in order])
    some = spread
    if keys:
        held = df.sparkSession.createDataFrame(
            list(dict.fromkeys(tuple(row)[: len(keys)] for row in bounds)),
            T.StructType([T.StructField(f"_k{i}", df.schema[c].dataType) for i, c in enumerate(keys)]))
        match = [ref(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
        some = spread.join(F.broadcast(held), functools.reduce(lambda a, b: a & b, match), "left_semi")
    totals = some.groupBy(*[ref(c) for c in keys], PART).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(ref(c)).alias(f"_s_{o}") for o, c in sums.items()],
        *[F.max(ref(c)).alias(f"_m_{o}") for o, c in maxes.items()],
        *[F.min_by(F.struct(ref(c)), place).alias(f"_f_{o}") for o, c in firsts.items()],
        *[F.max_by(F.struct(ref(c)), place).alias(f"_l_{o}") for o, c in lags.items()],
    )
    by_part = W.partitionBy(*([ref(c) for c in keys] or [F.lit(0)])).orderBy(PART)
    before = by_part.rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(
        *[ref(c).alias(f"_k{i}") for i, c in enumerate(keys)],
        F.col(PART).alias("_kp"),
        F.lag("_n").over(by_part).alias("_seen"),
        *[F.sum(ref(f"_s_{o}")).over(before).alias(f"_cs_{o}") for o in sums],
        *[F.max(ref(f"_m_{o}")).over(before).alias(f"_cm_{o}") for o in maxes],
        *[F.first(ref(f"_f_{o}")).over(before).alias(f"_cf_{o}") for o in firsts],
        *[F.lag(ref(f"_l_{o}")).over(by_part).alias(f"_cl_{o}") for o in lags],
    ).filter(F.col("_seen").isNotNull())
    match = F.col(PART) == F.col("_kp")
    for i, c in enumerate(keys):
        match = match & ref(c).eqNullSafe(F.col(f"_k{i}"))
    joined = windowed.join(F.broadcast(carry), match, "left")

    def summed(o: str) -> Column:
        local_sum, carried = ref(f"_ws_{o}"), ref(f"_cs_{o}")
        return F.when(carried.isNull(), local_sum).otherwise(carried + F.coalesce(local_sum, F.lit(0)))

    return joined.select(
        *[ref(c) for c in df.columns],
        *[summed(o).alias(o) for o in sums],
        *[F.greatest(ref(f"_cm_{o}"), ref(f"_wm_{o}")).alias(o) for o in maxes],
        *[F.coalesce(ref(f"_cf_{o}"), ref(f"_wf_{o}"))[firsts[o]].alias(o) for o in firsts],
        *[F.coalesce(ref(f"_wl_{o}"), ref(f"_cl_{o}"))[lags[o]].alias(o) for o in lags],
    )
