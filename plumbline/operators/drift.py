"""Drift between a reference and a current table.

Both tables are turned into (column, bin or category) rows and counted together, so the number of
shuffles does not grow with the number of columns. Totals and bin edges are fitted first and enter
as literals; an absent bin or category is simply a count of zero.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.columns import NESTED, event_time, numeric_columns, pick, quoted, ref, slices, text, union_all
from plumbline.functions.scores import alert_level, chi2_p_value, kolmogorov_p_value
from plumbline.operators.metrics import classification_metrics, regression_metrics
from plumbline.operators.profile import dtype_of
from plumbline.operators.ranks import running
from plumbline.operators.sampling import hash_fraction
from plumbline.session import materialize, written

# Bins, the floor under a proportion, the cap on a score and the detection threshold.
BINS = 10
FLOOR = 0.0001
CAP = 1.0
DETECTED = 0.2
HIGH_OVERALL = 0.3


def common_columns(reference: DataFrame, current: DataFrame) -> list[str]:
    """Columns both tables have, sorted by name."""
    return sorted(set(reference.columns) & set(current.columns))


def bin_edges(low: float, high: float, bins: int = BINS) -> list[float]:
    """Equal-width edges; a constant column is widened by half a unit each way."""
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    return [low + i * width for i in range(bins)] + [high]


@dataclass
class Layout:
    """How rows become (column id, bin or category): fitted on the reference."""

    columns: list[str]
    numeric: list[str]
    edges: dict[str, list[float]] = field(default_factory=dict)
    bins: int = BINS

    def is_numeric(self, c: str) -> bool:
        return c in self.numeric

    def keyed(self, df: DataFrame, extra: list[str] | None = None) -> DataFrame:
        """``extra..., id, bin, category``: one row per non-null cell.

        ``bin`` is -1 below the first edge and ``bins`` above the last; it is null for categories.
        """
        slots = []
        for i, c in enumerate(self.columns):
            if self.is_numeric(c):
                v, s = _finite_sql(c), "CAST(NULL AS STRING)"
            else:
                nested = isinstance(df.schema[c].dataType, NESTED)
                v = "CAST(NULL AS DOUBLE)"
                s = f"to_json({quoted(c)})" if nested else f"CAST({quoted(c)} AS STRING)"
            slots.append(f"struct({i} AS id, {v} AS v, {s} AS category)")
        cells = df.select(*[ref(c) for c in extra or []], F.expr(f"inline(array({', '.join(slots)}))"))
        cells = cells.filter("v IS NOT NULL OR category IS NOT NULL")
        bounds = [self.edges.get(c) for c in self.columns]

        def edge(k: int) -> str:
            values = ", ".join("CAST(NULL AS DOUBLE)" if e is None else f"double('{e[k]!r}')" for e in bounds)
            return f"array({values})[id]"

        cases = f"WHEN v < {edge(0)} THEN -1 " if any(bounds) else ""
        if cases:
            cases += " ".join(f"WHEN v < {edge(k)} THEN {k - 1}" for k in range(1, self.bins))
            cases += f" WHEN v <= {edge(self.bins)} THEN {self.bins - 1} WHEN v IS NOT NULL THEN {self.bins}"
        bin_number = F.expr(f"CASE {cases} END") if cases else F.lit(None).cast("int")
        return cells.select(*[ref(c) for c in extra or []], "id", bin_number.alias("bin"), "category")

    def lookup(self, values: dict[str, float]) -> Column:
        """A number per column id, as a literal array."""
        return F.array(*[F.lit(float(values.get(c, 0))) for c in self.columns])[F.col("id")]

    def names(self, what: dict[str, str] | None = None) -> Column:
        return F.array(*[F.lit(what[c] if what else c) for c in self.columns])[F.col("id")]


def _finite_sql(c: str) -> str:
    v = f"CAST({quoted(c)} AS DOUBLE)"
    return f"CASE WHEN abs({v}) < double('Infinity') THEN {v} END"


@dataclass
class SideStats:
    """Per column: non-null cells, cells that take part, and (numeric) lowest and highest value."""

    rows: dict[str, int]
    used: dict[str, int]
    low: dict[str, float]
    high: dict[str, float]


def side_stats(df: DataFrame, columns: list[str], numeric: list[str]) -> SideStats:
    out = SideStats({}, {}, {}, {})
    for part in slices(columns, 25):
        exprs = []
        for c in part:
            exprs.append(F.expr(f"count({quoted(c)})"))
            if c in numeric:
                v = _finite_sql(c)
                exprs += [F.expr(f"count({v})"), F.expr(f"min({v})"), F.expr(f"max({v})")]
        if not exprs:
            continue
        cells = iter(df.agg(*exprs).first())
        for c in part:
            out.rows[c] = next(cells)
            out.used[c] = out.rows[c]
            if c in numeric:
                out.used[c] = next(cells)
                out.low[c], out.high[c] = next(cells), next(cells)
    return out


@dataclass
class Pair:
    """Counts of both sides over one layout, ready to score."""

    layout: Layout
    before: SideStats
    after: SideStats
    counts: DataFrame  # id, bin, category, ref_n, cur_n

    @property
    def ref_share(self) -> Column:
        return F.col("ref_n") / self.layout.lookup(self.before.used)

    @property
    def cur_share(self) -> Column:
        return F.col("cur_n") / self.layout.lookup(self.after.used)

    def per_column(self, measure: Column, names: dict[str, Column] | None = None) -> DataFrame:
        """``column, score`` with 0.0 where nothing was left to compare."""
        sums = self.counts.groupBy("id").agg(measure.alias("score"), *(
            [c.alias(n) for n, c in (names or {}).items()]))
        ids = self.counts.sparkSession.createDataFrame(
            [(i, c) for i, c in enumerate(self.layout.columns)], "id int, column string")
        return ids.join(sums, "id", "left").drop("id").fillna({"score": 0.0})


def pair(
    reference: DataFrame,
    current: DataFrame,
    cols: list[str] | None = None,
    bins: int = BINS,
    kinds: str = "both",
    numeric: str = "core",
) -> Pair:
    """Fit the reference, then count both sides in one shuffle. All-null columns are left out."""
    columns = pick(reference, cols, common_columns(reference, current))
    numbers = [c for c in columns if c in numeric_columns(reference, numeric)]
    if kinds == "numeric":
        columns = numbers
    elif kinds == "categorical":
        columns, numbers = [c for c in columns if c not in numbers], []
    before, after = side_stats(reference, columns, numbers), side_stats(current, columns, numbers)
    columns = [c for c in columns if before.rows[c] and after.rows[c]]
    numbers = [c for c in numbers if c in columns]
    edges = {c: bin_edges(before.low[c], before.high[c], bins) for c in numbers if before.used[c]}
    layout = Layout(columns, numbers, edges, bins)
    if not columns:
        empty = reference.sparkSession.createDataFrame(
            [], "id int, bin int, category string, ref_n long, cur_n long")
        return Pair(layout, before, after, empty)
    cells = (
        layout.keyed(reference).withColumn("r", F.lit(1))
        .unionByName(layout.keyed(current).withColumn("r", F.lit(0)))
    )
    counts = cells.groupBy("id", "bin", "category").agg(
        F.sum("r").alias("ref_n"), F.sum(1 - F.col("r")).alias("cur_n")
    )
    return Pair(layout, before, after, counts)


def _floored(share: Column) -> Column:
    return F.greatest(share, F.lit(FLOOR))


def psi_term(p: Column, q: Column, numeric: Column, formula: str) -> Column:
    """One bin's part of the score; ``reference`` leaves the logarithm out for categories."""
    with_log = (q - p) * F.ln(q / p)
    if formula == "standard":
        return with_log
    if formula == "reference":
        return F.when(numeric, with_log).otherwise((q - p) * (q / p))
    raise ValueError(f"unknown formula {formula!r}")


def _in_range(layout: Layout) -> Column:
    """Numeric cells outside the reference range count in the total only."""
    return F.col("bin").isNull() | F.col("bin").between(0, layout.bins - 1)


def _psi(both: Pair, formula: str) -> Column:
    p, q = _floored(both.ref_share), _floored(both.cur_share)
    term = psi_term(p, q, F.col("bin").isNotNull(), formula)
    return F.least(F.abs(F.sum(F.when(_in_range(both.layout), term).otherwise(0.0))), F.lit(CAP))


def psi_numeric(
    reference: DataFrame, current: DataFrame, cols: list[str] | None = None, bins: int = BINS
) -> DataFrame:
    """``column, score``: population stability over bins fitted on the reference."""
    both = pair(reference, current, cols, bins, kinds="numeric")
    return both.per_column(_psi(both, "standard"))


def psi_categorical(
    reference: DataFrame, current: DataFrame, cols: list[str] | None = None, formula: str = "standard"
) -> DataFrame:
    """``column, score`` over the union of categories of both sides."""
    both = pair(reference, current, cols, kinds="categorical")
    return both.per_column(_psi(both, formula))


def drift(
    reference: DataFrame,
    current: DataFrame | None = None,
    cols: list[str] | None = None,
    formula: str = "standard",
    bins: int = BINS,
    sample: float = 0.3,
    seed: int = 42,
    sample_key: list[str] | None = None,
) -> DataFrame:
    """``column, dtype, kind, score, level, nan_count`` for every column both tables have.

    Without a current table the reference is compared with a sample of itself.
    """
    if current is None:
        current = hash_fraction(reference, sample, sample_key, seed) if sample_key else (
            reference.sample(sample, seed=seed))
    both = pair(reference, current, cols, bins)
    facts = [
        (c, dtype_of(reference, c), "numeric" if both.layout.is_numeric(c) else "categorical",
         sum(s.rows[c] - s.used[c] for s in (both.before, both.after)))
        for c in both.layout.columns
    ]
    named = reference.sparkSession.createDataFrame(
        facts, "column string, dtype string, kind string, nan_count long")
    scores = both.per_column(_psi(both, formula))
    return named.join(scores, "column").select(
        "column", "dtype", "kind", "score", alert_level(F.col("score")).alias("level"), "nan_count"
    )


def drift_summary(scores: DataFrame, threshold: float = DETECTED) -> DataFrame:
    """One row: overall score, detected flag, features monitored and features with drift."""
    return scores.agg(
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("overall_score"),
        F.coalesce(F.avg("score") > threshold, F.lit(False)).alias("drift_detected"),
        F.count(F.lit(1)).alias("features_monitored"),
        F.count_if(F.col("level") != "NONE").alias("features_with_drift"),
    )


def drift_alerts(scores: DataFrame, threshold: float = DETECTED) -> DataFrame:
    """``level, type, feature, score``: one overall alert when drift is detected, one per bad feature."""
    overall = drift_summary(scores, threshold).filter("drift_detected").select(
        F.when(F.col("overall_score") > HIGH_OVERALL, "HIGH").otherwise("MEDIUM").alias("level"),
        F.lit("overall_drift").alias("type"), F.lit(None).cast("string").alias("feature"),
        F.col("overall_score").alias("score"),
    )
    features = scores.filter(F.col("level").isin("MEDIUM", "HIGH")).select(
        "level", F.lit("feature_drift").alias("type"), F.col("column").alias("feature"), "score"
    )
    return overall.unionByName(features)


def top_drift(scores: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` features that drift most."""
    return scores.orderBy(F.desc("score"), "column").limit(k)


def histogram(
    df: DataFrame, cols: list[str] | None = None, bins: int = BINS,
    edges: dict[str, list[float]] | None = None,
) -> DataFrame:
    """``column, bin, low, high, count`` for every bin, empty ones included.

    Edges come from the column's own range unless given; values outside them are not counted.
    """
    columns = pick(df, cols, numeric_columns(df))
    if edges is None:
        stats = side_stats(df, columns, columns)
        columns = [c for c in columns if stats.used[c]]
        edges = {c: bin_edges(stats.low[c], stats.high[c], bins) for c in columns}
    spark = df.sparkSession
    grid = spark.createDataFrame(
        [(i, b, c, edges[c][b], edges[c][b + 1]) for i, c in enumerate(columns) for b in range(bins)],
        "id int, bin int, column string, low double, high double",
    )
    layout = Layout(columns, columns, edges, bins)
    counts = layout.keyed(df).groupBy("id", "bin").agg(F.count(F.lit(1)).alias("count"))
    return grid.join(counts, ["id", "bin"], "left").select(
        "column", "bin", "low", "high", F.coalesce("count", F.lit(0)).alias("count")
    )


def js_divergence(
    reference: DataFrame, current: DataFrame, cols: list[str] | None = None, bins: int = BINS
) -> DataFrame:
    """``column, score``: Jensen-Shannon divergence in bits (0 equal, 1 disjoint).

    Current values outside the reference range fall into one bin below and one above it.
    """
    both = pair(reference, current, cols, bins)
    p, q = both.ref_share, both.cur_share
    middle = (p + q) / 2

    def part(share: Column) -> Column:
        return F.when(share > 0, share * F.log2(share / middle)).otherwise(0.0)

    return both.per_column(F.sum(part(p) + part(q)) / 2)


def chi2_two_sample(reference: DataFrame, current: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``column, statistic, dof, p_value``: are both sides drawn from the same categories?"""
    both = pair(reference, current, cols, kinds="categorical")
    n, m = both.layout.lookup(both.before.used), both.layout.lookup(both.after.used)
    seen = F.col("ref_n") + F.col("cur_n")
    e_ref, e_cur = seen * n / (n + m), seen * m / (n + m)
    gap = F.pow(F.col("ref_n") - e_ref, 2) / e_ref + F.pow(F.col("cur_n") - e_cur, 2) / e_cur
    out = both.per_column(F.sum(gap), {"dof": F.count(F.lit(1)) - 1})
    return out.select("column", F.col("score").alias("statistic"), "dof",
                      chi2_p_value(F.col("score"), F.col("dof")).alias("p_value"))


def ks_two_sample(reference: DataFrame, current: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``column, statistic, p_value``: largest gap between the two distribution functions.

    Values collapse to counts per distinct value; the running sums are spread by range, so a long
    column does not end up in one task.
    """
    columns = pick(reference, cols, [c for c in common_columns(reference, current)
                                     if c in numeric_columns(reference)])
    before, after = side_stats(reference, columns, columns), side_stats(current, columns, columns)
    columns = [c for c in columns if before.used[c] and after.used[c]]
    layout = Layout(columns, columns)

    def cells(df: DataFrame, side: int) -> DataFrame:
        slots = ", ".join(f"struct({i} AS id, {_finite_sql(c)} AS v)" for i, c in enumerate(columns))
        return df.select(F.expr(f"inline(array({slots}))"), F.lit(side).alias("r")).filter("v IS NOT NULL")

    counts = cells(reference, 1).unionByName(cells(current, 0)).groupBy("id", "v").agg(
        F.sum("r").alias("ref_n"), F.sum(1 - F.col("r")).alias("cur_n")
    )
    # one row for each distinct value, read three times below
    steps = running(written(counts), ["id"], ["v"], sums={"ref_upto": "ref_n", "cur_upto": "cur_n"})
    n, m = layout.lookup(before.used), layout.lookup(after.used)
    gap = F.abs(F.col("ref_upto") / n - F.col("cur_upto") / m)
    worst = steps.groupBy("id").agg(F.max(gap).alias("statistic"))
    return worst.select(layout.names().alias("column"), "statistic",
                        kolmogorov_p_value(F.col("statistic"), n, m).alias("p_value"))


@dataclass
class Reference:
    """A fitted reference for comparing many windows with: layout, shares and the score of an empty side."""

    layout: Layout
    shares: DataFrame  # id, bin, category, p


def fit_reference(
    reference: DataFrame, cols: list[str], bins: int = BINS, keep: bool = False
) -> Reference:
    """Bin edges and category shares; ``keep`` writes the shares once, for use in a stream."""
    numbers = [c for c in cols if c in numeric_columns(reference)]
    stats = side_stats(reference, cols, numbers)
    used = [c for c in cols if stats.used[c]]
    layout = Layout(used, [c for c in numbers if c in used],
                    {c: bin_edges(stats.low[c], stats.high[c], bins) for c in numbers if c in used}, bins)
    counts = layout.keyed(reference).groupBy("id", "bin", "category").agg(F.count(F.lit(1)).alias("n"))
    shares = counts.select("id", "bin", "category", (F.col("n") / layout.lookup(stats.used)).alias("p"))
    return Reference(layout, materialize(shares) if keep else shares)


def score_windows(counts: DataFrame, fitted: Reference, formula: str = "standard") -> DataFrame:
    """PSI per (window, column) from counts ``window, id, bin, category, n`` of whole windows.

    Reference bins a window never saw still count: each window starts from the score of an empty
    side, and every bin it did see swaps its empty term for the real one.
    """
    floor = F.lit(FLOOR)
    by_cell = ["id", "bin", "category"]
    numeric = F.col("bin").isNotNull()
    empty_term = psi_term(_floored(F.col("p")), floor, numeric, formula)
    nothing = fitted.shares.groupBy("id").agg(F.sum(empty_term).alias("empty_score"))
    totals = counts.groupBy("window", "id").agg(F.sum("n").alias("total"))
    shares = fitted.shares.select(*[F.col(c).alias(f"r_{c}") for c in by_cell], "p")
    match = F.lit(True)
    for c in by_cell:
        match = match & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    cells = counts.join(totals, ["window", "id"]).join(shares, match, "left")
    p, q = _floored(F.coalesce("p", F.lit(0.0))), _floored(F.col("n") / F.col("total"))
    seen = psi_term(p, q, numeric, formula)
    swapped = seen - F.when(F.col("p").isNotNull(), empty_term).otherwise(0.0)
    delta = F.when(_in_range(fitted.layout), swapped).otherwise(0.0)
    summed = cells.groupBy("window", "id").agg(F.sum(delta).alias("delta"), F.first("total").alias("rows"))
    score = F.least(F.abs(F.col("empty_score") + F.col("delta")), F.lit(CAP))
    return summed.join(nothing, "id").select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        fitted.layout.names().alias("column"), "rows", score.alias("score"),
        alert_level(score).alias("level"),
    )


def window_counts(
    df: DataFrame, layout: Layout, ts: str, window: str, slide: str | None = None
) -> DataFrame:
    """``window, id, bin, category, n`` of a table or stream."""
    stamped = df.withColumn("window", F.window(event_time(df, ts), window, slide))
    return layout.keyed(stamped, ["window"]).groupBy("window", "id", "bin", "category").agg(
        F.count(F.lit(1)).alias("n")
    )


def drift_by_window(
    df: DataFrame, reference: DataFrame, ts: str, window: str = "6 hours", slide: str | None = None,
    cols: list[str] | None = None, formula: str = "standard",
) -> DataFrame:
    """Drift of each tumbling (or sliding) window of ``df`` against a fixed reference."""
    columns = pick(reference, cols, [c for c in common_columns(reference, df) if c != ts])
    fitted = fit_reference(reference, columns)
    return score_windows(window_counts(df, fitted.layout, ts, window, slide), fitted, formula)


def performance_drift(
    reference: DataFrame, current: DataFrame, label: str, prediction: str, task: str = "classification"
) -> DataFrame:
    """``metric, reference, current, delta`` of the same model on both tables."""
    metrics = classification_metrics if task == "classification" else regression_metrics
    sides = []
    for frame, side in ((reference, "reference"), (current, "current")):
        one = metrics(frame, label, prediction)
        slots = ", ".join(f"struct({text(c)} AS metric, CAST({quoted(c)} AS DOUBLE) AS value)" for c in one.columns)
        sides.append(one.select(F.expr(f"inline(array({slots}))"), F.lit(side).alias("side")))
    return union_all(sides).groupBy("metric").agg(
        F.max(F.when(F.col("side") == "reference", F.col("value"))).alias("reference"),
        F.max(F.when(F.col("side") == "current", F.col("value"))).alias("current"),
    ).withColumn("delta", F.col("current") - F.col("reference"))
