"""Feature transforms fitted on one table and applied to others.

Fitting is a few aggregates; numbers become literals and category tables stay DataFrames that are
joined by key, so a column with very many categories never has to fit on the driver.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.columns import NESTED, finite, numeric_columns, pick, quoted, ref, slices, string_columns
from plumbline.functions.scores import chi2_p_value
from plumbline.operators.ranks import quantile_values, running
from plumbline.operators.sampling import hash_number
from plumbline.session import materialize

# Names taken as the target, in order, and the text for a missing category.
TARGET_NAMES = ["target", "label", "y", "class", "outcome", "result"]
MISSING = "missing"

# A category table within both bounds is sent to every task instead of shuffling the rows.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 * 1024 * 1024

IMPUTATIONS = ("mean", "median", "none")
SCALINGS = ("standard", "minmax", "robust", "none")
ENCODINGS = ("onehot", "onehot_sparse", "label", "target", "none")


@dataclass
class FeaturePlan:
    """What to do with which columns. ``interactions`` holds (column, column, name) products."""

    target: str | None = None
    numeric: list[str] = field(default_factory=list)
    imputation: str = "mean"
    scaling: str = "standard"
    categorical: list[str] = field(default_factory=list)
    encoding: str = "onehot"
    handle_unknown: str = "ignore"
    drop_columns: list[str] = field(default_factory=list)
    interactions: list[tuple[str, str, str]] = field(default_factory=list)
    max_categories: int = 1000
    smoothing: float = 10.0

    def __post_init__(self) -> None:
        for value, known in ((self.imputation, IMPUTATIONS), (self.scaling, SCALINGS),
                             (self.encoding, ENCODINGS), (self.handle_unknown, ("ignore", "error"))):
            if value not in known:
                raise ValueError(f"{value!r} is not one of {known}")


def infer_target(df: DataFrame) -> str:
    """The column with a usual target name (exact, then ignoring case), else the last one."""
    lowered = {c.lower(): c for c in reversed(df.columns)}
    for name in TARGET_NAMES:
        if name in df.columns:
            return name
        if name in lowered:
            return lowered[name]
    return df.columns[-1]


def split_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Feature columns and target column."""
    return df.drop(target), df.select(ref(target))


def default_feature_plan(df: DataFrame, target: str | None = None) -> FeaturePlan:
    """Last column as target, all double and bigint columns, all text columns."""
    numbers = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.LongType))]
    return FeaturePlan(target or df.columns[-1], numbers, categorical=string_columns(df))


@dataclass
class FeatureModel:
    """Fitted numbers and category tables; ``transform`` works on tables and streams."""

    plan: FeaturePlan
    fills: dict[str, float]
    centers: dict[str, float]
    widths: dict[str, float]
    categories: dict[str, list[str]]
    lookups: dict[str, DataFrame]  # column -> (value, code)
    defaults: dict[str, float]
    sizes: dict[str, int]  # categories per lookup
    text_bytes: dict[str, int]  # and the bytes of their text
    dropped: list[str]

    def _numeric(self, c: str) -> Column:
        value = ref(c).cast("double")
        return F.coalesce(value, F.lit(self.fills[c])) if c in self.fills else value

    def _scaled(self, c: str) -> Column:
        return (self._numeric(c) - F.lit(self.centers[c])) / F.lit(self.widths[c])

    def _category(self, c: str) -> Column:
        return F.coalesce(ref(c).cast("string"), F.lit(MISSING))

    def _checked(self, c: str, known: Column, value: Column) -> Column:
        if self.plan.handle_unknown == "ignore":
            return value
        problem = F.concat(F.lit(f"unknown category in {c}: "), self._category(c))
        return F.when(known, value).otherwise(F.raise_error(problem))

    @property
    def numeric(self) -> list[str]:
        return [c for c in self.plan.numeric if c in self.centers]

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Feature columns, then the columns in ``keep``, then the target when the table has it."""
        plan = self.plan
        for c, table in self.lookups.items():
            named = table.select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_c_{c}"))
            if self.sizes[c] <= BROADCAST_ROWS and self.text_bytes[c] <= BROADCAST_BYTES:
                named = F.broadcast(named)
            df = df.join(named, self._category(c) == ref(f"_v_{c}"), "left")
        out = [self._scaled(c).alias(f"numeric__{c}") for c in self.numeric]
        for c in plan.categorical:
            if c in self.categories:
                values = self.categories[c]
                known = self._category(c).isin(values)
                out += [self._checked(c, known, (self._category(c) == v).cast("double")).alias(f"categorical__{c}_{v}")
                        for v in values]
            elif c in self.lookups:
                code = F.coalesce(ref(f"_c_{c}"), F.lit(self.defaults[c]))
                out.append(self._checked(c, ref(f"_v_{c}").isNotNull(), code).alias(f"categorical__{c}"))
            elif plan.encoding == "none":
                out.append(self._category(c).alias(f"categorical__{c}"))
        out += [(self._numeric(a) * self._numeric(b)).alias(f"interaction__{name}") for a, b, name in plan.interactions]
        tail = list(keep or [])
        if plan.target and plan.target in df.columns and plan.target not in tail:
            tail.append(plan.target)
        made = df.select(*out, *[ref(c) for c in tail])
        if plan.encoding == "onehot_sparse" and self.lookups:
            cols = [f"categorical__{c}" for c in self.lookups]
            for c, name in zip(self.lookups, cols):
                made = _sparse_onehot(made, name, self.sizes[c])
        return made

    def feature_names(self, table: DataFrame) -> list[str]:
        return [c for c in table.columns if c.startswith(("numeric__", "categorical__", "interaction__"))]

    def report(self, spark: SparkSession) -> DataFrame:
        """``column, role, action`` for every planned column, including the ones left out."""
        rows = [(c, "numeric", f"{self.plan.imputation}, {self.plan.scaling}") for c in self.numeric]
        rows += [(c, "numeric", "dropped: all null") for c in self.dropped]
        rows += [(c, "categorical", self.plan.encoding) for c in self.plan.categorical]
        return spark.createDataFrame(rows, "column string, role string, action string")

    def save(self, path: str, spark: SparkSession) -> None:
        """Fitted numbers as one JSON row and one Parquet table per category lookup."""
        numbers = {k: getattr(self, k) for k in
                   ("fills", "centers", "widths", "categories", "defaults", "sizes", "text_bytes", "dropped")}
        body = json.dumps({"plan": asdict(self.plan), "lookups": list(self.lookups), **numbers})
        spark.createDataFrame([(body,)], "body string").write.mode("overwrite").parquet(f"{path}/model")
        for i, table in enumerate(self.lookups.values()):
            table.write.mode("overwrite").parquet(f"{path}/lookup_{i}")

    @staticmethod
    def load(path: str, spark: SparkSession) -> FeatureModel:
        body = json.loads(spark.read.parquet(f"{path}/model").first()["body"])
        plan = body.pop("plan")
        plan["interactions"] = [tuple(i) for i in plan["interactions"]]
        lookups = {c: spark.read.parquet(f"{path}/lookup_{i}") for i, c in enumerate(body.pop("lookups"))}
        return FeatureModel(FeaturePlan(**plan), lookups=lookups, **body)


def _sparse_onehot(df: DataFrame, name: str, size: int) -> DataFrame:
    """Replace a category number by a sparse 0/1 vector; unknown (-1) becomes all zeros."""
    width = df.sparkSession.createDataFrame([(float(size),)], "code double")
    encoder = OneHotEncoder(inputCol="code", outputCol="vector", dropLast=True)
    fitted = encoder.fit(width)  # slots 0..size-1; number ``size`` is the dropped, all-zero slot
    coded = df.withColumn("code", F.when(ref(name) < 0, float(size)).otherwise(ref(name)))
    return fitted.transform(coded).drop(name, "code").withColumnRenamed("vector", name)


def fit_features(df: DataFrame, plan: FeaturePlan | None = None) -> FeatureModel:
    """Fit imputation, scaling and encoding on ``df``."""
    plan = plan or default_feature_plan(df)
    numbers = [c for c in pick(df, plan.numeric, []) if c != plan.target and c not in plan.drop_columns]
    groups = [c for c in pick(df, plan.categorical, []) if c != plan.target and c not in plan.drop_columns]
    plan = FeaturePlan(**{**asdict(plan), "numeric": numbers, "categorical": groups,
                          "interactions": [tuple(i) for i in plan.interactions]})
    model = FeatureModel(plan, {}, {}, {}, {}, {}, {}, {}, {}, [])
    extra = [c for pair in plan.interactions for c in pair[:2] if c not in numbers]
    _fit_numeric(df, model, list(dict.fromkeys(numbers + extra)))
    if plan.encoding == "onehot":
        _fit_onehot(df, model)
    elif plan.encoding in ("label", "onehot_sparse"):
        _keep_lookups(model, label_codes(df, groups), -1.0)
    elif plan.encoding == "target":
        _fit_target(df, model)
    return model


def _fit_numeric(df: DataFrame, model: FeatureModel, cols: list[str]) -> None:
    """One aggregate; scaling statistics of the imputed column follow from it in closed form."""
    plan = model.plan
    stats: dict[str, tuple] = {}
    for part in slices(cols, 10):
        exprs = []
        for c in part:
            v = f"CAST({quoted(c)} AS DOUBLE)"
            exprs += [F.expr(f"{fn}({v})") for fn in ("count", "avg", "var_pop", "min", "max")]
        if exprs:
            cells = [F.expr("count(*)"), *exprs]
            row = df.agg(*cells).first()
            for i, c in enumerate(part):
                stats[c] = (row[0], *row[1 + 5 * i : 6 + 5 * i])
    usable = [c for c in cols if stats[c][1]]
    model.dropped = [c for c in cols if not stats[c][1]]
    if plan.imputation == "median":
        medians = quantile_values(df, {c: [0.5] for c in usable}) if usable else {}
        model.fills = {c: medians[c, 0.5] for c in usable}
    elif plan.imputation == "mean":
        model.fills = {c: stats[c][2] for c in usable}
    for c in usable:
        rows, known, mean, var, low, high = stats[c]
        if c in model.fills:
            fill, gaps = model.fills[c], rows - known
            center = (known * mean + gaps * fill) / rows
            var = (known * (var + (mean - center) ** 2) + gaps * (fill - center) ** 2) / rows
            mean = center
        if plan.scaling == "standard":
            model.centers[c], width = mean, var**0.5
        elif plan.scaling == "minmax":
            model.centers[c], width = low, high - low
        else:
            model.centers[c], width = 0.0, 1.0
        model.widths[c] = width or 1.0
    if plan.scaling == "robust" and usable:
        filled = df.select(*[model._numeric(c).alias(c) for c in usable])
        cuts = quantile_values(filled, {c: [0.25, 0.5, 0.75] for c in usable})
        for c in usable:
            model.centers[c] = cuts[c, 0.5]
            model.widths[c] = (cuts[c, 0.75] - cuts[c, 0.25]) or 1.0


def _fit_onehot(df: DataFrame, model: FeatureModel) -> None:
    """Distinct categories of all columns in one pass; the limit bounds what reaches the driver."""
    cols, limit = model.plan.categorical, model.plan.max_categories
    if not cols:
        return
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), model._category(c).alias("value")) for c in cols])
    seen = df.select(F.inline(pairs)).distinct()
    model.categories = {c: [] for c in cols}
    for r in seen.limit(len(cols) * (limit + 1)).collect():
        model.categories[r["column"]].append(r["value"])
    wide = [c for c in cols if len(model.categories[c]) > limit]
    if wide or sum(map(len, model.categories.values())) == len(cols) * (limit + 1):
        raise ValueError(f"more than {limit} categories in {wide or cols}: use encoding='onehot_sparse'")
    model.categories = {c: sorted(v) for c, v in model.categories.items()}


def _keep_lookups(model: FeatureModel, codes: DataFrame, default: float) -> None:
    """Write the category tables of all columns once and note their sizes."""
    table = materialize(codes)
    sizes = {r[0]: (r[1], r[2]) for r in table.groupBy("column").agg(F.count(F.lit(1)), F.sum(F.octet_length("value"))).collect()}
    for c in model.plan.categorical:
        model.lookups[c] = table.filter(F.col("column") == c).select("value", "code")
        model.defaults[c] = default
        model.sizes[c], model.text_bytes[c] = sizes.get(c, (0, 0))


def _categories(df: DataFrame, cols: list[str], *carry: Column) -> DataFrame:
    """``column, value`` and what is carried along, a row for each cell: one scan whatever the number of columns."""
    pairs = [F.struct(F.lit(c).alias("column"), F.coalesce(ref(c).cast("string"), F.lit(MISSING)).alias("value")) for c in cols]
    kind = "array<struct<column: string, value: string>>"
    return df.select(*carry, F.inline(F.array(*pairs) if pairs else F.array().cast(kind)))


def label_codes(df: DataFrame, cols: list[str]) -> DataFrame:
    """``column, value, code`` with codes 0, 1, ... a column in text order, ranked without a single-task sort."""
    values = _categories(df, cols).distinct().withColumn("one", F.lit(1))
    ranked = running(values, ["column"], ["value"], sums={"rank": "one"})
    return ranked.select("column", "value", (F.col("rank") - 1).cast("double").alias("code"))


def _smoothed(total: Column, rows: Column, overall: Column, smoothing: float) -> Column:
    """Mean of a category, drawn to the overall mean by as many rows as ``smoothing`` says."""
    weight = rows + F.lit(float(smoothing))
    return F.when(weight > 0, (total + F.lit(float(smoothing)) * overall) / weight).otherwise(overall)


def _fit_target(df: DataFrame, model: FeatureModel) -> None:
    """Smoothed mean of the target per category; fit on training rows only."""
    plan = model.plan
    if not plan.target or plan.target not in numeric_columns(df, "all"):
        raise ValueError("target encoding needs a numeric target")
    y = ref(plan.target).cast("double")
    overall = df.agg(F.avg(y)).first()[0] or 0.0
    sums = _categories(df, plan.categorical, y.alias("y")).groupBy("column", "value").agg(
        F.coalesce(F.sum("y"), F.lit(0.0)).alias("total"), F.count("y").alias("rows"))
    code = _smoothed(F.col("total"), F.col("rows"), F.lit(overall), plan.smoothing)
    _keep_lookups(model, sums.select("column", "value", code.alias("code")), overall)


def out_of_fold_target(
    df: DataFrame, cols: list[str], target: str, key: list[str], folds: int = 5, smoothing: float = 10.0, seed: int = 42
) -> DataFrame:
    """The rows with a code ``target__<column>`` for each of ``cols``: the smoothed target mean of the row's category,
    taken from the other folds, so that a row's own target never enters its code.

    Rows fall into folds by the hash of ``key``. Sums by (column, value, fold) of all columns come from one scan; a row's
    own fold is left out by subtraction. A category that no other fold holds gets their overall mean. A null, NaN or
    infinite target counts nowhere, and its row is coded like any other; a null category is one of its own.
    """
    if folds < 2:
        raise ValueError("codes from other folds need two folds")
    chosen = pick(df, cols, [])
    fold = hash_number(key, seed) % folds
    coded = _categories(df, chosen, fold.alias("fold"), finite(ref(target)).alias("y"))
    whole = df.select(fold.alias("fold"), finite(ref(target)).alias("y"))
    by_fold = {r[0]: (r[1] or 0.0, r[2]) for r in whole.groupBy("fold").agg(F.sum("y"), F.count("y")).collect()}
    total, rows = (sum(v[i] for v in by_fold.values()) for i in (0, 1))
    others = []
    for f in range(folds):
        t, n = by_fold.get(f, (0.0, 0))
        others.append(float((total - t) / (rows - n)) if rows > n else 0.0)
    sums = coded.groupBy("column", "value", "fold").agg(
        F.coalesce(F.sum("y"), F.lit(0.0)).alias("total"), F.count("y").alias("rows"))
    own = [F.struct(*[F.coalesce(F.sum(F.when(F.col("fold") == f, F.col(c))), F.lit(0)).alias(c) for c in ("total", "rows")]) for f in range(folds)]
    held = sums.groupBy("column", "value").agg(F.sum("total").alias("total"), F.sum("rows").alias("rows"), F.array(*own).alias("own"))
    codes = [_smoothed(F.when(F.col("rows") > F.col("own")[f]["rows"], F.col("total") - F.col("own")[f]["total"]).otherwise(0.0),
                       F.col("rows") - F.col("own")[f]["rows"], F.lit(others[f]), smoothing) for f in range(folds)]
    table = materialize(held.select("column", "value", F.array(*codes).alias("codes")))
    sizes = {r[0]: r[1:] for r in table.groupBy("column").agg(F.count(F.lit(1)), F.sum(F.octet_length("value"))).collect()}
    mark = "_"
    while any(c.startswith(mark) for c in df.columns):
        mark += "_"
    out, made = df.withColumn(f"{mark}fold", fold), []
    for i, c in enumerate(chosen):
        one = table.filter(F.col("column") == c).select(F.col("value").alias(f"{mark}v{i}"), F.col("codes").alias(f"{mark}c{i}"))
        n, size = sizes.get(c, (0, 0))
        if n * folds <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
            one = F.broadcast(one)
        out = out.join(one, F.coalesce(ref(c).cast("string"), F.lit(MISSING)) == F.col(f"{mark}v{i}"), "left")
        made.append(F.col(f"{mark}c{i}")[F.col(f"{mark}fold")].alias(f"target__{c}"))
    return out.select(*[ref(c) for c in df.columns], *made)


def class_scores(df: DataFrame, target: str, cols: list[str] | None = None, bins: int = 10) -> DataFrame:
    """``column, mutual_information, statistic, dof, p_value``: how much a column tells of the class in ``target``.

    All columns are counted with the class together, in one scan after the one that fits ranges. Numeric columns fall into
    ``bins`` of equal width; null, NaN and infinities are one category more. Information is in nats, the statistic is
    chi-squared. Rows without a class don't count; a column with one category tells nothing (no p-value).
    """
    chosen = [c for c in pick(df, cols, [f.name for f in df.schema if not isinstance(f.dataType, NESTED)]) if c != target]
    empty = "column string, mutual_information double, statistic double, dof long, p_value double"
    if not chosen:
        return df.sparkSession.createDataFrame([], empty)
    known = df.filter(ref(target).isNotNull())
    numbers, ranges = [c for c in chosen if c in numeric_columns(df, "all")], {}
    for part in slices(numbers, 50):
        if part:
            row = known.agg(*[fn(finite(ref(c))) for c in part for fn in (F.min, F.max)]).first()
            ranges.update({c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(part)})

    def category(c: str) -> Column:
        if c not in ranges:
            return F.coalesce(ref(c).cast("string"), F.lit(MISSING))
        (low, high), value = ranges[c], finite(ref(c))
        width = 0.0 if low is None else (high - low) / bins
        slot = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(bins - 1)) if width else F.lit(0)
        slot = F.when(value.isNotNull(), slot)
        return F.coalesce(slot.cast("string"), F.lit(MISSING))

    pairs = F.array(*[F.struct(F.lit(c).alias("column"), category(c).alias("value")) for c in chosen])
    label = ref(target).cast("string").alias("class")
    cells = known.select(label, F.inline(pairs)).groupBy("column", "value", "class").agg(F.count(F.lit(1)).alias("n"))
    classes = known.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    n, n_class, n_value = F.col("n"), F.col("n_class"), F.col("n_value")
    by_value = cells.join(classes, "class").groupBy("column", "value").agg(
        F.sum("n").alias("n_value"), F.sum(n * (F.log(n) - F.log(n_class))).alias("logs"),
        F.sum(n * n / n_class).alias("squares"), F.sum(n / n_class).alias("classes"))
    # every row has a category in every column, so a column's shares of the classes add up to their number
    by_column = by_value.groupBy("column").agg(
        F.sum("n_value").alias("n"), F.count(F.lit(1)).alias("values"), F.round(F.sum("classes")).cast("long").alias("classes"),
        F.sum(F.col("logs") - n_value * F.log(n_value)).alias("logs"), F.sum(F.col("squares") / n_value).alias("squares"))
    dof = (F.col("values") - 1) * (F.col("classes") - 1)
    statistic = F.greatest(F.lit(0.0), n * (F.col("squares") - 1))
    return by_column.select(
        "column", F.greatest(F.lit(0.0), F.col("logs") / n + F.log(n)).alias("mutual_information"), statistic.alias("statistic"),
        dof.alias("dof"), chi2_p_value(statistic, dof).alias("p_value"))


def select_for_class(df: DataFrame, target: str, k: int, cols: list[str] | None = None, bins: int = 10, alpha: float = 1.0) -> DataFrame:
    """``column, score``: the ``k`` columns with most information on the class whose p-value is at most ``alpha``."""
    found = class_scores(df, target, cols, bins).filter(F.col("p_value") <= alpha)
    return found.orderBy(F.desc("mutual_information"), "column").limit(k).select("column", F.col("mutual_information").alias("score"))


def select_features(df: DataFrame, target: str, k: int, cols: list[str] | None = None, min_variance: float = 0.0) -> DataFrame:
    """``column, score``: the ``k`` numeric columns most correlated with the target.

    Columns whose variance does not exceed ``min_variance`` are left out.
    """
    chosen = [c for c in pick(df, cols, numeric_columns(df)) if c != target]
    y = f"CAST({quoted(target)} AS DOUBLE)"
    frames = None
    for part in slices(chosen, 25):
        exprs, slots = [], []
        for i, c in enumerate(part):
            v = f"CAST({quoted(c)} AS DOUBLE)"
            exprs += [F.expr(f"corr({v}, {y})").alias(f"r{i}"), F.expr(f"var_pop({v})").alias(f"v{i}")]
            slots.append(F.struct(F.lit(c).alias("column"), F.abs(F.col(f"r{i}")).alias("score"),
                                  F.col(f"v{i}").alias("variance")))
        one = df.agg(*exprs).select(F.inline(F.array(*slots)))
        frames = one if frames is None else frames.unionByName(one)
    usable = (F.col("variance") > min_variance) & F.col("score").isNotNull() & ~F.isnan("score")
    return frames.filter(usable).orderBy(F.desc("score"), "column").limit(k).select("column", "score")
