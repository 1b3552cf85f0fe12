"""Checks of profile, quality and cleaning operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.common import NUMERIC, TYPES, derived, rounded, scratch, table, with_
from plumbline.operators import cleaning as C
from plumbline.operators import profile as P
from plumbline.operators.diff import diff
from plumbline.plans.cleaning import clean, register_cleaner
from plumbline.sources.files import file_manifest, storage_stats


def sql_counts(source: str, cols: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) AS rows, count(*) - count({c}) AS null_count, "
        f"count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END AS n_unique FROM {source}"
        for c, t in cols.items())


def sql_profile(source: str, cols: dict[str, str], digits: int = 4) -> str:
    parts = []
    for c, t in cols.items():
        stats = ", ".join(
            f"round({e}, {digits}) AS {n}" for n, e in {
                "mean": f"avg({c}::DOUBLE)", "std": f"stddev_samp({c}::DOUBLE)", "min": f"min({c})::DOUBLE",
                "max": f"max({c})::DOUBLE", "median": f"quantile_cont({c}::DOUBLE, 0.5)",
                "q25": f"quantile_cont({c}::DOUBLE, 0.25)", "q75": f"quantile_cont({c}::DOUBLE, 0.75)"}.items()
        ) if t in NUMERIC else ", ".join(
            f"NULL::DOUBLE AS {n}" for n in ("mean", "std", "min", "max", "median", "q25", "q75"))
        parts.append(
            f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) - count({c}) AS null_count, "
            f"round((count(*) - count({c})) * 100.0 / count(*), 2)::DOUBLE AS null_percent, "
            f"count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END AS n_unique, {stats} FROM {source}")
    return " UNION ALL ".join(parts)


def sql_load_stats(source: str, cols: dict[str, str]) -> str:
    return (f"SELECT \"column\", dtype, rows AS row_count, {len(cols)} AS column_count, null_count, "
            f"round(null_count * 100.0 / rows, 2)::DOUBLE AS null_percent FROM ({sql_counts(source, cols)})")


def sql_quality(source: str, cols: list[str], group: str | None = None) -> str:
    names = group or ", ".join(cols)
    nulls = " + ".join(f"(count(*) - count({c}))" for c in cols)
    return (f"SELECT count(*)::DOUBLE AS n, ({nulls})::DOUBLE AS nulls, "
            f"(SELECT count(*) FROM (SELECT DISTINCT {names} FROM {source}))::DOUBLE AS uniq, {len(cols)} AS w FROM {source}")


SCORE = "least(1.0, 0.4 * (1 - nulls / (n * w)) + 0.3 * (uniq / n) + 0.3 * 0.8)"


def nearest(source: str, c: str, q: float) -> str:
    return (f"(SELECT v::DOUBLE FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) AS rn, count(*) OVER () AS n "
            f"FROM {source} WHERE {c} IS NOT NULL) WHERE rn = floor((n - 1) * {q} + 0.5) + 1)")


def sql_correlations(source: str, cols: list[str], threshold: float, digits: int) -> str:
    pairs = " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}::DOUBLE, {b}::DOUBLE) AS r FROM {source}"
        for i, a in enumerate(cols) for b in cols[i + 1:])
    return f"SELECT column_a, column_b, round(r, {digits}) AS correlation FROM ({pairs}) WHERE abs(r) > {threshold} AND NOT isnan(r)"


LINE_NUMBERS = [c for c, t in TYPES["lineitem"].items() if t in NUMERIC]
DIRTY_COLS = list(TYPES["dirty"])
FENCE = "SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM"


def issues_sql(source: str, cols: dict[str, str]) -> str:
    counted = sql_counts(source, cols)
    distinct = ", ".join(cols)
    return (
        f", counted AS ({counted}), copies AS (SELECT 1 - (SELECT count(*) FROM (SELECT DISTINCT {distinct} FROM {source}))::DOUBLE "
        f"/ count(*) AS ratio FROM {source}) "
        "SELECT \"column\", 'missing_values' AS type, CASE WHEN null_count::DOUBLE / rows > 0.5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, "
        "round(null_count::DOUBLE / rows, 6) AS ratio FROM counted WHERE null_count::DOUBLE / rows > 0.1 "
        "UNION ALL SELECT \"column\", 'duplicates', 'HIGH', round(1 - n_unique::DOUBLE / rows, 6) FROM counted "
        "WHERE lower(\"column\") LIKE '%id%' AND n_unique::DOUBLE / rows < 0.99 "
        "UNION ALL SELECT \"column\", 'constant', 'LOW', round(1 - n_unique::DOUBLE / rows, 6) FROM counted WHERE n_unique = 1 "
        "UNION ALL SELECT '_all_', 'duplicate_rows', CASE WHEN ratio < 0.1 THEN 'MEDIUM' ELSE 'HIGH' END, round(ratio, 6) "
        "FROM copies WHERE ratio > 0.01")


PLAN = [
    {"operation": "remove_duplicates", "target": "all"},
    {"operation": "handle_missing", "target": "event_type", "strategy": "mode"},
    {"operation": "handle_missing", "target": "value", "strategy": "mean"},
    {"operation": "remove_outliers", "target": "value"},
]
PLAN_SQL = (
    ", m AS (SELECT avg(value) AS a FROM dirty), "
    "mo AS (SELECT event_type AS e FROM dirty WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1), "
    "filled AS (SELECT event_id, coalesce(value, (SELECT a FROM m)) AS value, coalesce(event_type, (SELECT e FROM mo)) AS event_type, k "
    f"FROM (SELECT DISTINCT * FROM dirty)), f AS ({FENCE} filled), "
    "kept AS (SELECT filled.* FROM filled, f WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) ")

EXPECTED = T.StructType([
    T.StructField("event_id", T.LongType(), False), T.StructField("user_id", T.StringType()),
    T.StructField("c", T.IntegerType()), T.StructField("n", T.DoubleType()), T.StructField("extra", T.DateType()),
])


def _user_cleaner(spark, d):
    register_cleaner("drop_errors", lambda df: df.filter("event_type IS NULL OR event_type <> 'error'"))
    plan = [{"operation": "drop_errors"}, {"operation": "expr", "target": "value", "expr": "coalesce(value, 0) + 1"},
            {"operation": "expr", "target": "all", "expr": "k < 400"}]
    return rounded(clean(derived(spark, d, "dirty"), plan).df)


# 24 numeric columns, each null in its own rows.
WIDE = [f"c{i}" for i in range(24)]
WIDE_COLS = ", ".join(f"CASE WHEN event_id % {i + 3} = 1 THEN NULL ELSE value * {i % 5 + 1} + (event_id * {i + 7}) % {i + 11} END AS c{i}" for i in range(24))
WIDE_SQL = f"WITH wide AS (SELECT {WIDE_COLS} FROM events) "


def _wide(spark, d):
    return spark.sql(f"SELECT {WIDE_COLS} FROM {{events}}", events=table(spark, d, "events"))


CHECKS = {
    "load_stats_lineitem": (lambda s, d: P.load_stats(table(s, d, "lineitem")),
                            sql_load_stats("lineitem", TYPES["lineitem"])),
    "load_stats_dirty": (lambda s, d: P.load_stats(derived(s, d, "dirty")),
                         with_("dirty", body=sql_load_stats("dirty", TYPES["dirty"]))),
    "profile_lineitem": (lambda s, d: rounded(P.profile(table(s, d, "lineitem")), 4),
                         sql_profile("lineitem", TYPES["lineitem"])),
    "profile_dirty": (lambda s, d: rounded(P.profile(derived(s, d, "dirty")), 4),
                      with_("dirty", body=sql_profile("dirty", TYPES["dirty"]))),
    "quantiles_nearest": (
        lambda s, d: P.quantiles(table(s, d, "lineitem"), {"l_extendedprice": [0.25, 0.75], "l_quantity": [0.9]}, "nearest"),
        " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {q}::DOUBLE AS q, {nearest('lineitem', c, q)} AS value" for c, q in
                           (("l_extendedprice", 0.25), ("l_extendedprice", 0.75), ("l_quantity", 0.9)))),
    "planning_summary_dirty": (
        lambda s, d: P.planning_summary(derived(s, d, "dirty")),
        with_("dirty", body=f"SELECT \"column\", dtype, n_unique, round(null_count * 100.0 / rows, 1)::DOUBLE AS null_pct "
                            f"FROM ({sql_counts('dirty', TYPES['dirty'])})")),
    "top_values_part": (
        lambda s, d: P.top_values(table(s, d, "part")),
        "SELECT \"column\", rank::INT AS rank, value, n AS count FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS rank FROM ("
        + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM part GROUP BY {c}"
                             for c in ("p_name", "p_brand", "p_type")) + ")) WHERE rank <= 5"),
    "top_values_dirty": (
        lambda s, d: P.top_values(derived(s, d, "dirty"), k=3),
        with_("dirty", body="SELECT 'event_type' AS \"column\", rank::INT AS rank, value, n AS count FROM (SELECT event_type AS value, count(*) AS n, "
              "row_number() OVER (ORDER BY count(*) DESC, event_type NULLS LAST) AS rank FROM dirty GROUP BY event_type) WHERE rank <= 3")),
    "value_counts_orders": (
        lambda s, d: P.value_counts(table(s, d, "orders")),
        "SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS value, count(*) AS count FROM orders GROUP BY 2 "
        "UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2"),
    "correlations_part": (lambda s, d: P.correlations(table(s, d, "part")),
                          sql_correlations("part", ["p_partkey", "p_size", "p_retailprice"], 0.3, 3)),
    "correlations_lineitem": (lambda s, d: P.correlations(table(s, d, "lineitem"), threshold=0.0, digits=6),
                              sql_correlations("lineitem", LINE_NUMBERS, 0.0, 6)),
    "correlations_wide": (lambda s, d: P.correlations(_wide(s, d), threshold=0.0, digits=6),
                          WIDE_SQL + sql_correlations("wide", WIDE, 0.0, 6)),
    "correlations_dirty": (lambda s, d: P.correlations(derived(s, d, "odd"), threshold=0.0, digits=6),
                           with_("odd", body=sql_correlations("odd", ["event_id", "user_id", "value"], 0.0, 6))),
    "highest_correlation_part": (
        lambda s, d: P.highest_correlation(table(s, d, "part")),
        sql_correlations("part", ["p_partkey", "p_size", "p_retailprice"], 0.3, 3) + " ORDER BY abs(r) DESC LIMIT 1"),
    "quality_score_dirty": (
        lambda s, d: rounded(P.quality_score(derived(s, d, "dirty"))),
        with_("dirty", body=f"SELECT round(1 - nulls / (n * w), 6) AS completeness, round(uniq / n, 6) AS uniqueness, round({SCORE}, 6) AS score "
                            f"FROM ({sql_quality('dirty', DIRTY_COLS)})")),
    "quality_score_dup": (
        lambda s, d: rounded(P.quality_score(derived(s, d, "dup"))),
        with_("dup", body=f"SELECT round(1 - nulls / (n * w), 6) AS completeness, round(uniq / n, 6) AS uniqueness, round({SCORE}, 6) AS score "
                          f"FROM ({sql_quality('dup', ['user_id', 'event_type'])})")),
    "quality_gate_dup": (
        lambda s, d: rounded(P.quality_gate(derived(s, d, "dup"))),
        with_("dup", body=f"SELECT round({SCORE}, 6) AS score, 0.8::DOUBLE AS threshold, {SCORE} >= 0.8 AS passed "
                          f"FROM ({sql_quality('dup', ['user_id', 'event_type'])})")),
    "quality_issues_odd": (lambda s, d: rounded(P.quality_issues(derived(s, d, "odd"))),
                           with_("odd", body=issues_sql("odd", TYPES["odd"]))),
    "quality_issues_dup": (lambda s, d: rounded(P.quality_issues(derived(s, d, "dup"))),
                           with_("dup", body=issues_sql("dup", {"user_id": "bigint", "event_type": "string"}))),
    "missing_patterns_dirty": (
        lambda s, d: P.missing_patterns(derived(s, d, "dirty")),
        with_("dirty", body="SELECT concat_ws(',', CASE WHEN event_id IS NULL THEN 'event_id' END, CASE WHEN value IS NULL THEN 'value' END, "
              "CASE WHEN event_type IS NULL THEN 'event_type' END, CASE WHEN k IS NULL THEN 'k' END) AS pattern, count(*) AS rows FROM dirty GROUP BY 1")),
    "storage_stats": (lambda s, d: storage_stats(s, f"{d}/*.parquet"), None),
    "file_manifest": (lambda s, d: file_manifest(s, f"{d}/*.parquet"), None),
    "remove_duplicates": (lambda s, d: C.remove_duplicates(derived(s, d, "dup")),
                          with_("dup", body="SELECT DISTINCT user_id, event_type FROM dup")),
    "remove_duplicates_keep_first": (
        lambda s, d: C.remove_duplicates(table(s, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).drop("props"),
        "SELECT event_id, ts, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn "
        "FROM events) WHERE rn = 1"),
    "drop_missing_all": (lambda s, d: C.drop_missing(derived(s, d, "dirty")),
                         with_("dirty", body="SELECT * FROM dirty WHERE value IS NOT NULL AND event_type IS NOT NULL")),
    "drop_missing_column": (lambda s, d: C.drop_missing(derived(s, d, "dirty"), ["value"]),
                            with_("dirty", body="SELECT * FROM dirty WHERE value IS NOT NULL")),
    "fill_mean": (lambda s, d: rounded(C.fill_missing(derived(s, d, "dirty"), "value", "mean")),
                  with_("dirty", body="SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM dirty)), 6) AS value, event_type, k FROM dirty")),
    "fill_mode": (lambda s, d: C.fill_missing(derived(s, d, "dirty"), "event_type", "mode"),
                  with_("dirty", body="SELECT event_id, value, coalesce(event_type, (SELECT event_type FROM dirty WHERE event_type IS NOT NULL "
                        "GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type, k FROM dirty")),
    "fill_median": (lambda s, d: rounded(C.fill_missing(derived(s, d, "dirty"), "value", "median")),
                    with_("dirty", body="SELECT event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM dirty)), 6) AS value, event_type, k FROM dirty")),
    "impute_by_group_mean": (
        lambda s, d: rounded(C.impute_by_group(derived(s, d, "dirty"), "value", ["event_type"])),
        with_("dirty", body="SELECT event_id, round(coalesce(value, g.m, (SELECT avg(value) FROM dirty)), 6) AS value, dirty.event_type, k FROM dirty "
              "LEFT JOIN (SELECT event_type, avg(value) AS m FROM dirty GROUP BY event_type) g ON dirty.event_type IS NOT DISTINCT FROM g.event_type")),
    "impute_by_group_mode": (
        lambda s, d: C.impute_by_group(derived(s, d, "dirty"), "event_type", ["k"], "mode"),
        with_("dirty", body=", g AS (SELECT k, event_type AS m FROM (SELECT k, event_type, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, event_type) AS rn "
              "FROM dirty WHERE event_type IS NOT NULL GROUP BY k, event_type) WHERE rn = 1) "
              "SELECT event_id, value, coalesce(event_type, m, (SELECT event_type FROM dirty WHERE event_type IS NOT NULL GROUP BY event_type "
              "ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type, dirty.k FROM dirty LEFT JOIN g ON dirty.k = g.k")),
    "remove_outliers_events": (
        lambda s, d: C.remove_outliers(table(s, d, "events"), ["value"]).select("event_id", "value"),
        f"WITH f AS ({FENCE} events) SELECT event_id, value FROM events, f WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"),
    "type_ratios": (
        lambda s, d: rounded(C.type_ratios(derived(s, d, "as_text"))).filter("type IN ('bigint', 'double')"),
        with_("as_text", body=" UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", '{t}' AS type, round(count(*) FILTER (regexp_matches({c}, '{p}'))::DOUBLE / count({c}), 6) AS ratio FROM as_text"
            for c in ("qty", "tax", "flag") for t, p in (("bigint", "^[+-]?[0-9]{1,18}$"), ("double", "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"))))),
    "fix_types": (
        lambda s, d: C.fix_types(derived(s, d, "as_text"), min_ratio=0.8),
        with_("as_text", body="SELECT l_orderkey, l_linenumber, CAST(qty AS BIGINT) AS qty, TRY_CAST(tax AS DOUBLE) AS tax, flag FROM as_text")),
    "validate_schema": (
        lambda s, d: rounded(C.validate_schema(derived(s, d, "odd"), EXPECTED)),
        with_("odd", body="SELECT 'extra' AS \"column\", 'missing_column' AS rule, 'date' AS detail, NULL::DOUBLE AS ratio "
              "UNION ALL SELECT 'value', 'unexpected_column', 'double', NULL UNION ALL SELECT 'user_id', 'wrong_type', 'bigint, expected string', NULL "
              "UNION ALL SELECT 'n', 'too_many_nulls', 'limit 0.5', round(1 - count(n)::DOUBLE / count(*), 6) FROM odd HAVING count(n)::DOUBLE / count(*) < 0.5")),
    "clean_plan": (lambda s, d: rounded(clean(derived(s, d, "dirty"), PLAN).df),
                   with_("dirty", body=PLAN_SQL + "SELECT event_id, round(value, 6) AS value, event_type, k FROM kept")),
    "clean_report": (
        lambda s, d: rounded(clean(derived(s, d, "dirty"), PLAN).report()).drop("fill_value"),
        with_("dirty", body=PLAN_SQL + ", n AS (SELECT (SELECT count(*) FROM dirty) AS a, (SELECT count(*) FROM filled) AS b, (SELECT count(*) FROM kept) AS c) "
              "SELECT 1 AS step, 'remove_duplicates' AS operation, a AS rows_before, b AS rows_after, a - b AS rows_affected, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper FROM n "
              "UNION ALL SELECT 2, 'fill_mode_event_type', b, b, 0, NULL, NULL FROM n UNION ALL SELECT 3, 'fill_mean_value', b, b, 0, NULL, NULL FROM n "
              "UNION ALL SELECT 4, 'remove_outliers_value', b, c, b - c, round(q1 - 1.5 * (q3 - q1), 6), round(q3 + 1.5 * (q3 - q1), 6) FROM n, f")),
    "clean_summary": (
        lambda s, d: rounded(clean(derived(s, d, "dup"), None).summary()),
        with_("dup", body=f", u AS (SELECT DISTINCT * FROM dup), b AS ({sql_quality('dup', ['user_id', 'event_type'])}), a AS ({sql_quality('u', ['user_id', 'event_type'])}), "
              f"r AS (SELECT (SELECT n FROM b)::BIGINT AS rows_before, (SELECT n FROM a)::BIGINT AS rows_after, (SELECT {SCORE} FROM b) AS qb, (SELECT {SCORE} FROM a) AS qa) "
              "SELECT rows_before, 2 AS cols_before, round(qb, 6) AS quality_before, rows_after, 2 AS cols_after, round(qa, 6) AS quality_after, "
              "rows_before - rows_after AS rows_removed, round(qa - qb, 6) AS quality_improvement FROM r")),
    "clean_user_steps": (
        _user_cleaner,
        with_("dirty", body="SELECT event_id, round(coalesce(value, 0) + 1, 6) AS value, event_type, k FROM dirty "
              "WHERE (event_type IS NULL OR event_type <> 'error') AND k < 400")),
    "diff_by_key": (
        lambda s, d: diff(table(s, d, "events").select("event_id", "event_type", "user_id"),
                          derived(s, d, "dirty").filter("k >= 100").select("event_id", "event_type", F.col("k").alias("user_id")), ["event_id"]),
        with_("dirty", body=", a AS (SELECT event_id, event_type, k AS user_id FROM dirty WHERE k >= 100), "
              "j AS (SELECT e.event_id, e.event_type AS t0, a.event_type AS t1, e.user_id AS u0, a.user_id AS u1, a.event_id AS hit FROM events e LEFT JOIN a USING (event_id)) "
              "SELECT event_id, 'removed' AS change, NULL::VARCHAR AS \"column\", NULL::VARCHAR AS old, NULL::VARCHAR AS new FROM j WHERE hit IS NULL "
              "UNION ALL SELECT event_id, 'changed', 'event_type', t0, t1 FROM j WHERE hit IS NOT NULL AND t0 IS DISTINCT FROM t1 "
              "UNION ALL SELECT event_id, 'changed', 'user_id', u0::VARCHAR, u1::VARCHAR FROM j WHERE hit IS NOT NULL AND u0 IS DISTINCT FROM u1")),
    "diff_rows": (
        lambda s, d: diff(derived(s, d, "dup"), C.remove_duplicates(derived(s, d, "dup"))),
        with_("dup", body="SELECT user_id, event_type, 'removed' AS change, count(*) - 1 AS copies FROM dup GROUP BY 1, 2 HAVING count(*) > 1")),
}


def _formats():
    from plumbline.sources.readers import load
    from plumbline.sources.writers import save, save_report, save_stage

    cols = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"
    sql = f"SELECT {cols} FROM orders"

    def through(kind: str):
        def run(spark, d):
            path = scratch(spark, f"orders.{kind}")
            save(table(spark, d, "orders").select(*cols.split(", ")), path, format=kind)
            return load(spark, path, format=kind, schema=None if kind in ("parquet", "orc") else
                        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string")
        return run

    def inferred(spark, d):
        path = scratch(spark, "orders")
        save(table(spark, d, "orders").select(*cols.split(", ")), path, format="csv")
        return load(spark, path).withColumns({c: F.col(c).cast("bigint") for c in ("o_orderkey", "o_custkey")})

    def staged(spark, d):
        return save_stage(table(spark, d, "orders").select(*cols.split(", ")), scratch(spark, "stage"), partition_by=["o_orderstatus"])

    def reported(spark, d):
        path = scratch(spark, "report")
        save_report(P.load_stats(table(spark, d, "lineitem")), path)
        return load(spark, path, format="jsonl", schema="column string, dtype string, row_count bigint, column_count int, null_count bigint, null_percent double")

    def document(spark, d):
        """All columns, the timestamp too, through one JSON file extension."""
        path = scratch(spark, "orders") + ".json"
        rows = table(spark, d, "orders")
        save(rows, path)
        return load(spark, path, schema=rows.schema)

    made = {f"source_{k}": (through(k), sql) for k in ("csv", "tsv", "jsonl", "orc", "parquet")}
    made["source_unknown_extension"] = (inferred, sql)
    made["source_json"] = (document, "SELECT * FROM orders")
    made["sink_stage_partitioned"] = (staged, sql)
    made["sink_report_json"] = (reported, sql_load_stats("lineitem", TYPES["lineitem"]))
    return made


CHECKS.update(_formats())
