"""Shared inputs of the checks, written once for Spark and once for SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def rounded(df: DataFrame, digits: int = 6, *cols: str) -> DataFrame:
    """Round the named columns (all double columns by default)."""
    chosen = cols or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(F.col(c), digits) for c in chosen})


# One derived input: Spark SQL and DuckDB SQL are the same text over the table it names.
DERIVED = {
    "dirty": (
        "events",
        "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, "
        "CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type, event_id % 500 AS k FROM events",
    ),
    "dup": ("events", "SELECT user_id, event_type FROM events"),
    "odd": (
        "events",
        "SELECT event_id, user_id, CAST(1 AS INT) AS c, CAST(NULL AS DOUBLE) AS n, "
        "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM events",
    ),
    "as_text": (
        "lineitem",
        "SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS INT) AS STRING) AS qty, "
        "CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE CAST(l_tax AS STRING) END AS tax, l_returnflag AS flag FROM lineitem",
    ),
    "ref_orders": ("orders", "SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'"),
    "cur_orders": ("orders", "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'"),
    "shifted_orders": (
        "orders",
        "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice * 1.5 AS o_totalprice, o_orderdate, "
        "CASE WHEN o_custkey % 2 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority "
        "FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'",
    ),
    "calls": (
        "events",
        "SELECT event_id, ts, CAST(user_id % 10 AS STRING) AS agent, "
        "CASE WHEN user_id % 7 = 0 THEN event_type ELSE concat('p', CAST(user_id % 3 AS STRING), '/', event_type) END AS model, "
        "value / 10 AS cost, CAST(floor(value) AS BIGINT) AS tokens, value * 2 AS latency_ms FROM events",
    ),
    "scored": (
        "lineitem",
        "SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_discount * 10 AS score, "
        "CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS prediction FROM lineitem",
    ),
    "jobs": (
        "events",
        "SELECT CAST(event_id AS STRING) AS id, event_type AS status, ts AS created_at, "
        "CAST(event_id % 12 AS INT) AS current_step, CAST(event_id % 5 * 3 AS INT) AS total_steps FROM events",
    ),
    "runs": (
        "events",
        "SELECT CAST(user_id % 10 AS STRING) AS agent_name, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, "
        "value AS duration_seconds, CAST(floor(value * 3) AS BIGINT) AS tokens_used, value / 100 AS cost FROM events",
    ),
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, sql = DERIVED[name]
    return spark.sql(sql.replace(f"FROM {source}", "FROM {source}"), source=table(spark, sf_dir, source))


def with_(*names: str, body: str) -> str:
    """DuckDB SQL with the derived inputs in front."""
    parts = ", ".join(f"{n} AS ({DERIVED[n][1]})" for n in names)
    return f"WITH {parts}{', ' if body.lstrip().startswith(',') else ' '}{body.lstrip().lstrip(',')}"


# Column types as Spark prints them.
TYPES = {
    "lineitem": {
        "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
        "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
        "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
    },
    "dirty": {"event_id": "bigint", "value": "double", "event_type": "string", "k": "bigint"},
    "odd": {"event_id": "bigint", "user_id": "bigint", "c": "int", "n": "double", "value": "double"},
}
NUMERIC = ("bigint", "int", "double")
