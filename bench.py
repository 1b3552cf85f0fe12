"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores. Every query runs once to
warm up and three times for the median; results are written to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import registry  # noqa: E402
from plumbline.session import session  # noqa: E402

HEADLINE = [
    "load_stats_lineitem",
    "profile_lineitem",
    "correlations_lineitem",
    "quality_score_dirty",
    "quality_issues_dup",
    "clean_plan",
    "remove_outliers_events",
    "drift_shifted",
    "ks_two_sample",
    "prediction_drift",
    "features_standard_onehot",
    "classification_metrics",
    "roc_auc",
    "latest",
    "retain",
    "regressions",
    "budget_status",
    "rate_limit_audit",
    "usage_rollup",
    "stream_drift",
]


def seconds(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def duckdb_seconds(sf_dir: str) -> dict[str, float]:
    """The same queries' SQL on DuckDB, for the baseline table."""
    from checks.compare import connect

    con, out = connect(sf_dir), {}
    for name in HEADLINE:
        times = []
        for _ in range(3):
            start = time.perf_counter()
            con.execute(registry.CHECKS[name][1]).fetchall()
            times.append(time.perf_counter() - start)
        out[name] = round(statistics.median(times), 3)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        query = registry.CHECKS[name][0]
        seconds(lambda: query(spark, sf_dir))
        runs = [seconds(lambda: query(spark, sf_dir)) for _ in range(repeats)]
        times[name] = round(statistics.median(runs), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    result = {"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
              "sf": os.path.basename(sf_dir.rstrip("/"))}
    if "--duckdb" in sys.argv:
        result["duckdb"] = duckdb_seconds(sf_dir)
    print(json.dumps(result))


if __name__ == "__main__":
    main()
