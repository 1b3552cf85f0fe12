"""The physical plans stay narrow: pruned scans, few shuffles, no Python in built-in operators."""

from pyspark.sql import functions as F

from plumbline.operators import cleaning as C
from plumbline.operators import drift as D
from plumbline.operators import history as H
from plumbline.operators import profile as P
from plumbline.operators import ranks as R

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lineitem(spark):
    return spark.read.parquet(f"{SF}/lineitem.parquet")


def test_one_scan_for_load_stats(spark):
    text = plan_of(P.load_stats(lineitem(spark)))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1


def test_drift_shuffles_do_not_grow_with_columns(spark):
    df = lineitem(spark)
    counts = []
    for cols in (["l_tax"], ["l_tax", "l_quantity", "l_discount", "l_extendedprice"]):
        both = D.pair(df, df, cols)
        counts.append(plan_of(both.counts).count("Exchange"))
    assert counts[0] == counts[1] == 1


def test_fences_reach_the_scan(spark):
    text = plan_of(C.apply_fences(lineitem(spark), {"l_tax": (0.0, 0.05)}).select("l_tax"))
    assert "PushedFilters: [IsNotNull(l_tax), GreaterThanOrEqual(l_tax,0.0), LessThanOrEqual(l_tax,0.05)]" in text
    assert "ReadSchema: struct<l_tax:double>" in text


def test_ranks_are_limited_before_the_shuffle(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    for df in (H.latest(events, ["user_id"], ["ts"]), H.retain(events, ["user_id"], ["ts"]), H.rollback(events, ["user_id"], ["ts"], 2),
               P.top_values(events), C.remove_duplicates(events, ["user_id"], ["ts"])):
        assert "WindowGroupLimit" in plan_of(df)


def test_running_values_shuffle_whole_rows_once(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    for partitions in (1, 8):
        out = R.running(events, ["event_type"], ["ts", "event_id"], sums={"s": "value"}, lags={"p": "value"}, partitions=partitions)
        rows = plan_of(out).split("BroadcastExchange")[0]  # what lies before the carried totals
        assert rows.count("Exchange hashpartitioning(event_type") == rows.count("Exchange") == 1
        assert rows.count("FileScan parquet") == 1 and "ExistingRDD" not in rows  # read from the table, not from a checkpoint


def test_slices_depend_on_values_only(spark):
    rows = [(k, t) for k in (None, "", "a", "b") for t in (None, float("nan"), -1.5, 0.0, float("inf"), *map(float, range(50)))]
    df = spark.createDataFrame(rows, "k string, t double").repartition(5)
    bounds = R.slice_bounds(df, ["k"], ["t"], 7)
    assert 3 <= len(bounds) <= 6
    got = df.withColumn("slice", R.slice_of(df, ["k", "t"], bounds)).orderBy("k", "t").collect()
    numbers = [r["slice"] for r in got]
    assert numbers == sorted(numbers) and set(numbers) == set(range(len(bounds) + 1))


def test_no_python_in_built_in_operators(spark):
    df = lineitem(spark)
    frames = [P.profile(df), P.quality_issues(df), D.drift(df, df), C.fill_missing(df, "l_tax", "mean")]
    for frame in frames:
        assert "Python" not in plan_of(frame) and "ArrowEval" not in plan_of(frame)


def test_profile_scans_one_per_type_family(spark):
    text = plan_of(P.column_counts(lineitem(spark)))
    assert text.count("FileScan") == 4  # bigint, double, string, timestamp


def test_drop_missing_is_pushed_down(spark):
    text = plan_of(C.drop_missing(lineitem(spark), ["l_tax"]).select(F.col("l_tax")))
    assert "PushedFilters: [IsNotNull(l_tax)]" in text


def test_deduplication_runs_once_per_plan(spark):
    from plumbline.plans.cleaning import clean

    plan = [{"operation": "remove_duplicates"}, {"operation": "handle_missing", "target": "l_tax", "strategy": "mean"},
            {"operation": "remove_outliers", "target": "l_tax"}]
    text = plan_of(clean(lineitem(spark), plan).df)
    assert "Exchange" not in text and "FileScan" in text


def test_small_lookups_are_broadcast_and_large_ones_joined(spark, monkeypatch):
    from plumbline.operators import features as X

    df = lineitem(spark)
    model = X.fit_features(df, X.FeaturePlan("l_tax", categorical=["l_returnflag"], encoding="label"))
    assert "BroadcastHashJoin" in plan_of(model.transform(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan_of(model.transform(df))
        monkeypatch.setattr(X, "BROADCAST_ROWS", 1)
        assert "BroadcastHashJoin" not in plan_of(model.transform(df))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_large_retention_is_sliced(spark, monkeypatch):
    from plumbline.operators.diff import diff

    events = spark.read.parquet(f"{SF}/events.parquet")
    whole = H.retain(events, ["event_type"], ["ts", "event_id"], 40)
    monkeypatch.setattr(H, "GROUP_LIMIT", 10)
    assert diff(whole, H.retain(events, ["event_type"], ["ts", "event_id"], 40)).count() == 0
