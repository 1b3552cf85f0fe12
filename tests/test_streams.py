"""Rate limits and streams: against brute force, against the batch form, and with late rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.operators import drift as D
from plumbline.operators import rate_limit as RL
from plumbline.streaming import jobs as J

START = datetime(2024, 1, 1)
SCHEMA = "id bigint, who string, ts timestamp_ntz, v double"


def requests(n, seed=0):
    """Half of all requests come from one key, in bursts with pauses."""
    rng = random.Random(seed)
    rows, now = [], START
    for i in range(n):
        now += timedelta(seconds=rng.choice([0.2, 0.5, 1, 3, 3, 200 if i % 97 == 0 else 2]))
        rows.append((i, "hot" if rng.random() < 0.5 else rng.choice("abc"), now, rng.random()))
    return rows


def brute(rows, rate, burst):
    """One bucket per key, straight from the definition."""
    tokens, last, out = {}, {}, {}
    for i, who, ts, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        us = round((ts - START).total_seconds() * 1e6)
        left = tokens.get(who, burst * RL.TOKEN)
        left = min(burst * RL.TOKEN, left + (us - last.get(who, us)) * rate)
        ok = left >= RL.TOKEN
        tokens[who], last[who] = left - RL.TOKEN if ok else left, us
        out[i] = (ok, tokens[who] // RL.TOKEN)
    return out


def test_bucket():
    bucket = RL.Bucket(10 * RL.TOKEN, 60)
    assert bucket.take(0, 5) == (True, 0.0, 5)
    assert bucket.take(0, 8)[0] is False
    five = RL.Bucket(5 * RL.TOKEN, 5)
    assert [five.take(0, 1)[0] for _ in range(6)] == [True] * 5 + [False]
    assert five.take(0, 1)[1] == pytest.approx(12.0)
    assert five.take(12_000_000, 1)[0] is True
    ten = RL.Bucket(10 * RL.TOKEN, 10)
    assert [ten.take(0, 1)[2] for _ in range(2)] == [9, 8]


@pytest.mark.parametrize("rate, burst", [(20, 3), (60, 2)])
def test_audit_against_brute_force(spark, rate, burst):
    rows = requests(1500)
    want = brute(rows, rate, burst)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = {r.id: (r.allowed, r.remaining) for r in RL.rate_limit_audit(df, "who", "ts", ["id"], rate, burst).collect()}
    assert got == want and not all(ok for ok, _ in want.values())


@pytest.mark.parametrize("gap, rate, burst", [(0.3, 60, 5), (0.9, 60, 5), (1.1, 60, 4), (4, 10, 50)])
def test_one_busy_key_in_many_slices(spark, gap, rate, burst, monkeypatch):
    """No pause ever fills the bucket, so every slice depends on the one before it."""
    rng = random.Random(11)
    rows, now = [], START
    for i in range(1200):
        now += timedelta(seconds=rng.expovariate(1 / gap))
        rows.append((i, "hot" if i % 10 else "other", now, 0.0))
    rounds = []
    starts = RL._starts
    monkeypatch.setattr(RL, "_starts", lambda *a: rounds.append(1) or starts(*a))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = RL.rate_limit_audit(df, "who", "ts", ["id"], rate, burst, partitions=12)
    assert {r.id: (r.allowed, r.remaining) for r in out.collect()} == brute(rows, rate, burst)
    assert len(rounds) <= 8, len(rounds)


def test_null_keys_share_a_bucket(spark):
    rows = [(i, None if i % 2 else "a", START + timedelta(milliseconds=i), 0.0) for i in range(60)]
    out = RL.rate_limit_audit(spark.createDataFrame(rows, SCHEMA), "who", "ts", ["id"], 60, 5, partitions=6)
    assert {r.id: (r.allowed, r.remaining) for r in out.collect()} == brute(rows, 60, 5)


def write_parts(spark, rows, path, parts):
    step = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * step : (i + 1) * step], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream_of(spark, path, per_batch=1):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_batch).parquet(path)


def test_stream_limiter_equals_batch(spark, tmp_path):
    rows = requests(400, seed=3)
    write_parts(spark, rows, str(tmp_path / "in"), 3)
    out = J.run_available(J.stream_rate_limit(stream_of(spark, str(tmp_path / "in")), "who", "ts", "id", 20, 3, "1 hour"),
                          str(tmp_path / "out"), str(tmp_path / "state"))
    assert {r.id: (r.allowed, r.remaining) for r in out.collect()} == brute(rows, 20, 3)


def test_stream_drift_equals_batch_and_drops_late_rows(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice("abcd"), START + timedelta(minutes=i), rng.gauss(i / 600, 1)) for i in range(1200)]
    reference = spark.createDataFrame(rows[:300], SCHEMA)
    write_parts(spark, rows, str(tmp_path / "in"), 2)
    late = [(9000 + i, "z", START, 50.0) for i in range(50)]
    spark.createDataFrame(late, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    path = str(tmp_path / "scores")

    def sink(scores, batch_id):
        scores.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    job = J.stream_drift(stream_of(spark, str(tmp_path / "in")), reference, "ts", ["who", "v"], "2 hours", "10 minutes", sink=sink)
    job.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    got = {(r.window_start, r.column): r.score for r in spark.read.parquet(path).collect()}
    batch = D.drift_by_window(spark.createDataFrame(rows, SCHEMA), reference, "ts", "2 hours", cols=["who", "v"])
    want = {(r.window_start, r.column): r.score for r in batch.filter(F.col("window_end") <= F.lit(rows[-1][2] - timedelta(minutes=10))).collect()}
    assert len(got) == len(want) > 10
    assert all(got[k] == pytest.approx(v) for k, v in want.items())


def test_sliding_windows(spark):
    rows = [(i, "a", START + timedelta(minutes=i), float(i)) for i in range(240)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = D.drift_by_window(df, df, "ts", "2 hours", "1 hour", ["v"])
    assert found.count() == 5 and {r.rows for r in found.collect()} == {60, 120}


def test_window_scores_match_the_two_table_form(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("abcd"), START + timedelta(minutes=i), rng.gauss(0, 1)) for i in range(360)]
    df, ref = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows[:200], SCHEMA)
    for formula in ("standard", "reference"):
        windows = D.drift_by_window(df, ref, "ts", "2 hours", cols=["who", "v"], formula=formula).collect()
        for k in range(3):
            part = spark.createDataFrame(rows[k * 120 : (k + 1) * 120], SCHEMA)
            want = {r.column: r.score for r in D.drift(ref, part, ["who", "v"], formula).collect()}
            got = {r.column: r.score for r in windows if r.window_start == START + timedelta(hours=2 * k)}
            assert got == pytest.approx(want)


def test_dedup_within_watermark(spark, tmp_path):
    rows = [(i, "ab"[i % 2], START + timedelta(minutes=i), 0.0) for i in range(20)]
    write_parts(spark, rows, str(tmp_path / "in"), 4)
    out = J.run_available(J.stream_dedup(stream_of(spark, str(tmp_path / "in")), ["who"], "ts", "1 hour"),
                          str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.who for r in out.collect()) == ["a", "b"]


def test_large_and_missing_keys_keep_their_own_buckets(spark):
    big = 2**53
    rows = [(k, f"2024-01-01 00:00:0{i}", i) for i, k in enumerate([big, big + 1, None, big, big + 1, None])]
    df = spark.createDataFrame(rows, "who bigint, ts string, id int").withColumn("ts", F.col("ts").cast("timestamp"))
    got = RL.rate_limit_audit(df, "who", "ts", ["id"], 1, 1).orderBy("id").collect()
    assert [r.who for r in got] == [r[0] for r in rows]
    assert [r.allowed for r in got] == [True, True, True, False, False, False]


def test_limiter_state_is_held_for_groups_of_keys(spark, tmp_path):
    """Buckets of many keys, null among them, lie in few state rows; a key that pauses beyond the watermark starts full."""
    rows = [(i, None if i % 41 == 40 else f"u{i % 41}", START + timedelta(minutes=i // 60 * 40, seconds=i % 60), 0.0) for i in range(600)]
    write_parts(spark, rows, str(tmp_path / "in"), 4)
    job = J.stream_rate_limit(stream_of(spark, str(tmp_path / "in")), "who", "ts", "id", 1, 2, "1 hour", groups=3)
    query = (job.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
             .trigger(availableNow=True).start())
    query.awaitTermination(120)
    got = {r.id: (r.allowed, r.remaining) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == brute(rows, 1, 2)
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 3
