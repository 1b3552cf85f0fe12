"""Structured Streaming forms of the table operators.

Each takes a streaming DataFrame (``sources.readers.load_stream``). Rows later than the watermark are
dropped; state is bounded by the watermark or a time-out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.columns import ref
from plumbline.operators.drift import Reference, fit_reference, score_windows, window_counts
from plumbline.operators.rate_limit import BURST_FACTOR, DEFAULT_RATE, TOKEN, Bucket, micros
from plumbline.operators.records import limit_breaches

# Fixed value: a bucket is forgotten after this long without a request, or once full again if later.
IDLE_SECONDS = 600
# Fixed value: groups of keys in the state of the rate limiter.
KEY_GROUPS = 1024


def with_event_time(stream: DataFrame, ts: str, watermark: str) -> DataFrame:
    """Cast the event time to a zoned timestamp, which watermarks need, and set the watermark."""
    return stream.withColumn(ts, ref(ts).cast("timestamp")).withWatermark(ts, watermark)


def stream_window_counts(
    stream: DataFrame, fitted: Reference, ts: str, window: str, watermark: str, slide: str | None = None
) -> DataFrame:
    """Bin and category counts per window, emitted once the watermark has closed the window."""
    return window_counts(with_event_time(stream, ts, watermark), fitted.layout, ts, window, slide)


def stream_drift(
    stream: DataFrame, reference: DataFrame, ts: str, cols: list[str], window: str = "6 hours",
    watermark: str = "1 hour", slide: str | None = None, formula: str = "standard",
    sink: Callable[[DataFrame, int], None] | None = None,
) -> DataStreamWriter:
    """Drift of every closed window against a fixed reference, handed to ``sink(scores, batch_id)``.

    In append mode all counts of a window arrive in one micro-batch, so each batch scores whole
    windows. A replayed batch has the same id, so a sink that overwrites by id stays exact.
    """
    fitted = fit_reference(reference, cols, keep=True)
    counts = stream_window_counts(stream, fitted, ts, window, watermark, slide)

    def finish(batch: DataFrame, batch_id: int) -> None:
        if sink is None:
            return
        # read several times: without this the stateful plan would run for each
        held = batch.persist()
        try:
            sink(score_windows(held, fitted, formula), batch_id)
        finally:
            held.unpersist()

    return counts.writeStream.outputMode("append").foreachBatch(finish)


def stream_dedup(stream: DataFrame, keys: list[str], ts: str, watermark: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """One row for each key and event-time window.

    Which keys repeat is a matter of event time alone: it does not depend on how rows fall into micro-batches, and
    the watermark drops a window's state once it has passed.
    """
    # the window's start is the event time that the watermark follows: it is part of the key, so its state can go
    timed = stream.withColumn("_window", F.window(ref(ts).cast("timestamp"), window)["start"]).withWatermark("_window", watermark)
    return timed.dropDuplicates([*keys, "_window"]).drop("_window")


def stream_limit_breaches(
    stream: DataFrame, ts: str, key: list[str] | None = None, tokens: str = "tokens", watermark: str = "1 minute",
    requests_per_minute: int = 60, tokens_per_minute: int = 100_000,
) -> DataFrame:
    """Minutes over the request or token limit, once closed by the watermark."""
    timed = with_event_time(stream, ts, watermark)
    return limit_breaches(timed, ts, key, tokens, requests_per_minute, tokens_per_minute)


def stream_rate_limit(
    stream: DataFrame, key: str, ts: str, tie: str, requests_per_minute: int = DEFAULT_RATE, burst: int | None = None,
    watermark: str = "1 minute", groups: int = KEY_GROUPS,
) -> DataFrame:
    """``key, tie, ts_micros, allowed, retry_after, remaining`` with one token bucket of state per key.

    A micro-batch's rows are put in time order per key before they are replayed. Keys are dealt by hash into ``groups``,
    whose buckets are held and replayed together, as each call and state row has a cost of its own; the number must stay
    the same as long as a checkpoint is used.
    """
    full = (burst or requests_per_minute * BURST_FACTOR) * TOKEN
    rate = requests_per_minute
    forget_ms = max(IDLE_SECONDS * 1000, -(-full // rate) // 1000 + 1)
    fields = {f.name: f.dataType for f in stream.schema}
    output = T.StructType([
        T.StructField(key, T.StringType()), T.StructField(tie, fields[tie]), T.StructField("ts_micros", T.LongType()),
        T.StructField("allowed", T.BooleanType()), T.StructField("retry_after", T.DoubleType()),
        T.StructField("remaining", T.LongType()),
    ])
    state_schema = "names array<string>, units array<long>, lasts array<long>"

    def take(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, units, lasts = state.get if state.exists else ((), (), ())
        held = dict(zip(names, zip(units, lasts)))
        touched: dict[str | None, Bucket] = {}
        judged = []
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values(["ts_micros", tie])
            verdicts = []
            for name, now in zip(rows[key].tolist(), rows["ts_micros"].tolist()):
                bucket = touched.get(name)
                if bucket is None:
                    bucket = touched[name] = Bucket(full, rate, *held.get(name, (None, None)))
                verdicts.append(bucket.take(int(now), 1))
            allowed, wait, remaining = zip(*verdicts)
            judged = [rows[[key, tie, "ts_micros"]].assign(allowed=allowed, retry_after=wait, remaining=remaining)]
        mark = state.getCurrentWatermarkMs()
        # buckets without a request that the watermark has passed are forgotten
        kept = {n: (left, last) for n, (left, last) in held.items() if last // 1000 + forget_ms >= mark}
        kept.update((n, (int(b.left), int(b.last))) for n, b in touched.items())
        if kept:
            state.update((list(kept), [left for left, _ in kept.values()], [last for _, last in kept.values()]))
            state.setTimeoutTimestamp(max(mark + 1, min(last for _, last in kept.values()) // 1000 + forget_ms))
        else:
            state.remove()
        yield from judged

    # the key travels as text, as a whole number with nulls would lose digits in pandas
    timed = with_event_time(stream, ts, watermark).select(ref(key).cast("string").alias(key), ref(tie), ref(ts), micros(ref(ts)).alias("ts_micros"))
    dealt = timed.withColumn("_group", F.pmod(F.xxhash64(ref(key)), F.lit(groups)))
    out = dealt.groupBy("_group").applyInPandasWithState(
        take, output, state_schema, "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn(key, ref(key).cast(fields[key]))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process everything available now into Parquet at ``path`` and return it as a table."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
