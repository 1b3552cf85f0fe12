"""Token-bucket audit: would each request have been allowed?

Time is whole microseconds and a token is 60,000,000 units, so a rate per minute refills a whole
number of units per microsecond and results repeat exactly.

Requests are range-partitioned by (key, time), so a busy key is cut into slices that are replayed in
parallel. A slice's outcome depends on the slice before it only through the units left there, unless
a pause long enough to fill the bucket lies between. Starting units are first predicted, then every
slice is replayed from its predecessor's result until all of them agree, which makes them exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.columns import ref
from plumbline.operators.ranks import PART
from plumbline.session import materialize

TOKEN = 60_000_000  # units per token
# Requests per minute, and the burst as a multiple of it.
DEFAULT_RATE = 60
BURST_FACTOR = 2


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


class Bucket:
    """One bucket: units left and the time they were counted."""

    def __init__(self, full: int, rate: int, left: int | None = None, last: int | None = None):
        self.full, self.rate, self.last = full, rate, last
        self.left = full if left is None else left
        self.filled = False  # was it full again at some request after the first?
        self.lowest = full  # fewest units left after any request
        self.refused = False

    def take(self, now: int, cost: int) -> tuple[bool, float, int]:
        """Allowed or not, seconds to wait if not, whole tokens remaining."""
        if self.last is not None and now > self.last:
            self.left = min(self.full, self.left + (now - self.last) * self.rate)
            self.filled = self.filled or self.left == self.full
        self.last = now if self.last is None else max(now, self.last)
        need = cost * TOKEN
        if self.left >= need:
            self.left -= need
            self.lowest = min(self.lowest, self.left)
            return True, 0.0, self.left // TOKEN
        self.refused = True
        return False, (need - self.left) / self.rate / 1_000_000, self.left // TOKEN


@dataclass
class Slice:
    """What a replay found out about one range partition."""

    first_key: object
    last_key: object
    first_us: int
    last_us: int
    whole: bool  # one key and no filling pause: the end depends on the start
    filled: bool  # the bucket was full again on the way
    refused: bool
    lowest: int
    ends: dict[int, int]  # units at the end by units at the first request

    def predicted(self, start: int, full: int) -> int:
        """End units from a start not replayed yet.

        A bucket that fills up on the way forgets its start, one that never runs dry stays as far
        behind as it began, and one that does keeps only the fraction of a token.
        """
        if start in self.ends:
            return self.ends[start]
        end = self.ends[full]
        if self.filled:
            return end
        if not self.refused and self.lowest >= full - start:
            return end - (full - start)
        return (end - end % TOKEN if self.refused else 0) + (end + start) % TOKEN


def _replay(
    batches: Iterator[pa.RecordBatch], key: str, full: int, rate: int, starts: dict[int, tuple[int, int]]
) -> Iterator[tuple[pa.RecordBatch, list[tuple], dict]]:
    """Each batch with its verdicts and the state of its partition so far; rows come sorted.

    Values are read from Arrow as they are, so large or missing whole-number keys stay exact.
    """
    pause = -(-full // rate)
    part, who, bucket, facts = None, None, Bucket(full, rate), {}
    for batch in batches:
        verdicts = []
        for p, k, now, price in zip(*(batch.column(c).to_pylist() for c in (PART, key, "_us", "_cost"))):
            k = None if k != k else k
            if p != part:
                part, who = p, k
                bucket = Bucket(full, rate, *starts.get(p, (None, None)))
                facts = {"part": p, "first_key": k, "first_us": now, "whole": True}
            elif k != who or now - bucket.last >= pause:
                who, bucket = k, Bucket(full, rate)
                facts["whole"] = False
            verdicts.append(bucket.take(now, price))
            facts.update(last_key=k, last_us=now, left=bucket.left, filled=bucket.filled,
                         refused=bucket.refused, lowest=bucket.lowest)
        yield batch, verdicts, facts


def _starts(slices: dict[int, Slice], full: int, rate: int) -> tuple[dict[int, tuple[int, int]], list[int]]:
    """Units each continued slice has at its first request, and the slices not yet replayed from there."""
    starts, unproven = {}, []
    before, left = None, full
    for part in sorted(slices):
        now = slices[part]
        start = full
        if before is not None and before.last_key == now.first_key:
            start = min(full, left + (now.first_us - before.last_us) * rate)
            starts[part] = (start, now.first_us)
        if now.whole and start not in now.ends:
            unproven.append(part)
        before, left = now, now.predicted(start if now.whole else full, full)
    return starts, unproven


def rate_limit_audit(
    df: DataFrame, key: str, ts: str, tie: list[str], requests_per_minute: int = DEFAULT_RATE,
    burst: int | None = None, cost: str | None = None, partitions: int | None = None,
) -> DataFrame:
    """Adds ``allowed, retry_after, remaining`` to each request. ``ts`` with ``tie`` must be unique per key.

    Only one row per range partition reaches the driver.
    """
    full = (burst or requests_per_minute * BURST_FACTOR) * TOKEN
    rate = requests_per_minute
    price = F.lit(1) if cost is None else ref(cost)
    timed = df.withColumns({"_us": micros(ref(ts)), "_cost": price.cast("bigint")})
    place = [ref(key), F.col("_us"), *[ref(c) for c in tie]]
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = materialize(timed.repartitionByRange(n, *place).withColumn(PART, F.spark_partition_id()))
    key_type = df.schema[key].dataType
    fact_schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("first_key", key_type), T.StructField("last_key", key_type),
        T.StructField("first_us", T.LongType()), T.StructField("last_us", T.LongType()),
        T.StructField("whole", T.BooleanType()), T.StructField("filled", T.BooleanType()),
        T.StructField("refused", T.BooleanType()), T.StructField("lowest", T.LongType()), T.StructField("left", T.LongType()),
    ])

    arrow_facts = to_arrow_schema(fact_schema)

    def facts_of(rows: DataFrame, starts: dict[int, tuple[int, int]]) -> list:
        def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, dict] = {}
            for _, _, facts in _replay(batches, key, full, rate, starts):
                if facts:
                    found[facts["part"]] = dict(facts)
            if found:
                yield pa.RecordBatch.from_pylist(list(found.values()), arrow_facts)

        slim = rows.select(PART, ref(key), "_us", "_cost", *[ref(c) for c in tie if c not in (key, "_us")])
        return slim.sortWithinPartitions(PART, *place).mapInArrow(summarize, fact_schema).collect()

    slices = {r.part: Slice(r.first_key, r.last_key, r.first_us, r.last_us, r.whole, r.filled, r.refused, r.lowest,
                            {full: r.left})
              for r in facts_of(spread, {})}
    starts, unproven = _starts(slices, full, rate)
    while unproven:  # each round proves at least the first slice of every chain
        again = {p: starts[p] for p in unproven}
        for r in facts_of(spread.filter(F.col(PART).isin(unproven)), again):
            slices[r.part].ends[again[r.part][0]] = r.left
        starts, unproven = _starts(slices, full, rate)

    schema = T.StructType([
        *df.schema.fields, T.StructField("allowed", T.BooleanType()),
        T.StructField("retry_after", T.DoubleType()), T.StructField("remaining", T.LongType()),
    ])
    kept = df.columns

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, verdicts, _ in _replay(batches, key, full, rate, starts):
            allowed, wait, remaining = zip(*verdicts) if verdicts else ((), (), ())
            added = [pa.array(allowed, pa.bool_()), pa.array(wait, pa.float64()), pa.array(remaining, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *added], names=schema.names)

    return spread.sortWithinPartitions(PART, *place).mapInArrow(judge, schema)
