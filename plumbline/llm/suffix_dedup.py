"""Removal of long repeated byte strings by external induced suffix sorting.

Every byte that lies in a string of ``size`` bytes which also starts elsewhere, in any document, goes.

A suffix array of a whole corpus would be many times the corpus, so only places that can matter are sorted:

1. Equal texts are one text with a count. If it has ``size`` bytes and a count of two, all of it goes.
2. Windows of ``size`` bytes are cut into runs that share a content-chosen anchor (``anchors``). Anchors that occur once
   in all texts are out: their windows can't repeat.
3. The stretches of text under the other runs ("contexts") meet by anchor. Equal contexts are one context with a count, before and after the
   shuffle, so a passage in a million documents is one row.
4. Whole anchor groups are put into blocks of about BLOCK bytes and each block is suffix-sorted by induced
   sorting with disk-backed bucket queues that carry common-prefix values (``induced``). Neighbours with a common prefix of ``size`` bytes
   are the repeats; counts decide whether a window occurs twice.
5. An anchor group of more than GROUP bytes of different contexts is not given to one task: its windows are fingerprinted one
   by one and counted by an ordinary shuffle.
6. Repeated windows go back to their texts, are merged into spans, and the bytes outside the spans are kept.

No step holds more than one document, one block or one partition's batch.

Cases: null counts as empty; texts shorter than ``size`` bytes are kept whole. Repeated ids and rows are copies of
their text. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.anchors import window_runs
from plumbline.llm.common import narrow, signed, written
from plumbline.llm.induced import suffixes

SIZE = 200
BLOCK = 2 << 20
GROUP = 8 << 20
SEEN = 200_000

_SPANS = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
_CONTEXT = "anchor long, context binary, key binary, first int, windows int, copies long, bytes binary"


def _key(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _spans(marked: np.ndarray) -> list[dict]:
    """Runs of set flags as (low, high), the end left out."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], marked.astype(np.int8), [0]))))
    return [{"low": a, "high": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


def _anchors(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for batch in batches:
            for low in range(0, len(batch), 500):
                part = batch.slice(low, 500)
                found = [signed(window_runs(np.frombuffer(t.as_buffer(), np.uint8), size)[0]) for t in part.column("text")]
                yield pa.record_batch([part.column("doc_id"), part.column("key"), pa.array(found, kind)], names=["doc_id", "key", "anchors"])

    return run


def _contexts(size: int):
    """The contexts of a text's listed runs. Bytes go along only with the first of equal contexts that a task meets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[tuple] = []
        size_held = 0

        def made() -> pa.RecordBatch:
            columns = list(zip(*held))
            held.clear()
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))],
                                   names=["anchor", "context", "key", "first", "windows", "copies", "bytes"])

        for batch in batches:
            for key, text, wanted, copies in zip(batch.column("key"), batch.column("text"), batch.column("runs"), batch.column("copies")):
                raw, key, copies = text.as_py(), key.as_py(), copies.as_py()
                anchors, first, count = window_runs(np.frombuffer(raw, np.uint8), size)
                at = np.sort(wanted.values.to_numpy(zero_copy_only=False))
                for anchor, low, n in zip(signed(anchors[at]).tolist(), first[at].tolist(), count[at].tolist()):
                    piece = raw[low : low + n + size - 1]
                    name = _key(piece)
                    held.append((anchor, name, key, low, n, copies, None if name in seen else piece))
                    size_held += 100 if name in seen else len(piece)
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(name)
                if size_held >= BLOCK:
                    yield made()
                    size_held = 0
        if held:
            yield made()

    return run


def repeated_windows(contexts: list[bytes], copies: list[int], size: int) -> list[np.ndarray]:
    """For each context a flag for every window: does it occur twice, counting each context ``copies`` times?"""
    lengths = np.array([len(c) for c in contexts], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    text = np.ones(int((lengths + 1).sum()) + 1, np.uint16)  # 1 parts contexts, 0 ends the text, bytes begin at 2
    valid = np.zeros(len(text), bool)
    weight = np.zeros(len(text), np.int64)
    for context, start, n in zip(contexts, starts.tolist(), copies):
        text[start : start + len(context)] = np.frombuffer(context, np.uint8).astype(np.uint16) + 2
        valid[start : start + len(context) - size + 1] = True
        weight[start : start + len(context) - size + 1] = n
    text[-1] = 0
    order, common = suffixes(text, size)
    group = np.cumsum(common < size)
    total = np.bincount(group, weights=weight[order])
    twice = np.zeros(len(text), bool)
    twice[order] = total[group] >= 2
    twice &= valid
    return [twice[s : s + n - size + 1] for s, n in zip(starts.tolist(), lengths.tolist())]


def _sorted_blocks(size: int):
    """Rows come in the order of their anchors; whole anchor groups make up a block."""
    def solve(held: list[tuple[bytes, int, bytes]]) -> pa.RecordBatch:
        flags = repeated_windows([b for _, _, b in held], [n for _, n, _ in held], size)
        return pa.record_batch([pa.array([c for c, _, _ in held], pa.binary()), pa.array([_spans(f) for f in flags], _SPANS)], names=["context", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, bytes]] = []
        total, current = 0, None
        for batch in batches:
            for anchor, context, copies, raw in zip(batch.column("anchor").to_pylist(), batch.column("context"), batch.column("copies").to_pylist(), batch.column("bytes")):
                if anchor != current and total >= BLOCK:
                    yield solve(held)
                    held, total = [], 0
                current = anchor
                held.append((context.as_py(), copies, raw.as_py()))
                total += len(held[-1][2])
        if held:
            yield solve(held)

    return run


def _window_keys(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for context, copies, raw in zip(batch.column("context"), batch.column("copies"), batch.column("bytes")):
                raw = raw.as_py()
                n = len(raw) - size + 1
                yield pa.record_batch([pa.array([context.as_py()] * n, pa.binary()), pa.array(range(n), pa.int32()), pa.array([copies.as_py()] * n, pa.int64()),
                                       pa.array([_key(raw[i : i + size]) for i in range(n)], pa.binary())], names=["context", "at", "copies", "window"])

    return run


def _cut(size: int):
    """Joins a text's repeated windows to spans of bytes and drops these; a text with copies goes whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept = [], []
            for text, copied, windows in zip(batch.column("text"), batch.column("copied").to_pylist(), batch.column("windows")):
                raw = text.as_py()
                if copied:
                    spans.append([{"low": 0, "high": len(raw)}])
                    kept.append(b"")
                elif not windows.is_valid:
                    spans.append([])
                    kept.append(raw)
                else:
                    pairs = windows.values
                    low = pairs.field("low").to_numpy(zero_copy_only=False).astype(np.int64)
                    high = pairs.field("high").to_numpy(zero_copy_only=False).astype(np.int64) + size - 1
                    depth = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(depth, low, 1)
                    np.add.at(depth, high, -1)
                    gone = np.cumsum(depth[:-1]) > 0
                    spans.append(_spans(gone))
                    kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), pa.array(spans, _SPANS), pa.array(kept, pa.binary())],
                                  names=["doc_id", "n_bytes", "spans", "kept"])

    return run


def _text_key(text):
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def repeated_spans(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """key, windows: for every text (doc_id, text in ``docs``) with repeats, unless it has copies, its ranges of repeated windows."""
    texts = docs.filter(F.octet_length("text") >= size).select("doc_id", _text_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text"))
    rows = written(texts.mapInArrow(_anchors(size), "doc_id long, key binary, anchors array<long>"))
    # one row bears a text for all its copies; it is chosen on narrow columns, so copies of texts are never sorted or made single
    distinct = rows.groupBy("key").agg(F.first("anchors").alias("anchors"), F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("bearer"))
    again = rows.select(F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    runs = distinct.select("key", "copies", F.col("bearer.doc_id").alias("bearer"), F.posexplode("anchors").alias("run", "anchor")).join(again, "anchor", "left_semi")
    wanted = runs.groupBy("key").agg(F.first("copies").alias("copies"), F.first("bearer").alias("bearer"), F.collect_list("run").alias("runs"))
    # rows of one id and text bear it twice; its contexts count as repeated either way
    bears = (F.col("key") == F.col("wanted_key")) & F.col("doc_id").eqNullSafe(F.col("bearer"))
    found = texts.join(wanted.withColumnRenamed("key", "wanted_key"), bears).mapInArrow(_contexts(size), _CONTEXT)
    found = written(found)
    # one row a context; max passes over the nulls of contexts whose bytes went before
    contexts = written(found.groupBy("context").agg(F.first("anchor").alias("anchor"), F.first("windows").alias("windows"), F.sum("copies").alias("copies"), F.max("bytes").alias("bytes")))
    groups = contexts.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(F.octet_length("bytes")).alias("size"))
    sized = contexts.join(groups, "anchor")
    whole = F.array(F.struct(F.lit(0).alias("low"), F.col("windows").alias("high")))
    alone = contexts.filter("copies > 1").select("context", whole.alias("spans"))
    n_blocks = 1 + (contexts.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0) // (4 * BLOCK)
    small = sized.filter((F.col("n") > 1) & (F.col("size") <= GROUP)).select("anchor", "context", "copies", "bytes")
    solved = small.repartition(n_blocks, "anchor").sortWithinPartitions("anchor").mapInArrow(
        _sorted_blocks(size), "context binary, spans array<struct<low: int, high: int>>")
    large = sized.filter(F.col("size") > GROUP).select("context", "copies", "bytes").mapInArrow(
        _window_keys(size), "context binary, at int, copies long, window binary")
    large = written(large)
    twice = large.groupBy("window").agg(F.sum("copies").alias("n")).filter("n > 1").select("window")
    counted = large.join(twice, "window", "left_semi").select("context", F.array(F.struct(F.col("at").alias("low"), (F.col("at") + 1).alias("high"))).alias("spans"))
    answers = written(alone.union(solved.filter(F.size("spans") > 0)).union(counted))
    per_text = found.filter("copies = 1").select("key", "first", "context").join(answers, "context").select(
        "key", F.explode(F.transform("spans", lambda s: F.struct((s["low"] + F.col("first")).alias("low"), (s["high"] + F.col("first")).alias("high")))).alias("w"))
    return per_text.groupBy("key").agg(F.collect_list("w").alias("windows"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges) and kept (remaining bytes), one row for each row of ``docs``."""
    texts = narrow(docs, id_col, text_col)
    keyed = texts.select("doc_id", "text", _text_key(F.col("text")).alias("key"), F.octet_length("text").cast("long").alias("n_bytes"))
    # texts with copies go whole; the others lose their windows
    copied = written(keyed.select("key", "n_bytes").filter(F.col("n_bytes") >= size).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"))
    windows = written(repeated_spans(texts, size))
    # the two are disjoint, so texts are joined once
    marks = windows.select("key", F.lit(False).alias("copied"), "windows").union(copied.select(
        "key", F.lit(True), F.lit(None).cast("array<struct<low: int, high: int>>")))
    marked = keyed.join(marks, "key", "left").select("doc_id", "n_bytes", F.col("text").cast("binary").alias("text"), "copied", "windows")
    return marked.mapInArrow(_cut(size), "doc_id long, n_bytes long, spans array<struct<low: int, high: int>>, kept binary")
