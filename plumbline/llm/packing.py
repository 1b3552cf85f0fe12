"""Best-fit packing of tokenised documents into sequences by hierarchical residual packing.

Each partition encodes its documents, cuts those longer than a sequence, and packs the pieces best-fit, largest
first. Bins with at most NEAR tokens free are emitted. The underfull bins are the items of the next round, in
FAN_IN times fewer partitions, and so on up a tree, so what one partition lacks another one fills. Only residual bins
travel. A task takes at most TASK_PIECES pieces, and if a round of several tasks no longer shrinks
the residue, its bins are emitted as they are: nothing is ever gathered that does not fit.

Every round's bins are written to the shared folder before they are used, so a lost executor can't pack a piece twice.

Cases: null and empty texts are one piece of the end id. Repeated rows are packed as often as they occur. An
empty table gives no rows. A document of exactly the sequence length is one full piece. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import narrow, written
from plumbline.llm.tokens import vocabulary_path, words

LENGTH = 4096
END = 1
NEAR = 4
FAN_IN = 8
TASK_PIECES = 400_000

_PIECE = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
_MEMBERS = pa.list_(pa.struct(_PIECE))
_BINS = "sequence_id long, closed boolean, fill int, members array<struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long>>"
Piece = tuple
Bin = list  # [fill, pieces]


def best_fit(items: list[Bin], length: int) -> list[Bin]:
    """Items, themselves bins, put together best-fit with the largest first. Free sizes are bits of one integer."""
    bins: list[Bin] = []
    by_free: dict[int, list[int]] = {}
    open_sizes = 0
    for fill, pieces in sorted(items, key=lambda b: -b[0]):
        fitting = open_sizes >> fill
        if fitting:
            free = fill + (fitting & -fitting).bit_length() - 1
            at = by_free[free].pop()
            if not by_free[free]:
                open_sizes ^= 1 << free
            bins[at][0] += fill
            bins[at][1] = bins[at][1] + pieces
            free -= fill
        else:
            at, free = len(bins), length - fill
            bins.append([fill, pieces])
        if free:
            waiting = by_free.setdefault(free, [])
            if not waiting:
                open_sizes |= 1 << free
            waiting.append(at)
    return bins


def _emit(bins: list[Bin], level: int, first: int, length: int, last: bool) -> Iterator[pa.RecordBatch]:
    base = (level << 54) | (TaskContext.get().partitionId() << 32)
    for low in range(0, len(bins), 2000):
        part = bins[low : low + 2000]
        yield pa.record_batch(
            [pa.array([base + first + low + i for i in range(len(part))], pa.int64()),
             pa.array([last or fill >= length - NEAR for fill, _ in part], pa.bool_()),
             pa.array([fill for fill, _ in part], pa.int32()),
             pa.array([[dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), p)) for p in pieces] for _, pieces in part], _MEMBERS)],
            names=["sequence_id", "closed", "fill", "members"])


def _packed(items: Iterator[Bin], level: int, length: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Packs blocks of at most TASK_PIECES pieces, so a task's memory does not follow its input."""
    held: list[Bin] = []
    pieces = made = 0
    for item in items:
        held.append(item)
        pieces += len(item[1])
        if pieces >= TASK_PIECES:
            bins = best_fit(held, length)
            yield from _emit(bins, level, made, length, last)
            made, held, pieces = made + len(bins), [], 0
    yield from _emit(best_fit(held, length), level, made, length, last)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, length: int) -> Iterator[Bin]:
    encode = words(path).encode
    end = END.to_bytes(4, "little")
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            ids = encode(text.as_py()) + end
            for number, at in enumerate(range(0, len(ids), 4 * length)):
                cut = ids[at : at + 4 * length]
                yield [len(cut) // 4, [(doc_id, number, at // 4, len(cut) // 4, zlib.crc32(cut))]]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset, one row a piece."""
    path = vocabulary or vocabulary_path()
    texts = narrow(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))

    def first(batches):
        return _packed(_pieces(batches, path, length), 0, length, last=False)

    bins = written(texts.mapInArrow(first, _BINS))
    closed = [bins.filter("closed")]
    tasks, level, before = None, 0, None
    while True:
        residue = bins.filter("not closed")
        n, pieces = residue.agg(F.count("*"), F.coalesce(F.sum(F.size("members")), F.lit(0))).first()
        if not n:
            break
        level += 1
        tasks = max(1, -(-pieces // TASK_PIECES), 1 if tasks is None and n <= TASK_PIECES // FAN_IN else ((tasks or residue.rdd.getNumPartitions()) // FAN_IN))
        last = tasks == 1 or (before is not None and n > 0.95 * before)
        before = n

        def merge(batches, level=level, last=last):
            items = ([fill, [tuple(m.values()) for m in members]] for batch in batches
                     for fill, members in zip(batch.column("fill").to_pylist(), batch.column("members").to_pylist()))
            return _packed(items, level, length, last)

        bins = written(residue.repartition(tasks).mapInArrow(merge, _BINS))
        closed.append(bins.filter("closed"))
    out = closed[0]
    for more in closed[1:]:
        out = out.union(more)
    lengths = F.transform("members", lambda m: m["length"])
    flat = out.select("sequence_id", F.posexplode("members").alias("at", "m"), lengths.alias("lengths"))
    before_it = F.aggregate(F.slice("lengths", F.lit(1), F.col("at")), F.lit(0).cast("long"), lambda a, x: a + x)
    return flat.select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", before_it.alias("offset"))
