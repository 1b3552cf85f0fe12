"""Helpers shared by the training-data operators: narrow inputs, written intermediates, byte-level hashing."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.columns import ref
from plumbline.session import written

__all__ = ["MASK", "graph_components", "keep_rows", "mix", "narrow", "slices_of", "table", "text_bytes", "word_hashes", "written"]

MASK = (1 << 64) - 1
SLICE = 1 << 19
_P = 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null becomes empty), whatever else the table holds."""
    return docs.select(ref(id_col).cast("long").alias("doc_id"), F.coalesce(ref(text_col), F.lit("")).alias("text"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and the n + 1 offsets of its rows, without a copy."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def slices_of(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``size`` bytes; a longer row is a run by itself."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = _P) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i below n."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        steps = np.full(n, b, np.uint64)
        steps[:1] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def cached_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0][0]) < n:
        _POWERS[:] = [powers(max(n, SLICE + 1))]
    return _POWERS[0]


PRIME = (1 << 31) - 1
_BASE = 0x4B1D2C3F


def prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE^i and _BASE^-i modulo PRIME for i below n."""
    out = []
    for b in (_BASE, pow(_BASE, -1, PRIME)):
        steps = np.ones(n, np.uint64)
        done = 1
        while done < n:
            more = min(done, n - done)
            steps[done : done + more] = steps[:more] * np.uint64(pow(b, done, PRIME)) % np.uint64(PRIME)
            done += more
        out.append(steps)
    return out[0], out[1]


_PRIME_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def cached_prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _PRIME_POWERS or len(_PRIME_POWERS[0][0]) < n:
        _PRIME_POWERS[:] = [prime_powers(max(n, SLICE + 1))]
    return _PRIME_POWERS[0]


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _hash_block(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw)
    inside = ~SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    edge[n] = True
    before = np.concatenate(([False], inside[:-1]))
    begin = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.concatenate((inside[1:], [False]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return begin, _hash_spans(raw, begin, end)


def _hash_spans(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(raw)
    power, inverse = cached_powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    length = (end - begin).astype(np.uint64)
    # sums modulo 2^64 agree for some long words of two letters, whatever the base; a second sum modulo a prime tells them apart
    power31, inverse31 = cached_prime_powers(n)
    terms = (_LOWER[raw].astype(np.uint64) + np.uint64(1)) * power31[:n]
    total31 = np.zeros(n + 1, np.uint64)
    np.cumsum(terms if n < 1 << 23 else terms % np.uint64(PRIME), out=total31[1:])
    second = (total31[end] - total31[begin]) % np.uint64(PRIME) * inverse31[begin] % np.uint64(PRIME)
    return mix((total[end] - total[begin]) * inverse[begin] + length * np.uint64(0xD6E8FEB86659FD93) + mix(second))


def span_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from ``begin`` to ``end``, both ascending, A-Z lower-cased; block by block, so memory stays bounded by the block or the longest span."""
    out = np.zeros(len(begin), np.uint64)
    low = 0
    while low < len(begin):
        base = int(begin[low])
        high = max(low + 1, int(np.searchsorted(end, base + SLICE, side="right")))
        out[low:high] = _hash_spans(raw[base : end[high - 1]], begin[low:high] - base, end[low:high] - base)
        low = high
    return out


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) of consecutive rows.

    Returns the hashes of all rows in order and the n + 1 offsets of the rows in them. Rows of any
    length are hashed in blocks that end at white space, so memory stays bounded by the block.
    """
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    base = int(offsets[0])
    if int(offsets[-1]) - base <= 2 * SLICE:
        data, starts = raw[base : offsets[-1]], offsets[:-1] - base
        if not len(data):
            return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        begin, hashed = _hash_block(data, starts[starts < len(data)])
        at = np.concatenate((np.searchsorted(begin, starts), [len(begin)]))
        return hashed, at
    for row in range(len(offsets) - 1):
        low, high = int(offsets[row]), int(offsets[row + 1])
        while low < high:
            stop = min(low + SLICE, high)
            if stop < high:
                gap = np.flatnonzero(SPACE[raw[low:stop]])
                if len(gap):
                    stop = low + int(gap[-1]) + 1
                else:  # a word longer than a block: up to its end
                    more = np.flatnonzero(SPACE[raw[stop:high]])
                    stop = stop + int(more[0]) + 1 if len(more) else high
            _, hashed = _hash_block(raw[low:stop], np.zeros(1, np.int64))
            hashes.append(hashed)
            counts[row] += len(hashed)
            low = stop
    out = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return out, np.concatenate(([0], np.cumsum(counts)))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over edges (u, v): every node's kept neighbours move to the smallest of them."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.filter(F.col("v") <= F.col("u")) if small else both
    low = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    moved = near.join(low, F.col("u") == F.col("w"))
    if small:
        out = moved.filter("v != m").select("v", "m").union(low.filter("w != m").select("w", "m")).toDF("u", "v")
    else:
        out = moved.filter("v > u").select("v", "m").filter("v != m").toDF("u", "v")
    return out.distinct()


def graph_components(edges: DataFrame) -> DataFrame:
    """(u, v): every node u that is not the smallest of its component, and that smallest node v.

    ``edges`` has columns u and v of one ordered type. Alternates large-star and small-star steps, each
    round written to the shared folder, until the edges stay the same; no node's edges are ever gathered.
    """
    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.hash("u", "v"))).first())

    now = written(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    was = mark(now)
    while was[0]:
        now = written(_star(_star(now, small=False), small=True))
        is_ = mark(now)
        if is_ == was:
            break
        was = is_
    return now


_HELD: dict = {}


def release() -> None:
    """Drops what earlier stages left in this worker and hands its memory back to the system.

    Workers outlive a stage, so without this the caches of all stages of a job add up in one executor.
    """
    if _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":  # freed blocks of many small objects stay with the C library until it is told
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)


def held(key: tuple, make: Callable):
    """``make()``, kept by this worker until it needs something else."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def fresh(name: str, df: DataFrame) -> str:
    """``name``, made longer until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_rows(docs: DataFrame, keys: DataFrame, all_keys: DataFrame, hashed: Column, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose (id, hash) is in ``keys``, one row for each key, with the columns of ``docs``.

    ``all_keys`` has the pair of every row. Only if some pair is there twice are the chosen rows made single.
    """
    kept_id, kept_hash, row_hash = (fresh(name, docs) for name in ("kept_id", "kept_hash", "row_hash"))
    wanted = keys.toDF(kept_id, kept_hash)
    marked = docs.withColumn(row_hash, hashed)
    same = ref(id_col).cast("long").eqNullSafe(F.col(kept_id)) & (F.col(row_hash) == F.col(kept_hash))
    kept = marked.join(wanted, same, "left_semi")
    repeated = all_keys.groupBy(*all_keys.columns).agg(F.count("*").alias("n")).filter("n > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates([id_col, row_hash])
    return kept.select(*(ref(c) for c in docs.columns))
