"""Tables about files: manifest and storage size."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import md5
from plumbline.functions.rules import extension_of

# Files up to this many bytes are hashed as one cell each, larger ones split by split.
WHOLE = 128 * 1024 * 1024
# Spark's line reader unpacks files with these endings, so their own bytes are only read whole.
PACKED = r"(?i)[.](gz|bz2|deflate|lz4|snappy|zst|passthrough)$"
# Spark's line reader passes over these bytes at the beginning of a file.
MARK = b"\xef\xbb\xbf"

# MIME type by extension.
MIME_TYPES = {
    ".csv": "text/csv",
    ".json": "application/json",
    ".parquet": "application/octet-stream",
    ".pkl": "application/octet-stream",
    ".joblib": "application/octet-stream",
    ".html": "text/html",
    ".pdf": "application/pdf",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".py": "text/x-python",
    ".yaml": "text/yaml",
    ".yml": "text/yaml",
    ".txt": "text/plain",
    ".md": "text/markdown",
}
OTHER_MIME = "application/octet-stream"


def mime_type(path):
    pairs = [F.lit(x) for pair in MIME_TYPES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), extension_of(path)), F.lit(OTHER_MIME))


def _joined(batches):
    """The lines of a split, in their order, as few cells."""
    for batch in batches:
        if not batch.num_rows:
            continue
        uris, starts = batch.column(0), batch.column(1).to_numpy()
        files = uris.dictionary_encode().indices.to_numpy()
        lines = batch.column(2).cast(pa.large_binary())
        at = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset: lines.offset + len(lines) + 1]
        edges = [0, *(np.flatnonzero((np.diff(starts) != 0) | (np.diff(files) != 0)) + 1).tolist(), len(lines)]
        data = lines.buffers()[2]
        first = pa.array(edges[:-1])
        cells = [data[at[x]: at[y]].to_pybytes() for x, y in zip(edges, edges[1:])]
        yield pa.RecordBatch.from_arrays([uris.take(first), batch.column(1).take(first), pa.array(cells, pa.binary())], ["uri", "start", "data"])


def _lengths(part, rows):
    """Bytes of each split of a partition."""
    lengths = defaultdict(int)
    for uri, start, data in rows:
        lengths[uri, start] += len(data)
    return [(uri, start, part, n) for (uri, start), n in lengths.items()]


def _went_on(states):
    """States of the files after their next split; ``states`` maps (file, split) to the state before and the file's size."""
    def run(rows):
        after = {}
        for uri, start, data in rows:
            if (uri, start) in states:
                state, size = states[uri, start]
                state = after.get(uri, state)
                # a line feed was put after the last line too
                after[uri] = md5.update(state, data[:size - state[2]])
        return after.items()

    return run


def _checksums(spark: SparkSession, files: list) -> dict[str, str]:
    """MD5 by URI of the given large files, split by split.

    The bytes come from Spark's line reader, whose splits lie end to end; they are read once and kept on the executors' disks.
    An MD5 is one chain, so each round takes the next split of every file, and only the state (some 100 bytes a file) goes
    from one round to the next. A file whose lines don't add up to its size is left out.
    """
    # names are taken as they are, not as patterns
    names = [re.sub(r"([\\*?\[\]{}])", r"\\\1", f.path) for f in files]
    lines = spark.read.option("lineSep", "\n").text(names)
    pieces = lines.select(
        F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("start"),
        F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("data"),
    ).mapInArrow(_joined, "uri string, start long, data binary").rdd.persist(StorageLevel.DISK_ONLY)
    try:
        return _chained(pieces, {f.uri: f.size_bytes for f in files})
    finally:
        pieces.unpersist()


def _chained(pieces, sizes: dict[str, int]) -> dict[str, str]:
    splits = defaultdict(list)
    for uri, start, part, n in pieces.mapPartitionsWithIndex(_lengths).collect():
        splits[uri].append((start, part, n))
    states = {}
    for uri, found in splits.items():
        missing = sizes[uri] - sum(n for *_, n in found)
        if missing in (0, -1):
            states[uri] = md5.START
        elif missing in (len(MARK), len(MARK) - 1):
            states[uri] = md5.update(md5.START, MARK)
        found.sort(reverse=True)
    left = {uri: splits[uri] for uri in states}
    while left:
        turn = {uri: found.pop() for uri, found in left.items()}
        before = {(uri, start): (states[uri], sizes[uri]) for uri, (start, _, _) in turn.items()}
        parts = sorted({part for _, part, _ in turn.values()})
        states.update(pieces.context.runJob(pieces, _went_on(before), parts))
        left = {uri: found for uri, found in left.items() if found}
    return {uri: md5.hexdigest(state) for uri, state in states.items()}


def file_manifest(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, name, size_bytes, mime_type, checksum`` of every file (MD5 of its bytes).

    Spark's file source passes over empty files, so they are not listed. Files above ``WHOLE`` bytes are hashed when this is
    called; packed ones (``PACKED``) still go through one cell, which ends at 2 GB.
    """
    files = spark.read.format("binaryFile").load(paths)
    uri = F.col("_metadata.file_path")
    listed = [
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size_bytes"),
        mime_type(F.col("path")).alias("mime_type"),
    ]
    large = files.filter(F.col("_metadata.file_size") > WHOLE).select(*listed, uri.alias("uri"))
    chained = large.filter(~F.col("path").rlike(PACKED)).select("path", "uri", "size_bytes").distinct().collect()
    sums = _checksums(spark, chained) if chained else {}
    if not sums:
        return files.select(*listed, F.md5("content").alias("checksum"))
    whole = files.filter(~uri.isin(list(sums))).select(*listed, F.md5("content").alias("checksum"))
    made = spark.createDataFrame(list(sums.items()), "uri string, checksum string")
    return whole.unionByName(large.join(F.broadcast(made), "uri").drop("uri"))


def storage_stats(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row ``files, total_bytes``: bytes on disk, from file lengths only."""
    files = spark.read.format("binaryFile").load(paths).select("length")
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"))
