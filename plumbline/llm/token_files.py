"""Token ids in files of directly addressable codes.

An id is split into chunks of eight bits. Level 0 holds the lowest chunk of every id; an id that needs more has
its continuation bit set, and its next chunk stands in level 1, at the place that the rank of the bit tells, and
so on. A rank directory with the count before every BLOCK bits makes that rank one lookup and one popcount of at
most BLOCK bits, so any id is read with a few short reads, without decoding a block.

Layout of a file, all little-endian:

    8 bytes   magic
    4 x u64   levels, ids, documents, size of the header with the section table
    sections  (offset, bytes) as u64 for: doc ids, doc has-id flags, doc ends, then per level chunks, bits, ranks

Documents are range-partitioned by id and written in ascending order; a task writes files of about FILE_IDS ids
under names of its own attempt, and only files in the written manifest count, so lost tasks do no harm. Files are
opened through Arrow's filesystem layer at the URI of the shared folder.

Cases: null and empty texts hold the end id only. Null ids come first. Rows that repeat an id are ordered by their text's hash.
An empty table gives no files and no rows. Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import narrow, written
from plumbline.llm.tokens import vocabulary_path, words
from plumbline.session import shared_dir

MAGIC = b"DACIDS01"
END = 2
FILE_IDS = 4_000_000
BLOCK = 512


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def dac_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks, packed continuation bits and rank directory of each level."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate((bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)))
        per_block = np.add.reduceat(np.bitwise_count(bits).astype(np.uint64), np.arange(0, len(bits), BLOCK // 8)) if len(bits) else np.zeros(0, np.uint64)
        ranks = np.concatenate(([0], np.cumsum(per_block))).astype("<u8")
        out.append(((rest & 255).astype(np.uint8), bits, ranks))
        rest = rest[more] >> 8
        if not len(rest):
            return out


def to_bytes(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> bytes:
    levels = dac_levels(ids)
    sections = [np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is not None for d in doc_ids], np.uint8), ends.astype("<i8")]
    for level in levels:
        sections += level
    head = 8 + 32 + 16 * len(sections)
    at, where = head, []
    for s in sections:
        where += [at, s.nbytes]
        at += s.nbytes
    return b"".join([MAGIC, np.array([len(levels), len(ids), len(doc_ids), head], "<u8").tobytes(), np.array(where, "<u8").tobytes(),
                     *(s.tobytes() for s in sections)])


class TokenFile:
    """A file opened for reading: whole documents, or any single id by short reads."""

    def __init__(self, handle) -> None:
        self.handle = handle
        head = self._read(0, 40)
        if head[:8] != MAGIC:
            raise ValueError("not a token file")
        self.levels, self.n_ids, self.n_docs, size = (int(x) for x in np.frombuffer(head[8:], "<u8"))
        self.where = np.frombuffer(self._read(40, size - 40), "<u8").reshape(-1, 2).astype(int)

    def _read(self, at: int, n: int) -> bytes:
        self.handle.seek(at)
        return self.handle.read(n)

    def _section(self, k: int, kind: str) -> np.ndarray:
        return np.frombuffer(self._read(*map(int, self.where[k])), kind)

    def __getitem__(self, i: int) -> int:
        """The id at place ``i``: for every level one chunk, one directory entry and one block of bits at most."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            chunks, bits, ranks = (int(self.where[3 + 3 * level + k][0]) for k in range(3))
            value |= self._read(chunks + i, 1)[0] << (8 * level)
            block, inside = divmod(i, BLOCK)
            held = np.unpackbits(np.frombuffer(self._read(bits + block * BLOCK // 8, BLOCK // 8), np.uint8), bitorder="little")
            if not held[inside]:
                break
            i = int.from_bytes(self._read(ranks + 8 * block, 8), "little") + int(held[:inside].sum())
        return value

    def ids(self) -> np.ndarray:
        """All ids, by scattering each level's chunks to the places its parent's bits name."""
        out = np.zeros(self.n_ids, np.uint32)
        places = np.arange(self.n_ids)
        for level in range(self.levels):
            chunks, bits = self._section(3 + 3 * level, np.uint8), self._section(4 + 3 * level, np.uint8)
            out[places] |= chunks.astype(np.uint32) << np.uint32(8 * level)
            places = places[np.unpackbits(bits, bitorder="little")[: len(places)].astype(bool)]
        return out

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc id, start in this file, ids) of every document."""
        doc_ids, known, ends, ids = self._section(0, "<i8").tolist(), self._section(1, np.uint8), self._section(2, "<i8").tolist(), self.ids()
        for k, (doc_id, start, end) in enumerate(zip(doc_ids, [0, *ends[:-1]], ends)):
            yield (doc_id if known[k] else None), start, ids[start:end]


def write_token_files(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Writes the files under ``folder`` and returns the manifest: path, part, file, n_docs, n_ids, start."""
    folder = folder or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    path = vocabulary or vocabulary_path()
    texts = narrow(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("tie"))
    ordered = texts.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = words(path).encode, END.to_bytes(4, "little")
        part, names = TaskContext.get().partitionId(), uuid.uuid4().hex
        filesystem, root = _open(folder)
        filesystem.create_dir(root, recursive=True)
        doc_ids: list[int | None] = []
        held: list[bytes] = []
        size = files = 0

        def flush() -> pa.RecordBatch:
            ends = np.cumsum([len(b) // 4 for b in held])
            name = f"part-{part:06d}-{files:05d}-{names}.dac"
            with filesystem.open_output_stream(f"{root}/{name}") as out:
                out.write(to_bytes(doc_ids, ends, np.frombuffer(b"".join(held), "<u4")))
            return pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([part], pa.int32()), pa.array([files], pa.int32()),
                                    pa.array([len(doc_ids)], pa.int64()), pa.array([size], pa.int64())], names=["path", "part", "file", "n_docs", "n_ids"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = encode(text.as_py()) + end
                doc_ids.append(doc_id)
                held.append(ids)
                size += len(ids) // 4
                if size >= FILE_IDS:
                    yield flush()
                    doc_ids, held, size, files = [], [], 0, files + 1
        if held:
            yield flush()

    manifest = written(ordered.mapInArrow(write, "path string, part int, file int, n_docs long, n_ids long"))
    # starts: sums of whole parts first, so no window holds more than the parts or one part's files
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(W.partitionBy("part").orderBy("file")) - F.col("n_ids")
    return manifest.withColumn("inside", inside).join(parts, "part").select(
        "path", "part", "file", "n_docs", "n_ids", (F.col("before") + F.col("inside")).alias("start"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the manifest's files."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                filesystem, name = _open(path)
                with filesystem.open_input_file(name) as handle:
                    rows = [(d, base + s, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, s, ids in TokenFile(handle).documents()]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.repartition("path").select("path", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
