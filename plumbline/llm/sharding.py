"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points of a ring; a document belongs to the first point clockwise of its own place. A
shard takes no more rows than its capacity: documents that overflow a full shard continue clockwise
to the next shard with room. With no slack the capacities add up to the number of rows, so counts are at most one apart.
Only overflow moves, and each shard lets go the same share of all its arcs, so one more shard or more rows change few places.

How it runs: one pass writes ids, sizes, checksums and places. The ring is cut into pieces, at every virtual node and into
``cells`` equal slices. The driver sees only the row count of each piece (at most cells + shards * vnodes numbers,
whatever the table's size) and settles the overflow with them. Rows are then ranked inside their piece, and the broadcast list of
(piece, first rank, last rank, shard, first slot) gives shard and slot. No shard is gathered anywhere.

Cases: null text has size 1 and checksum 0. Null ids and repeated ids are placed by id and text together; rows equal in both
are told apart by their row number. Fewer rows than shards leave some shards empty. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import narrow, written

RING = 1 << 32
VNODES = 128
CELLS = 4096

Segment = tuple[int, int, int, int]  # piece, first rank, end rank, shard


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node in ring order."""
    def place(shard: int, node: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"shard {shard} node {node}".encode(), digest_size=4).digest(), "big")

    return sorted((place(s, v), s) for s in range(shards) for v in range(vnodes))


def edges(nodes: list[tuple[int, int]], cells: int = CELLS) -> list[int]:
    """Left edges of the ring's pieces; a piece [edge, next edge) lies inside one arc."""
    return sorted({0, *(place + 1 for place, _ in nodes if place + 1 < RING), *(i * RING // cells for i in range(cells))})


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    if slack > 0:
        return [int(-(-rows * (1 + slack) // shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def settle(counts: dict[int, int], nodes: list[tuple[int, int]], cuts: list[int], room: list[int]) -> list[Segment]:
    """Which ranks of each piece go to which shard, so that no shard exceeds its room."""
    places, room, placed = [p for p, _ in nodes], list(room), []
    moving = [(piece, 0, n, bisect_left(places, cuts[piece]) % len(nodes)) for piece, n in sorted(counts.items())]
    while moving:
        at: dict[int, list] = {}
        for flow in moving:
            at.setdefault(nodes[flow[3]][1], []).append(flow)
        over = []
        for shard, flows in sorted(at.items()):
            wanted, free = sum(end - low for _, low, end, _ in flows), room[shard]
            share = [(end - low) * free // wanted if wanted > free else end - low for _, low, end, _ in flows]
            spare = min(wanted, free) - sum(share)
            for i, (piece, low, end, node) in enumerate(flows):
                take = share[i]
                if spare and take < end - low:
                    take, spare = take + 1, spare - 1
                if take:
                    placed.append((piece, low, low + take, shard))
                if low + take < end:
                    over.append((piece, low + take, end, node))
            room[shard] -= min(wanted, free)
        moving = []
        for piece, low, end, node in over:
            for step in range(1, len(nodes) + 1):
                following = (node + step) % len(nodes)
                if room[nodes[following][1]]:
                    moving.append((piece, low, end, following))
                    break
            else:
                raise ValueError("the capacities are smaller than the number of rows")
    return placed


def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", vnodes: int = VNODES,
           cells: int = CELLS, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, home (the ring's own choice), shard and slot, one row for each row of ``docs``."""
    spark = docs.sparkSession
    nodes = ring(shards, vnodes)
    cuts = edges(nodes, cells)
    hashed = narrow(docs, id_col, text_col).select(
        "doc_id", (F.octet_length("text").cast("long") + 1).alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    hashed = hashed.withColumn("place", F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", "size"), 32).cast("double"))
    pieces = Bucketizer(splits=[float(c) for c in cuts] + [float(RING)], inputCol="place", outputCol="piece").transform(hashed)
    rows = written(pieces.withColumn("piece", F.col("piece").cast("int")).withColumn("row", F.monotonically_increasing_id()))
    counts = {r["piece"]: r["n"] for r in rows.groupBy("piece").agg(F.count("*").alias("n")).collect()}
    placed = settle(counts, nodes, cuts, capacities(sum(counts.values()), shards, slack))
    used, listed = [0] * shards, []
    places = [p for p, _ in nodes]
    for piece, low, end, shard in sorted(placed):
        home = nodes[bisect_left(places, cuts[piece]) % len(nodes)][1]
        listed.append((piece, low, end, shard, used[shard] - low, home))
        used[shard] += end - low
    segments = spark.createDataFrame(listed, "at int, low int, high int, shard int, base long, home int") if listed else \
        spark.createDataFrame([], "at int, low int, high int, shard int, base long, home int")
    rank = F.row_number().over(W.partitionBy("piece").orderBy("place", "doc_id", "text_crc32", "row")) - 1
    ranked = rows.withColumn("rank", rank)
    return ranked.join(F.broadcast(segments), (F.col("piece") == F.col("at")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).select(
        "doc_id", "size", "text_crc32", "home", "shard", (F.col("base") + F.col("rank")).alias("slot"))
