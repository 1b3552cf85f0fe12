"""Exact top-k search by inner product with norm-bucketed retrieval.

Vectors are ranged by falling length and cut into buckets of BUCKET vectors, so a bucket's vectors are about equally long. With a lower bound
for a query's k-th best score, a bucket's greatest length gives the cosine that a vector needs there to matter (the local threshold):

- above 1: the bucket is passed over for this query;
- below the bucket's turning point: length pruning. Only the bucket's leading vectors are long enough;
- from the turning point on: coordinate pruning. A vector can only reach the cosine if its share in each of the query's FOCUS largest coordinates lies in a
  range around the query's; the ranges are looked up in the bucket's sorted coordinates and met.

What is left is verified by exact products. A bucket's turning point is the smallest threshold of a grid at which the ranges of a few of its queries leave less than TURN of its vectors.

How it runs: buckets are dealt to parts of PART buckets. Every part meets every block of BLOCK queries in one task (the query set
is stated, and grows with the table): blocks are copied once per part, arrive behind the part's buckets and pass by one at a
time, so a task holds one part and one block. Before that, every query is scored against the longest bucket, whose k-th best score bounds
what can still matter anywhere. A part answers with at most k rows a query; the best k of these are the result.

Scores are exact integers: sums below 2^53 are added as doubles, larger ones as whole numbers without bound; a score beyond 64 bits is an error.

Cases: vectors that are null, or hold null or non-finite components (also after scaling), and rows with a null id take no part. Vectors of different dimensions are
never compared; those of dimension 0 score 0. Repeated ids are rows of their own; a row is never its own candidate, but
another row of the same id is. Ties go to the smaller id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.columns import ref
from plumbline.llm.common import written

BUCKET = 2048
BLOCK = 1024
PART = 32
FOCUS = 3
TURN = 0.25
GRID = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)
TUNED = 8
COMPONENTS = 1 << 18  # the most that one bucket or block holds: with wide vectors it holds fewer of them

_KEPT = ("dim", "n", "ids", "rows", "data")
_PACKED = "dim int, n int, longest double, ids binary, rows binary, data binary"


@dataclass
class Bucket:
    """Vectors of one dimension, longest first."""

    ids: np.ndarray
    rows: np.ndarray
    data: np.ndarray  # (n, dim) doubles that are whole numbers

    def __post_init__(self) -> None:
        self.norms = np.sqrt((self.data * self.data).sum(1))
        self.most = float(np.abs(self.data).max(initial=0.0))
        self.turn: float | None = None
        self._shares: np.ndarray | None = None
        self._order: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_by(self, coordinate: int) -> tuple[np.ndarray, np.ndarray]:
        """The bucket's shares in a coordinate (of vectors scaled to length 1) in order, and whose they are."""
        if coordinate not in self._order:
            if self._shares is None:
                self._shares = self.data / np.maximum(self.norms, 1e-300)[:, None]
            column = self._shares[:, coordinate]
            order = np.argsort(column, kind="stable")
            self._order[coordinate] = (column[order], order)
        return self._order[coordinate]


def unpacked(dim: int, n: int, ids: bytes, rows: bytes, data: bytes) -> Bucket:
    kind = "<f4" if len(data) == 4 * n * dim else "<f8"
    return Bucket(np.frombuffer(ids, "<i8"), np.frombuffer(rows, "<i8"), np.frombuffer(data, kind).astype(float).reshape(n, dim))


def _pack(held: list[tuple[int, int, bytes]], dim: int) -> list:
    data = np.frombuffer(b"".join(d for _, _, d in held), "<f8").reshape(len(held), dim)
    narrow = data.astype("<f4") if np.abs(data).max(initial=0.0) < 1 << 24 else data
    longest = float(np.sqrt((data * data).sum(1)).max(initial=0.0))
    return [dim, len(held), longest, np.array([i for i, _, _ in held], "<i8").tobytes(), np.array([r for _, r, _ in held], "<i8").tobytes(), narrow.tobytes()]


def _gathered(limit: int):
    """Rows in order become packed rows of at most ``limit`` vectors of one dimension (fewer, if these are wide)."""
    names = ["dim", "n", "longest", "ids", "rows", "data"]
    kinds = [pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]

    def row(packed: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array([v], k) for v, k in zip(packed, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        current = None
        for batch in batches:
            for dim, vec_id, number, data in zip(*(batch.column(c).to_pylist() for c in ("dim", "vec_id", "row", "data"))):
                if held and (dim != current or len(held) >= max(1, min(limit, COMPONENTS // max(1, dim)))):
                    yield row(_pack(held, current))
                    held = []
                current = dim
                held.append((vec_id, number, data))
        if held:
            yield row(_pack(held, current))

    return run


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products: doubles if they can't err, else Python integers."""
    most = float(np.abs(queries).max(initial=0.0)) * float(np.abs(vectors).max(initial=0.0)) * max(1, queries.shape[1])
    if most < 1 << 53:
        return queries @ vectors.T
    whole = lambda a: np.array([[int(x) for x in r] for r in a], dtype=object).reshape(a.shape)
    return whole(queries).dot(whole(vectors).T)


def ranges(query: np.ndarray, cosine: float, coordinates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Between which shares a unit vector lies in these coordinates if its cosine with the unit ``query`` is at least ``cosine``."""
    angle, reach = np.arccos(np.clip(query[coordinates], -1, 1)), np.arccos(np.clip(cosine, -1, 1))
    return np.cos(np.minimum(np.pi, angle + reach)) - 1e-7, np.cos(np.maximum(0.0, angle - reach)) + 1e-7


def met(bucket: Bucket, query: np.ndarray, cosine: float) -> np.ndarray:
    """Places in the bucket that lie within all of the query's ranges."""
    focus = np.argsort(-np.abs(query), kind="stable")[:FOCUS]
    low, high = ranges(query, cosine, focus)
    found = None
    parts = []
    for c, a, b in zip(focus.tolist(), low.tolist(), high.tolist()):
        values, order = bucket.sorted_by(c)
        parts.append(order[np.searchsorted(values, a, "left") : np.searchsorted(values, b, "right")])
    for part in sorted(parts, key=len):
        found = np.sort(part) if found is None else found[np.isin(found, part, assume_unique=True)]
    return found if found is not None else np.arange(len(bucket.ids))


def turning_point(bucket: Bucket, queries: np.ndarray) -> float:
    """The smallest threshold of GRID at which these queries' ranges leave less than TURN of the bucket; above 1 if none does."""
    for cosine in GRID:
        if sum(len(met(bucket, q, cosine)) for q in queries) < TURN * len(queries) * len(bucket.ids):
            return cosine
    return 2.0


class Best:
    """The k best candidates of each query of a block so far: least score first out, ties to the smaller id."""

    def __init__(self, n: int, k: int, floor: np.ndarray) -> None:
        self.k, self.floor = k, floor  # floor: what a candidate has to reach, as far as known
        self.found: list[list[tuple]] = [[] for _ in range(n)]

    def add(self, query: int, scores, ids, rows) -> None:
        mine = self.found[query] + [(-s, i, r) for s, i, r in zip(scores, ids, rows)]
        mine.sort()
        self.found[query] = mine[: self.k]
        if len(mine) >= self.k:
            least = -self.found[query][-1][0]
            lower = float(least)
            self.floor[query] = max(self.floor[query], lower if lower <= least else np.nextafter(lower, -np.inf))


def search(bucket: Bucket, block: Bucket, best: Best) -> dict[str, int]:
    """Meets a block of queries with a bucket; returns how many (query, bucket) pairs were passed over, pruned by length or by coordinate, and how many products were taken."""
    count = {"passed": 0, "length": 0, "coordinate": 0, "products": 0}
    if not len(bucket.ids) or bucket.data.shape[1] != block.data.shape[1]:
        return count
    size = block.norms
    # a product is at most the product of the lengths; the slack covers their rounding
    slack = 1 + 1e-9
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(size > 0, best.floor / (size * slack), np.where(best.floor <= 0, -np.inf, np.inf))
        local = np.where(bucket.norms[0] > 0, need / (bucket.norms[0] * slack), np.where(need <= 0, -np.inf, np.inf))
    open_ = np.flatnonzero(local <= 1)
    count["passed"] = len(size) - len(open_)
    if not len(open_):
        return count
    if bucket.turn is None:
        some = open_[np.linspace(0, len(open_) - 1, min(TUNED, len(open_))).astype(int)]
        some = some[local[some] >= GRID[0]]
        if len(some):
            bucket.turn = turning_point(bucket, block.data[some] / np.maximum(size[some], 1e-300)[:, None])
    turn = 2.0 if bucket.turn is None else bucket.turn
    by_coordinate = open_[local[open_] >= turn]
    by_length = open_[local[open_] < turn]
    count["length"], count["coordinate"] = len(by_length), len(by_coordinate)
    if len(by_length):
        # lengths fall, so what is long enough comes first; the longest prefix serves all, the rest is left out by its score
        prefix = np.searchsorted(-bucket.norms, -need[by_length] / slack, "right")
        most = int(prefix.max())
        if most:
            _verify(bucket, block, best, by_length, np.arange(most), count)
    for q in by_coordinate.tolist():
        places = met(bucket, block.data[q] / size[q], float(local[q]))
        if len(places):
            _verify(bucket, block, best, np.array([q]), places, count)
    return count


def _verify(bucket: Bucket, block: Bucket, best: Best, queries: np.ndarray, places: np.ndarray, count: dict[str, int]) -> None:
    scores = products(block.data[queries], bucket.data[places])
    count["products"] += scores.size
    good = scores >= best.floor[queries][:, None]
    good &= block.rows[queries][:, None] != bucket.rows[places][None, :]
    for at in np.flatnonzero(good.any(1)).tolist():
        hits = np.flatnonzero(good[at])
        values, ids, rows = scores[at][hits], bucket.ids[places[hits]], bucket.rows[places[hits]]
        if len(hits) > best.k:
            kept = np.lexsort((rows, ids, np.array([-v for v in values]) if values.dtype == object else -values))[: best.k]
            values, ids, rows = values[kept], ids[kept], rows[kept]
        best.add(int(queries[at]), [int(v) for v in values], ids.tolist(), rows.tolist())


_FOUND = "query_row long, query_id long, vec_id long, row long, score long"


def _answers(block: Bucket, best: Best) -> pa.RecordBatch:
    out = [(int(block.rows[q]), int(block.ids[q]), i, r, -s) for q, mine in enumerate(best.found) for s, i, r in mine]
    columns = list(zip(*out)) if out else [[]] * 5
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["query_row", "query_id", "vec_id", "row", "score"])


def _seeds(k: int):
    """Adds to each packed block its queries' k-th best scores in the longest bucket of their dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors = []
            for dim, n, ids, rows, data, first in zip(*(batch.column(c).to_pylist() for c in ("dim", "n", "ids", "rows", "data", "first"))):
                block = unpacked(dim, n, ids, rows, data)
                best = Best(n, k, np.full(n, -np.inf))
                search(unpacked(dim, **first), block, best)
                floors.append(best.floor.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _KEPT), pa.array(floors, pa.binary())], names=[*_KEPT, "floors"])

    return run


def _meet(k: int):
    """Rows of a part: its buckets first, then every block of queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("part", "kind", "dim", "n", "ids", "rows", "data", "floors"))
            for at, kind, dim, n, ids, rows, data, floors in zip(*columns):
                if at != part:
                    part, held = at, []
                packed = unpacked(dim, n, ids, rows, data)
                if kind == 0:
                    held.append(packed)
                    continue
                best = Best(n, k, np.frombuffer(floors, "<f8").copy())
                for bucket in held:
                    search(bucket, packed, best)
                yield _answers(packed, best)

    return run


def _vectors(scale: float | None):
    """vec_id, dim, norm and data (the components' bytes); with ``scale``, each component x becomes floor(scale x)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<f8")
            flat = flat if scale is None else np.floor(flat * scale)
            ends = np.cumsum(sizes).tolist()
            parts = [flat[e - n : e] for n, e in zip(sizes.tolist(), ends)]
            yield pa.record_batch([batch.column("vec_id"), pa.array(sizes, pa.int32()), pa.array([float(np.sqrt((p * p).sum())) for p in parts], pa.float64()),
                                   pa.array([p.tobytes() for p in parts], pa.binary())], names=["vec_id", "dim", "norm", "data"])

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float | None = None,
          bucket: int = BUCKET, block: int = BLOCK, part: int = PART) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best rows for every row that ``queries``, a condition on ``vec_id``, names.

    ``vector_col`` holds whole numbers, or with ``scale`` any numbers x, which become floor(scale x).
    """
    spark = vectors.sparkSession
    named = vectors.select(ref(id_col).cast("long").alias("vec_id"), ref(vector_col).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x * (scale or 1.0)) == float("inf")))
    good = named.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~odd)
    rows = written(good.mapInArrow(_vectors(scale), "vec_id long, dim int, norm double, data binary").withColumn("row", F.monotonically_increasing_id()))
    # equal lengths are told apart by the row, so a length that a third of all vectors share is spread as well
    order = ["dim", F.desc("norm"), "row"]
    buckets = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("dim", "vec_id", "row", "data")
                      .mapInArrow(_gathered(bucket), _PACKED).withColumn("at", F.monotonically_increasing_id()))
    n_buckets = buckets.count()
    if not n_buckets:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    longest = buckets.groupBy("dim").agg(F.min("at").alias("at"))
    first = buckets.join(longest, ["dim", "at"]).select("dim", F.struct("n", "ids", "rows", "data").alias("first"))
    asked = rows.filter(queries).repartitionByRange("dim", "row").sortWithinPartitions("dim", "row").select("dim", "vec_id", "row", "data")
    blocks = written(asked.mapInArrow(_gathered(block), _PACKED)).join(first, "dim")
    blocks = written(blocks.select(*_KEPT, "first").mapInArrow(_seeds(k), "dim int, n int, ids binary, rows binary, data binary, floors binary"))
    parts = min(n_buckets, max(-(-n_buckets // part), spark.sparkContext.defaultParallelism))
    one = buckets.select(F.pmod(F.xxhash64("at"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("kind"), *_KEPT, F.lit(None).cast("binary").alias("floors"), "longest")
    many = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), *_KEPT, "floors", F.lit(0.0).alias("longest"))
    met_ = one.union(many).repartition(parts, "part").sortWithinPartitions("part", "kind", F.desc("longest")).mapInArrow(_meet(k), _FOUND)
    best = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = met_.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def embedding_neighbours(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best of every row whose id ``every`` divides, by the inner product of floor(256 x)."""
    return top_k(vectors, F.col("vec_id") % every == 0, k, id_col, vector_col, scale=256.0)


# The same rows in DuckDB.
SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS pos, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(256 * x::DOUBLE))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.pos, c.vec_id, c.pos AS other, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.pos <> c.pos AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (SELECT query_id, row_number() OVER (PARTITION BY pos ORDER BY score DESC, vec_id, other)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
