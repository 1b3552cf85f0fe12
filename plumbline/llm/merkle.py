"""Merkle manifest of a table's rows by slot pivot: leaves, roots, inclusion proofs and their verification.

A row's leaf is the hash of its fields with their lengths. The leaves of each ``group`` (a language, say), in the order of their
ids, make a tree: every FANOUT nodes in a row become one node, until one is left, the group's subroot. The subroots, in the
order of their groups, make one more tree, whose top is the root of the table.

How it runs: leaves are range-partitioned by (group, id); the place of a row is its place in its partition plus one carried
number per partition, so no group is ever in one task. Then DEPTH levels of the tree are built by one shuffle: conditional aggregates
spread the nodes that share an ancestor into SLOTS columns (the slot pivot), neighbouring columns are concatenated
and hashed into the columns of the next level, and so on to the ancestor. Leaving the own column out of such a
concatenation gives a node's siblings. A table of n rows takes log(n) / log(SLOTS) rounds, each on SLOTS times fewer rows. On the way
down each round's row gets the proof of its ancestor and hands a longer one to its columns, so whole proofs (they grow
with log n) are made in the task that uses them and never shuffled for every row.

The driver sees one number for each range partition, the size of the largest group and the root.

Cases: a null field is ``-``, so it differs from an empty one. A null group is a group of its own and the first one; null ids come first in their group. Rows of
one id are ordered by their leaf; repeated rows are leaves of their own. A lone leaf is its group's subroot, a lone subroot the root; a proof
without siblings is the hash of the empty string. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.columns import ref
from plumbline.llm.common import written

FANOUT = 2
DEPTH = 4
_PATH = "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition, the place of a row among its tree's rows there, and whether that tree is the partition's first."""
    part, last, count, trees = TaskContext.get().partitionId(), None, 0, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        tree = batch.column("tree")
        new = np.ones(n, bool)
        new[1:] = pc.not_equal(tree.slice(1), tree.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = trees == 0 or tree[0].as_py() != last
        start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        seq = np.where(start < 0, count + np.arange(n), np.arange(n) - start)
        number = trees + np.cumsum(new)
        last, count, trees = tree[n - 1].as_py(), int(seq[-1]) + 1, int(number[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(seq.astype(np.int64)), pa.array(number == 1)],
                                         names=[*batch.schema.names, "part", "seq", "head"])


def places(rows: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` (with a string column ``tree``) and idx, the gapless place of each row in its tree; (tree, m) with the trees' sizes."""
    kinds = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    ordered = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    there = written(ordered.mapInArrow(_numbered, f"{kinds}, part int, seq long, head boolean"))
    ends = there.groupBy("part").agg(F.min("tree").alias("first"), F.max(F.struct("tree", "seq")).alias("end")).orderBy("part").collect()
    carried, last, count = [], None, 0
    for r in ends:
        before = count if r["first"] == last else 0
        carried.append((r["part"], before))
        last, count = r["end"]["tree"], r["end"]["seq"] + 1 + (before if r["end"]["tree"] == r["first"] else 0)
    # one row for each range partition
    carry = F.broadcast(rows.sparkSession.createDataFrame(carried, "part int, carried long"))
    placed = there.join(carry, "part").withColumn("idx", F.col("seq") + F.when(F.col("head"), F.col("carried")).otherwise(0))
    return placed.select(*rows.columns, "idx"), there.groupBy("tree").agg(F.count("*").alias("m"))


def _joined(columns: list[Column]) -> Column:
    return F.concat_ws("", *columns) if columns else F.lit("")


class Forest:
    """Trees over the rows of ``nodes``: tree, digest, and whatever else a leaf is to keep."""

    def __init__(self, nodes: DataFrame, *order: str, fanout: int = FANOUT, depth: int = DEPTH) -> None:
        self.fanout, self.depth, self.slots = fanout, depth, fanout**depth
        self.kept = [c for c in nodes.columns if c != "tree"]
        placed, sizes = places(nodes, *order)
        sizes = written(sizes)
        largest = sizes.agg(F.max("m")).first()[0] or 0
        self.rounds: list[DataFrame] = []
        kid = F.struct(*self.kept)
        level = placed.withColumn("kid", kid).select("tree", "idx", "kid")
        while largest:
            grouped = level.withColumn("gid", F.expr(f"idx div {self.slots}")).withColumn("slot", F.col("idx") % self.slots)
            pivoted = grouped.groupBy("tree", "gid").agg(*(F.max(F.when(F.col("slot") == i, F.col("kid"))).alias(f"c{i}") for i in range(self.slots)),
                                                         *([F.max("m").alias("m")] if self.rounds else []))
            if not self.rounds:
                pivoted = pivoted.join(sizes, "tree")
            self.rounds.append(written(self._hashed(pivoted)))
            if largest <= self.slots:
                break
            largest = -(-largest // self.slots)
            level = self.rounds[-1].filter(F.col("m") > self.slots).select(
                "tree", F.col("gid").alias("idx"), F.struct(F.col("top").alias("digest")).alias("kid"), F.expr(f"(m + {self.slots - 1}) div {self.slots}").alias("m"))

    def _node(self, level: int, i: int) -> Column:
        return F.col(f"h{level}_{i}") if level else F.col(f"c{i}.digest")

    def _run(self, level: int, i: int) -> range:
        first = i - i % self.fanout
        return range(first, first + self.fanout)

    def _hashed(self, pivoted: DataFrame) -> DataFrame:
        """The columns of all levels; ``up`` levels count, fewer than ``depth`` where the tree ends below."""
        out = pivoted
        for level in range(1, self.depth + 1):
            below = lambda i, level=level: [self._node(level - 1, k) for k in range(i * self.fanout, (i + 1) * self.fanout)]
            out = out.withColumns({f"h{level}_{i}": F.when(below(i)[0].isNotNull(), F.sha2(_joined(below(i)), 256)) for i in range(self.fanout ** (self.depth - level))})
        up = sum((F.when(F.col("m") > self.fanout**j, 1).otherwise(0) for j in range(self.depth)), F.lit(0))
        top = F.coalesce(*(F.when(F.col("up") == level, self._node(level, 0)) for level in range(self.depth + 1)))
        return out.withColumn("up", up).withColumn("top", top)

    def tops(self) -> DataFrame:
        """tree and digest of every tree's top."""
        found = [r.filter(F.col("m") <= self.slots).select("tree", F.col("top").alias("digest")) for r in self.rounds]
        out = found[0]
        for more in found[1:]:
            out = out.union(more)
        return out

    def leaves(self, above: DataFrame) -> DataFrame:
        """Every leaf's kept columns, its path to the top, and the columns of ``above``: tree, path (how the top goes on) and more."""
        more = [c for c in above.columns if c not in ("tree", "path")]
        paths = None
        for at in range(len(self.rounds) - 1, -1, -1):
            here = self.rounds[at]
            ending = here.filter(F.col("m") <= self.slots).select("tree", "gid").join(above, "tree").select("tree", "gid", "path", *more)
            paths = ending if paths is None else ending.union(paths)
            steps = {(j, p): F.struct(_joined([self._node(j, k) for k in self._run(j, p) if k < p]).alias("left"), _joined([self._node(j, k) for k in self._run(j, p) if k > p]).alias("right"))
                     for j in range(self.depth) for p in range(self.slots // self.fanout**j)}
            own = lambda i: F.slice(F.array(*(steps[j, i // self.fanout**j] for j in range(self.depth))), F.lit(1), F.col("up"))
            kids = F.array(*(F.when(F.col(f"c{i}").isNotNull(), F.struct(F.lit(i).alias("slot"), F.col(f"c{i}").alias("kid"), own(i).alias("steps"))) for i in range(self.slots)))
            spread = here.join(paths, ["tree", "gid"]).select("tree", "gid", "path", *more, F.explode(F.filter(kids, lambda k: k.isNotNull())).alias("k"))
            whole = F.concat("k.steps", "path").alias("path")
            if at:
                paths = written(spread.select("tree", (F.col("gid") * self.slots + F.col("k.slot")).alias("gid"), whole, *more))
            else:
                return spread.select("tree", *(F.col(f"k.kid.{c}") for c in self.kept), whole, *more)
        raise ValueError("an empty forest has no leaves")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_hash(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def manifest(rows: DataFrame, group: Column, order: Column, fields: list[Column], claimed: list[Column] | None = None, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """tree, id, leaf, claim, path, subroot and root of every row.

    ``fields`` make the leaf; ``claimed``, if given, make ``claim``, another hash to be held against the root (else it is the leaf).
    ``tree`` is the group with ``=`` before it, and empty for null. ``path`` lists, from the leaf to the root, the siblings left and right of the node.
    """
    leaf = row_hash(*fields)
    hashed = written(rows.select(F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("")).alias("tree"), order.alias("id"), leaf.alias("digest"),
                                 (row_hash(*claimed) if claimed else leaf).alias("claim")))
    by_group = Forest(hashed, "id", "digest", fanout=fanout, depth=depth)
    kind = dict(hashed.dtypes)["id"]
    if not by_group.rounds:
        return rows.sparkSession.createDataFrame([], f"tree string, id {kind}, leaf string, claim string, path {_PATH}, subroot string, root string")
    subroots = written(by_group.tops())
    over = Forest(subroots.select(F.lit("").alias("tree"), "digest", F.col("tree").alias("group")), "group", fanout=fanout, depth=depth)
    root = over.tops().first()["digest"]
    start = rows.sparkSession.createDataFrame([("", [])], f"tree string, path {_PATH}")
    groups = over.leaves(start).select(F.col("group").alias("tree"), "path", F.col("digest").alias("subroot"))
    return by_group.leaves(written(groups)).select("tree", "id", F.col("digest").alias("leaf"), "claim", "path", "subroot", F.lit(root).alias("root"))


def document_manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document.

    The claim that is folded to the root has n_chars one higher wherever 7 divides the id's CRC-32, which verification has to notice.
    """
    doc_id, n_chars = ref(id_col).cast("long"), ref("n_chars").cast("long")
    struck = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))
    fields = [doc_id, ref("source"), ref(group_col), n_chars, ref("text")]
    claimed = [doc_id, ref("source"), ref(group_col), F.when(struck, F.try_add(n_chars, F.lit(1).cast("long"))).otherwise(n_chars), ref("text")]
    out = manifest(docs, ref(group_col), doc_id, fields, claimed, fanout, depth)
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"),
                      folded(F.col("claim"), F.col("path")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


# The same rows in DuckDB: levels by recursion, then each leaf walks up to the root.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT *, coalesce('=' || lang, '') AS tree,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    4294967295 - list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
      lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))) AS crc
  FROM documents
), l AS (
  SELECT doc_id, tree, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS h,
    sha256(head || coalesce(strlen((n_chars + (crc % 7 = 0)::INT)::VARCHAR) || ':' || (n_chars + (crc % 7 = 0)::INT), '-') || tail) AS claim FROM d
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY tree) AS m FROM l
), nodes AS (
  SELECT tree, 0 AS lvl, i, h, m FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (m + 1) // 2 FROM nodes WHERE m > 1 GROUP BY tree, lvl, i // 2, m
), sub AS (
  SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS m FROM nodes WHERE m = 1
), upper_nodes AS (
  SELECT 0 AS lvl, i, h, m FROM sub
  UNION ALL
  SELECT lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (m + 1) // 2 FROM upper_nodes WHERE m > 1 GROUP BY lvl, i // 2, m
), walk AS (
  SELECT doc_id, tree, i AS leaf_i, h AS leaf, 0 AS lvl, i, m, claim AS node, '' AS proof FROM leaves
  UNION ALL
  SELECT w.doc_id, w.tree, w.leaf_i, w.leaf, w.lvl + 1, w.i // 2, (w.m + 1) // 2,
    sha256(CASE WHEN w.i % 2 = 0 THEN w.node || coalesce(n.h, '') ELSE n.h || w.node END), w.proof || coalesce(n.h, '')
  FROM walk w LEFT JOIN nodes n ON n.tree = w.tree AND n.lvl = w.lvl AND n.i = xor(w.i, 1) WHERE w.m > 1
), walk2 AS (
  SELECT w.doc_id, w.tree, w.leaf_i, w.leaf, s.h AS subroot, 0 AS lvl, s.i, s.m, w.node, w.proof FROM walk w JOIN sub s USING (tree) WHERE w.m = 1
  UNION ALL
  SELECT w.doc_id, w.tree, w.leaf_i, w.leaf, w.subroot, w.lvl + 1, w.i // 2, (w.m + 1) // 2,
    sha256(CASE WHEN w.i % 2 = 0 THEN w.node || coalesce(n.h, '') ELSE n.h || w.node END), w.proof || coalesce(n.h, '')
  FROM walk2 w LEFT JOIN upper_nodes n ON n.lvl = w.lvl AND n.i = xor(w.i, 1) WHERE w.m > 1
), r AS (SELECT h AS root FROM upper_nodes WHERE m = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified FROM walk2, r WHERE m = 1
"""
