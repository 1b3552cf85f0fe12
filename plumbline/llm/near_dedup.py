"""Near-duplicate components of documents by min-max hashing.

A document's set holds its distinct shingles of five lower-cased words (with fewer words, the whole
sequence). Every permutation keeps both its smallest and its largest value over the set, so 64 hash
evaluations a shingle give 128 signature values: both agree with probability equal to the similarity. Bands
of four values propose candidates; each proposed link is confirmed on the two full sets.

How hot groups are met:

- Documents with the same set are one class before anything is joined, so copies cost one row each.
- A band bucket is compared as a star: each member with the bucket's smallest member. After that only buckets
  that still hold several components are looked at again, first by TURNS more stars with another center. What is
  then still open is compared across components only, and only where two documents share one of their rarest
  shingles: neither a large group of near copies nor a passage that many documents share costs its square.
- Links become components by star steps on distributed edges.

A pair of similarity 0.75 is missed by all 32 bands with probability (1 - 0.75^4)^32 = 5e-6; higher
similarities, less.

Cases: null or blank text has an empty set, forms its own component and is kept. Null ids belong to
components but never name one while another id is there. Repeated rows share their component; every row
with the smallest id is kept. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.columns import ref
from plumbline.llm.common import graph_components, keep_rows, mix, narrow, release, signed, slices_of, text_bytes, word_hashes, written

WIDTH = 5
PERMUTATIONS = 64
ROWS = 4
PERCENT = 75
TURNS = 1

_SEEDS = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_A, _B = _SEEDS[:PERMUTATIONS] | np.uint64(1), _SEEDS[PERMUTATIONS:]
_C = mix(np.arange(101, 101 + WIDTH + 1, dtype=np.uint64))


def shingle_sets(words: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; ``at`` has the rows' offsets into ``words``."""
    out = []
    n = len(words)
    rolled = np.zeros(max(0, n - WIDTH + 1), np.uint64)
    for k in range(WIDTH):
        rolled += words[k : n - WIDTH + 1 + k] * _C[k] if n >= WIDTH else np.uint64(0)
    rolled = mix(rolled)
    for low, high in zip(at[:-1].tolist(), at[1:].tolist()):
        if high - low >= WIDTH:
            out.append(np.unique(rolled[low : high - WIDTH + 1]))
        elif high > low:
            parts = np.append(words[low:high] * _C[: high - low], _C[WIDTH:] * np.uint64(high - low))
            out.append(mix(parts.sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def min_max(sets: list[np.ndarray]) -> np.ndarray:
    """(rows, 2 * PERMUTATIONS): the minima of all permutations, then the maxima. Sets are not empty."""
    values = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), 2 * PERMUTATIONS), np.uint64)
    for k in range(PERMUTATIONS):
        hashed = values * _A[k] + _B[k]
        out[:, k] = np.minimum.reduceat(hashed, starts)
        out[:, PERMUTATIONS + k] = np.maximum.reduceat(hashed, starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    bands = signature.reshape(len(signature), -1, ROWS)
    keys = np.zeros(bands.shape[:2], np.uint64)
    for k in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, k])
    return mix(keys + np.arange(keys.shape[1], dtype=np.uint64))


def _sets_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    raw, offsets = text_bytes(batch.column("text"))
    for low, high in slices_of(offsets):
        words, at = word_hashes(raw, offsets[low : high + 1])
        yield low, high, shingle_sets(words, at)


def _class_key(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    empty = _class_key(np.zeros(0, np.uint64))
    for batch in batches:
        for low, high, sets in _sets_of(batch):
            full = [s for s in sets if len(s)]
            keys = iter(signed(band_keys(min_max(full)))) if full else iter(())
            yield pa.record_batch(
                [batch.column("doc_id").slice(low, high - low), batch.column("text_hash").slice(low, high - low), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_class_key(s) if len(s) else empty for s in sets], pa.binary()),
                 pa.array([next(keys) if len(s) else [] for s in sets], pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "class", "bands"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        for _, _, sets in _sets_of(batch):
            yield pa.record_batch([pa.array([_class_key(s) for s in sets], pa.binary()),
                                   pa.array([signed(s) for s in sets], pa.list_(pa.int64()))], names=["class", "shingles"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach the similarity."""
    left = sets.select(F.col("class").alias("u"), F.col("shingles").alias("left"))
    right = sets.select(F.col("class").alias("v"), F.col("shingles").alias("right"))
    both = pairs.join(left, "u").join(right, "v")
    common = F.size(F.array_intersect("left", "right")).cast("long")
    union = F.size("left") + F.size("right") - common
    return both.filter(100 * common >= percent * union).select("u", "v")


def _reachable(small: str, large: str, percent: int):
    """The sizes of two sets alone allow the similarity."""
    return F.col(small) * 100 >= F.col(large) * percent


def _open_buckets(members: DataFrame, joined: DataFrame) -> DataFrame:
    """The members, with their component so far, of the buckets that hold more than one component."""
    labelled = members.join(joined.select(F.col("u").alias("class"), F.col("v").alias("root")), "class", "left").select(
        "band", "class", "n", F.coalesce("root", "class").alias("root"))
    mixed = labelled.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
    return written(labelled.join(mixed.select("band"), "band", "left_semi"))


def _across(left_open: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of different components that share a shingle among their rarest.

    Two sets of the wanted similarity share at least one of their n - ceil(n * percent / 100) + 1 first shingles in any
    common order, so nothing is lost. Rarest first: documents that only share a common passage never meet.
    """
    open_ = written(left_open.select("class", "n", "root").distinct().withColumn("c", F.xxhash64("class")))
    tokens = written(open_.join(sets, "class").select("c", F.explode("shingles").alias("t")))
    common = tokens.groupBy("t").agg(F.count("*").alias("df")).filter("df > 1")
    known = tokens.join(common, "t")
    known = known.withColumn("at", F.row_number().over(W.partitionBy("c").orderBy("df", "t"))).withColumn(
        "others", F.count("*").over(W.partitionBy("c")))
    sized = open_.select("c", "n", "root", "class")
    reach = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.col("others"))
    # how many of its shingles stand at this one or after it
    known = known.withColumn("left", F.col("others") - F.col("at") + 1)
    first = written(known.join(sized, "c").filter(F.col("at") <= reach).select("t", "c", "n", "root", "left"))
    a = first.select("t", F.col("c").alias("cu"), F.col("n").alias("nu"), F.col("root").alias("ru"), F.col("left").alias("lu"))
    b = first.select(F.col("t").alias("t2"), F.col("c").alias("cv"), F.col("n").alias("nv"), F.col("root").alias("rv"), F.col("left").alias("lv"))
    # the first shared shingle and all that can follow it on either side must still make up the wanted overlap
    enough = (100 + percent) * F.least("lu", "lv") >= percent * (F.col("nu") + F.col("nv"))
    pairs = a.join(b, (F.col("t") == F.col("t2")) & (F.col("cu") < F.col("cv")) & (F.col("ru") != F.col("rv"))
                   & _reachable("nu", "nv", percent) & _reachable("nv", "nu", percent) & enough).select("cu", "cv").distinct()
    named = open_.select("c", "class")
    pairs = pairs.join(named.toDF("cu", "cu_class"), "cu").join(named.toDF("cv", "cv_class"), "cv")
    return pairs.select(F.greatest("cu_class", "cv_class").alias("u"), F.least("cu_class", "cv_class").alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by confirmed links), kept, text_hash and component_key (null
    without a set), one row for each row of ``docs``."""
    texts = narrow(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    signed_docs = written(texts.mapInArrow(_signatures, "doc_id long, text_hash long, n_shingles long, class binary, bands array<long>"))
    classes = written(signed_docs.filter("n_shingles > 0").groupBy("class").agg(
        F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"),
        F.count("*").alias("copies")))
    banded = classes.select("class", "n", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min(F.struct("class", "n")).alias("low"), F.count("*").alias("members")).filter("members > 1")
    members = written(banded.join(shared, "band").select("band", "class", "n", F.col("low.class").alias("center"), F.col("low.n").alias("center_n")))
    star = members.filter(F.col("class") != F.col("center")).filter(
        _reachable("n", "center_n", percent) & _reachable("center_n", "n", percent)).select(
        F.col("class").alias("u"), F.col("center").alias("v")).distinct()
    # one text of each class that shares a bucket; its class is computed again, as ids may repeat
    wanted = members.select("class").distinct()
    bearers = signed_docs.join(wanted, "class", "left_semi").groupBy("class").agg(F.min("doc_id").alias("bearer")).select("bearer").distinct()
    bearing = texts.join(bearers, F.col("doc_id").eqNullSafe(F.col("bearer")), "left_semi")
    sets = written(bearing.mapInArrow(_full_sets, "class binary, shingles array<long>").dropDuplicates(["class"]))
    links = written(_confirmed(star, sets, percent))
    joined = graph_components(links)
    tried = star
    for turn in range(TURNS):
        left_open = _open_buckets(members, joined)
        center = left_open.groupBy("band").agg(F.min_by(F.struct("class", "n", "root"), F.xxhash64("class", F.lit(turn))).alias("c"))
        star = written(left_open.join(center, "band").filter(F.col("root") != F.col("c.root")).filter(
            _reachable("n", "c.n", percent) & _reachable("c.n", "n", percent)).select(
            F.greatest("class", "c.class").alias("u"), F.least("class", "c.class").alias("v")).distinct().join(tried, ["u", "v"], "left_anti"))
        more = written(_confirmed(star, sets, percent))
        tried = tried.union(star)
        if more.isEmpty():
            break
        joined = graph_components(joined.union(more))
    # what the stars leave open: across components only, and only pairs that share one of their rarest shingles
    across = _across(_open_buckets(members, joined), sets, percent)
    more = written(_confirmed(across.join(tried, ["u", "v"], "left_anti"), sets, percent))
    if not more.isEmpty():
        joined = graph_components(joined.union(more))
    rooted = classes.select("class", "first_id").join(joined.select(F.col("u").alias("class"), F.col("v").alias("root")), "class", "left")
    rooted = rooted.select("class", "first_id", F.coalesce("root", "class").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    answer = rooted.join(named, "root").select("class", "root", "component_id")
    full = signed_docs.filter("n_shingles > 0").join(answer, "class").select(
        "doc_id", "n_shingles", "component_id", "text_hash", F.hex("root").alias("component_key"))
    none = signed_docs.filter("n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_hash", F.lit(None).cast("string").alias("component_key"))
    return full.union(none).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash", "component_key")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, with one row left of every component: the smallest id (nulls last), then text hash."""
    found = written(near_duplicates(docs, id_col, text_col, percent))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_hash"))
    firsts = found.filter("component_key is not null").groupBy("component_key").agg(F.min(place).alias("p")).select("p.doc_id", "p.text_hash")
    keys = firsts.union(found.filter("component_key is null").select("doc_id", "text_hash").distinct())
    return keep_rows(docs, keys, found.select("doc_id", "text_hash"), F.xxhash64(F.coalesce(ref(text_col), F.lit(""))), id_col)
