"""Exact de-duplication with a heavy-hitter split, in DataFrame functions only.

1. Every text is normalised (each run of white space becomes one space) and hashed once; the narrow table of
   ids and digests is written, so texts are read once.
2. Spark's ``approx_top_k`` keeps the counters of a Misra-Gries summary (frequent items with mergeable,
   decremented counters) for ``tracked`` digests and lists the ``heavy`` largest. A digest of more than 2 * rows / heavy
   rows cannot be missing from that list.
3. The listed digests are counted exactly. These verified winners, at most ``heavy`` rows by construction, are
   broadcast: rows of heavy groups meet their answer on the map side and are never shuffled.
4. All other digests are grouped by an ordinary shuffle; none of these groups can be large.

Cases: null text counts as empty. Of equal texts the row with the smallest id stays (null ids come last); of rows that
repeat an id as well, exactly one stays. Blank texts are all equal to one space, except empty ones. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.columns import ref
from plumbline.llm.common import keep_rows, narrow, written

HEAVY = 1000
TRACKED = 20_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def frequent(keys: DataFrame, col: str, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """At most ``heavy`` values of the column that may be frequent, as rows of one column."""
    top = keys.agg(F.expr(f"approx_top_k(`{col}`, {int(heavy)}, {int(tracked)})").alias("top"))
    return top.select(F.explode("top").alias("t")).select(F.col(f"t.item").alias(col))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY,
                     tracked: int = TRACKED) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256, one row for each row of ``docs``."""
    rows = written(narrow(docs, id_col, text_col).select(
        "doc_id", F.unhex(digest(F.col("text"))).alias("digest"), F.monotonically_increasing_id().alias("row")))
    # null ids last; the row number settles repeated ids
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    grouped = [F.min(place).alias("keep"), F.count("*").alias("group_size")]
    candidates = frequent(rows.select(F.hex("digest").alias("digest")), "digest", heavy, tracked).select(F.unhex("digest").alias("digest"))
    winners = rows.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest").agg(*grouped).filter("group_size > 1")
    winners = written(winners)
    known = rows.join(F.broadcast(winners), "digest", "left")
    hot = known.filter("keep is not null")
    same = W.partitionBy("digest")
    rest = known.filter("keep is null").select("doc_id", "digest", "row").select(
        "doc_id", "digest", "row", F.min(place).over(same).alias("keep"), F.count("*").over(same).alias("group_size"))
    return hot.select(rest.columns).union(rest).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with one row left of each group of equal texts."""
    found = written(exact_duplicates(docs, id_col, text_col).select("doc_id", "text_sha256", "kept"))
    return keep_rows(docs, found.filter("kept").select("doc_id", "text_sha256"), found.select("doc_id", "text_sha256"), digest(ref(text_col)), id_col)


# The same rows in DuckDB.
SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
