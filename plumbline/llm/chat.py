"""Chat formatting after cumulative-snapshot collapse, in DataFrame functions only.

A chat log often holds a conversation many times, each snapshot a few turns longer. Each turn's hash covers
its place, role and text; the running XOR of these hashes up to a turn is the hash of that prefix (128 bits, so
chance agreement is out of the question). A conversation whose whole hash is a prefix hash of a longer one is
covered, and one that equals another with a smaller id is a copy: two anti-joins take both out. What is left is
rendered.

Only hashes are windowed and joined; texts are shuffled once, for the conversations that stay. Prefix hashes are
grouped before they are joined, so a first turn or a conversation that many logs share is one row.

Cases: turns are ordered by number, then role, then text (nulls first), and counted from 0 in that order, so gaps
and repeated numbers do no harm. A null role renders as ``unknown``, a null text as empty; for comparing, null
and empty text differ. Rows with a null conversation id form one conversation. ``<|`` inside a text
is rendered as ``<\\|``, so a text can't forge a marker. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.columns import ref
from plumbline.llm.common import written


def prefixes(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, length, h1, h2: the hash of the first ``length`` turns of each conversation, for every length."""
    rows = turns.select(ref(conv_col).alias("conv_id"), ref(turn_col).alias("turn"), ref(role_col).alias("role"),
                        F.sha2(F.coalesce(ref(text_col), F.lit("")), 256).alias("text_hash"), ref(text_col).isNull().alias("no_text"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "no_text", "text_hash")
    rows = rows.select("conv_id", "role", "text_hash", "no_text", F.row_number().over(order).alias("place"))
    hashes = [F.xxhash64(F.lit(s), "place", "role", F.col("role").isNull(), "text_hash", "no_text") for s in (1, 2)]
    rows = rows.select("conv_id", "place", hashes[0].alias("t1"), hashes[1].alias("t2"))
    run = W.partitionBy("conv_id").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.select("conv_id", F.col("place").alias("length"), F.bit_xor("t1").over(run).alias("h1"), F.bit_xor("t2").over(run).alias("h2"))


def maximal(turns: DataFrame, **names: str) -> DataFrame:
    """conv_id and n_turns of the conversations to keep."""
    all_ = written(prefixes(turns, **names).withColumn("of", F.max("length").over(W.partitionBy("conv_id"))))
    whole = all_.filter("length = of").select("conv_id", "length", "h1", "h2")
    by_hash = all_.groupBy("length", "h1", "h2").agg(
        F.max("of").alias("longest"), F.min(F.when(F.col("length") == F.col("of"), F.struct(F.col("conv_id").isNull().alias("none"), F.col("conv_id")))).alias("first"))
    by_hash = written(by_hash.filter("first is not null").select("length", "h1", "h2", "longest", F.col("first.conv_id").alias("first_id")))
    covered = by_hash.filter("longest > length").select("length", "h1", "h2")
    kept = whole.join(covered, ["length", "h1", "h2"], "left_anti")
    firsts = by_hash.filter("longest = length").select("length", "h1", "h2", F.col("first_id"))
    copies = kept.join(firsts, ["length", "h1", "h2"]).filter(~F.col("conv_id").eqNullSafe(F.col("first_id"))).select(F.col("conv_id").alias("copy_id"))
    return kept.join(copies, F.col("conv_id").eqNullSafe(F.col("copy_id")), "left_anti").select("conv_id", F.col("length").alias("n_turns"))


def render(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, n_turns and text: every turn as ``<|role|>``, newline, text, ``<|end|>``, newline."""
    rows = turns.select(ref(conv_col).alias("conv_id"), F.struct(
        ref(turn_col).alias("turn"), ref(role_col).alias("role"), ref(text_col).isNull().alias("no_text"),
        F.sha2(F.coalesce(ref(text_col), F.lit("")), 256).alias("text_hash"),
        F.coalesce(ref(text_col), F.lit("")).alias("text")).alias("t"))
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("<\\|"))
    line = lambda t: F.concat(F.lit("<|"), safe(F.coalesce(t["role"], F.lit("unknown"))), F.lit("|>\n"), safe(t["text"]), F.lit("<|end|>\n"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return grouped.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.concat_ws("", F.transform("turns", line)).alias("text"))


def format_chats(turns: DataFrame, **names: str) -> DataFrame:
    """The rendered maximal conversations: conv_id, n_turns, text."""
    conv_col = names.get("conv_col", "conv_id")
    keep = written(maximal(turns, **names)).select(F.col("conv_id").alias("keep_id"))
    staying = turns.join(keep, ref(conv_col).eqNullSafe(F.col("keep_id")), "left_semi")
    return render(staying, **names)


# The same rows in DuckDB: every prefix of every conversation as the hash of its turns' text form.
SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text IS NULL, sha256(coalesce(text, ''))) AS place,
         role, text FROM conversations
), p AS (
  SELECT conv_id, place, sha256(string_agg(sha256(concat(coalesce(role, chr(1)), chr(2), CASE WHEN text IS NULL THEN 'n' ELSE 't' END, text)), ',')
           OVER (PARTITION BY conv_id ORDER BY place)) AS h,
         max(place) OVER (PARTITION BY conv_id) AS size FROM t
), g AS (
  SELECT place, h, max(size) AS longest, min(CASE WHEN size = place THEN conv_id END) AS first_id FROM p GROUP BY place, h
), k AS (
  SELECT p.conv_id FROM p JOIN g USING (place, h) WHERE p.place = p.size AND g.longest = p.size AND g.first_id = p.conv_id
)
SELECT conv_id, count(*) AS n_turns,
       string_agg('<|' || replace(coalesce(role, 'unknown'), '<|', '<\|') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '<\|') || '<|end|>' || chr(10), '' ORDER BY place) AS text
FROM t WHERE conv_id IN (SELECT conv_id FROM k) GROUP BY conv_id
"""
