"""The registered queries of the training-data operators: name -> (query, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import chat, collocations, decontamination, exact_dedup, merkle, packing, pii, sharding, suffix_dedup, token_files, top_k, toxicity
from plumbline.llm.common import table
from plumbline.llm.near_dedup import near_duplicates


def op1_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards without slack, so counts are at most one apart."""
    placed = sharding.assign(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home")


def op2_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_snapshot_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op4_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_subsequence_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, toxicity.teaching(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", "n_items", F.transform("matches", lambda m: m["item_id"]).alias("item_ids"),
                        F.transform("matches", lambda m: m["distance"]).alias("distances"))


def op7_induced_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["high"] - s["low"])
    return left.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_addressable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(token_files.write_token_files(table(spark, sf_dir, "documents")))


def op9_heavy_hitter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))

    def line(c):
        return F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.BASE), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"),
                        F.transform("spans", lambda s: s["score"]).alias("scores"))


def op11_norm_bucketed_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.embedding_neighbours(table(spark, sf_dir, "embeddings"))


def op12_stream_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_slot_pivot_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_bounded_ring": (op1_bounded_ring, None),
    "op2_minmax_near_dedup": (op2_minmax_near_dedup, None),
    "op3_snapshot_chats": (op3_snapshot_chats, chat.SQL),
    "op4_residual_packing": (op4_residual_packing, None),
    "op5_subsequence_toxicity": (op5_subsequence_toxicity, None),
    "op6_pigeonhole_decontamination": (op6_pigeonhole_decontamination, None),
    "op7_induced_suffix_dedup": (op7_induced_suffix_dedup, None),
    "op8_addressable_tokens": (op8_addressable_tokens, None),
    "op9_heavy_hitter_dedup": (op9_heavy_hitter_dedup, exact_dedup.SQL),
    "op10_personal_data": (op10_personal_data, None),
    "op11_norm_bucketed_top_k": (op11_norm_bucketed_top_k, top_k.SQL),
    "op12_stream_collocations": (op12_stream_collocations, collocations.SQL),
    "op13_slot_pivot_manifest": (op13_slot_pivot_manifest, merkle.SQL),
}
