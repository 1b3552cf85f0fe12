"""The corpus pipeline: documents in, packed training sequences out.

Every stage takes and returns whole rows of documents, extra columns included, until the last one packs what is left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontamination, exact_dedup, near_dedup, packing, toxicity
from plumbline.llm.common import table
from plumbline.session import shared_dir


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay; the machine learns from ``labels`` outside the held-out fifth."""
    model = toxicity.fit(docs, toxicity.teaching(table(spark, sf_dir, "labels")))
    return toxicity.accepted(docs, model)


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts stays."""
    return exact_dedup.first_of_each(docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    return near_dedup.one_of_each(docs)


def test_items_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark`` stay."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequence and place."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic_out), ("exact_dedup", copies_out), ("near_dedup", near_copies_out), ("decontamination", test_items_out), ("packing", packed)]

# Two stages (a trained classifier, a tokenizer) can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
