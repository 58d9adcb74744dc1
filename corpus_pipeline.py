"""The training-data pipeline: quality rules, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its result is written as Parquet
and read again. All but the last return the columns of documents.

A null text fails the quality rules; rows that share an id stay or go together in the near-duplicate stage; an empty
table passes through every stage empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismgraph.llm import decontamination, jaccard, packing, quality
from prismgraph.llm.common import store, table
from prismgraph.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the threshold table."""
    return docs.where(quality.passes(F.col("text")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of linked ones; those without shingles link with nothing and stay."""
    joined = jaccard.join_documents(docs)
    keep = joined.where(F.col("component_id").isNull() | (F.col("component_id") == F.col("doc_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["kept_id"]), "left_semi")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item."""
    found = decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    leaks = found.where("contaminated").select(F.col("key").alias("leak")).distinct()
    return docs.join(leaks, decontamination.row_key() == F.col("leak"), "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens, mixed by source."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), payload=False)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pack_sequences", pack_sequences)]

#: Tokenization and packing cannot be expressed in SQL; tests/llm holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
