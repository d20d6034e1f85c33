"""From raw documents to packed training sequences: five stages, each a corpus operator.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; the runner writes each
stage's rows as Parquet and rereads them for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import line_dedup, mixing, near_dup, packing, quality
from quire.llm.common import scratch


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base limits nor the learned decision list reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without lines that at least five share, but for the last holder's."""
    return line_dedup.dedup_lines(docs)


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: 5-word shingle sets of similarity 0.8 or more are linked."""
    return near_dup.keep_firsts(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [("quality", good_documents), ("lines", unique_lines), ("near_dedup", unique_documents), ("mixing", mixed_sources), ("packing", packed)]

#: The learned list of the first stage has no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
