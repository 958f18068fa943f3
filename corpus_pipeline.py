"""The corpus pipeline: toxic and poor documents go, one of each near-duplicate group stays, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm.ngram_join import keep_one_per_component
from keyloom.llm.packing import pack_documents
from keyloom.llm.quality import keep_good
from keyloom.llm.toxicity import keep_clean
from keyloom.llm.workspace import Workspace


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model doesn't reject."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return keep_good(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id."""
    return keep_one_per_component(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, start, length, bin_id, position, offset."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("quality rules", quality), ("n-gram Jaccard join", deduplicate), ("best-fit packing", packing)]
#: A trained model and sketches aren't SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Workspace(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = work.write(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
