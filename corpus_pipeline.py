"""The corpus pipeline: each stage takes (spark, docs, sf_dir), and its result is the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lineweave.llm import langid, mixing, orderminhash, secrets, sentencepieces
from lineweave.plans.lineage import cut


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go."""
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return orderminhash.deduplicate(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blotted out; every document stays."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as their source's target asks, repeats as rows of their own."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every row's text."""
    return sentencepieces.encode(docs)


STAGES = [("language ID", language), ("MinHash near-dedup", near_dedup), ("secret scans", secret_scan), ("mixing sources", mix_sources), ("SentencePiece encoding", encode)]

#: The model-based stages can't be expressed in SQL; a test holds run() against brute force, stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over all documents; each result but the last is written as Parquet below the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
