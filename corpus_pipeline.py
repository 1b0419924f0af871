"""The corpus pipeline: stages over documents, each written as Parquet and reread as the next one's input.

All stages but the last return the columns of documents. Rejected documents and
all but one of equal or near-equal ones go; mixing repeats or leaves out
documents; packing gives pieces of token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.exact_dedup import ExactDedup
from marlstone.llm.minhash import NearDedup
from marlstone.llm.mixing import Mixer
from marlstone.llm.packing import pack
from marlstone.llm.store import for_texts, written
from marlstone.llm.toxicity import Toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go. Labels of the held-out third are not learned from."""
    labels = for_texts(spark).read.parquet(f"{sf_dir}/labels.parquet")
    usable = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    return Toxicity().fit(docs, labels, usable).keep(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    for_texts(spark)
    return ExactDedup().keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: two-word shingles, as op7 has them, and a similarity of 0.8."""
    for_texts(spark)
    return NearDedup(size=2, percent=80).keep(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    for_texts(spark)
    return Mixer().copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    for_texts(spark)
    return pack(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: SQL can express neither the scores nor the packing; tests compare the operators with brute force, not the five stages as a whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = for_texts(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
