"""The corpus pipeline: toxic texts go, then copies, then near copies; secrets are masked; what is left is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``documents``. An empty table passes through every stage.
"""

from __future__ import annotations

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession, functions as F

from touchline.llm.common import shared_folder
from touchline.llm.exact_dedup import drop_exact_copies
from touchline.llm.packing import pack_documents
from touchline.llm.secret_spans import redact
from touchline.llm.simhash import drop_near_copies
from touchline.llm.toxicity import drop_toxic

MARK = "[SECRET]"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored below the threshold; the model learns from the labelled rows of ``docs`` that are not held out."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return drop_exact_copies(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies."""
    return drop_near_copies(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with every secret found in a text masked, and n_chars of the masked texts counted anew."""
    masked = F.col("text").contains(MARK)
    return redact(docs, mark=MARK).withColumn("n_chars", F.when(masked, F.length("text").cast("long")).otherwise(F.col("n_chars")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in training sequences."""
    return pack_documents(docs, path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("simhash_near_dedup", simhash_near_dedup),
          ("secret_scan", secret_scan), ("packing", packing)]

#: SQL cannot express the trained scores, the hashes of shingles and the tokenizer; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
