"""The queries of the numbered operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import PATTERN, path
from pyspark.sql import DataFrame, SparkSession

from touchline.llm.alignment import align_documents
from touchline.llm.byte_bpe import encode_documents
from touchline.llm.conversations import conversation_report
from touchline.llm.exact_dedup import exact_dedup
from touchline.llm.katz import score_documents
from touchline.llm.licenses import license_report
from touchline.llm.packing import pack_documents
from touchline.llm.secret_spans import secret_report
from touchline.llm.sharding import shard_documents
from touchline.llm.simhash import simhash_report
from touchline.llm.suffix_dedup import remove_repeats
from touchline.llm.topk import top_k_report
from touchline.llm.toxicity import toxicity_report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_license_scan(spark, sf_dir):
    return license_report(table(spark, sf_dir, "documents"))


@query
def op2_exact_topk(spark, sf_dir):
    return top_k_report(table(spark, sf_dir, "embeddings"))


@query
def op3_secret_scan(spark, sf_dir):
    return secret_report(table(spark, sf_dir, "documents"))


@query
def op6_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


@query
def op10_jump_sharding(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"))


@query
def op4_toxicity(spark, sf_dir):
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_byte_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return encode_documents(docs, path("byte_bpe_multi_50k.tiktoken"), PATTERN, {"doc_id": docs["doc_id"]},
                            outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


@query
def op7_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))


@query
def op8_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), path("word_bpe_49k.json"))


@query
def op9_simhash_dedup(spark, sf_dir):
    return simhash_report(table(spark, sf_dir, "documents"))


@query
def op13_katz_scoring(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"))


@query
def op12_conversation_repair(spark, sf_dir):
    return conversation_report(table(spark, sf_dir, "conversations"))


@query
def op11_token_alignment(spark, sf_dir):
    return align_documents(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"), PATTERN)
