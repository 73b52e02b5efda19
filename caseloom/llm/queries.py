"""Registered queries of the corpus operators, with SQL where SQL can say the same."""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession

from caseloom.llm import (
    bpe, classifier, debruijn, decontaminate, hyperminhash, prefixes, quality, repair, simhash, suffixes, token_counts, urls, warc,
)
from caseloom.llm.base import read
from caseloom.llm.sql import ORACLES  # noqa: F401

QUERIES: dict = {}


def query(name: str):
    def keep(fn):
        QUERIES[name] = fn
        return fn

    return keep


@query("op1_simhash")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf, "documents"), keep=["doc_id"])


@query("op2_token_counts")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    scores = token_counts.rank_scores(str(tokenizer_path("piece_bpe_32k.model")))
    return token_counts.count_tokens(read(spark, sf, "documents"), scores, keep=["doc_id"])


@query("op3_quality_rules")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(read(spark, sf, "documents"), keep=["doc_id"])


@query("op4_warc")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return warc.archive_pages(read(spark, sf, "pages")).select(*columns)


@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return suffixes.remove_repeated_bytes(read(spark, sf, "documents"), keep=["doc_id"])


@query("op6_substring_dedup")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return debruijn.remove_repeated_words(read(spark, sf, "documents"), keep=["doc_id"])


@query("op7_benchmark_decontamination")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.decontaminate(read(spark, sf, "documents"), read(spark, sf, "benchmark"), keep=["doc_id"])


@query("op8_url_filters")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return urls.filter_urls(read(spark, sf, "pages"), keep=["page_id"])


@query("op9_quality_classifier")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return classifier.score(docs, classifier.train(docs, read(spark, sf, "labels")), keep=["doc_id"])


@query("op10_bpe")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_decode(read(spark, sf, "documents"), str(tokenizer_path("byte_bpe_50k.json")), keep=["doc_id"])


@query("op11_hyperminhash")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return hyperminhash.similar_documents(read(spark, sf, "documents"), keep=["doc_id"])


@query("op12_prefix_trie")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return prefixes.prefix_trie(read(spark, sf, "conversations"))


@query("op13_conversation_repair")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return repair.repair_conversations(read(spark, sf, "conversations"))
