"""Corpus pipeline: quality rules, SimHash near-duplicates, repeated passages, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir); what it returns is written and read again as the next one's docs. All but the
last keep the columns of ``documents``. The operators' docstrings say what they do with nulls, empty texts and repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from public_tokenizers import path as tokenizer_path

from caseloom.llm import bpe, debruijn, decontaminate, hyperminhash, quality
from caseloom.llm.base import read, settle

KNOWN_WORDS = 1 << 17  # words a worker of the last stage remembers, twice; the next run's first stage needs the memory
TOKENIZER = str(tokenizer_path("byte_bpe_50k.json"))


def with_text(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """``df`` with ``text`` as its text and a length that fits it."""
    df = df.withColumn("text", F.col(text))
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.apply_cascade(docs).filter("kept").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts alike in four fifths of their five-word shingles the first document, by id and text hash.

    Fingerprints of these shingles within three bits name candidates. They miss most pairs of that similarity, so
    sketches name the others, and all candidates are compared on their whole sets.
    """
    return hyperminhash.first_documents(docs, percent=80, shingle=5, tau=3)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without passages of 35 words or more that start elsewhere; white space elsewhere and null texts stay."""
    cut = debruijn.remove_repeated_words(docs, with_text=True)
    return with_text(cut.withColumn("kept_text", F.when(F.col("text").isNotNull(), F.col("kept_text"))), "kept_text", docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the spans that benchmark windows cover."""
    return with_text(decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"), remove=True), "text", docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of what they decode to."""
    return bpe.encode_decode(docs, TOKENIZER, keep=["doc_id", "lang", "source"], with_texts=True, known_words=KNOWN_WORDS, release=True).drop("decoded")


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("bpe", token_stage),
]
ORACLE_SQL = None  # fingerprints, windows over all texts and byte-pair merges have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
