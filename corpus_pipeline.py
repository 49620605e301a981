"""A training corpus from raw documents: quality rules, near-dedup, mixing, SentencePiece encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cubeweave.llm.mixing import mixed, with_places
from cubeweave.llm.quality import without_rejected
from cubeweave.llm.queries import MIX_TICKETS, tokenizer
from cubeweave.llm.sentencepieces import encode_documents
from cubeweave.llm.simhash import without_near_duplicates
from cubeweave.scratch import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 of the rule ledger keeps."""
    return without_rejected(docs, policy="v1")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates."""
    return without_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: that of the files and of the rows in them."""
    return mixed(docs, MIX_TICKETS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, with every document's place in the mixture."""
    return encode_documents(with_places(docs), tokenizer("piece_bpe_32k.model"), keep=("place",))


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("mixing", mixture), ("sentencepiece", encoding)]

#: Near-duplicates and SentencePiece ids have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
