"""From raw documents to token ids: quality rules, near-duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's
result to the shared folder and reads it again for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chatpack.llm import bpe, mixing, quality_rules, secrets, simhash
from chatpack.llm.components import stored
from chatpack.llm.queries import VOCABULARY


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; those labelled of quality 1 are the target."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return quality_rules.filter_documents(docs, trusted)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, on five-word shingles."""
    return simhash.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix of their sources."""
    return mixing.mixed(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, lossless of every document, and its slot and place in the mix of the sources.

    Files that are read again keep no order, so the places are columns. They follow from the
    ids and sources alone: they are those of the mixing stage. The placed texts are stored
    first, so that no task sorts texts and holds the tokenizer at once.
    """
    placed = stored(mixing.placed(docs.select("doc_id", "source", "text")).select("row.doc_id", "row.text", "slot", "place"))
    return bpe.tokens(placed, public_tokenizers.path(VOCABULARY), ("slot", "place"))


STAGES = [
    ("quality_rules", good_documents),
    ("near_duplicates", one_of_each),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("tokens", tokenized),
]

#: Neither the language-model scores nor the fingerprints can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
