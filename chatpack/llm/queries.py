"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatpack.llm import bpe, licenses, mixing, quality_model, quality_rules, ranked, secrets, simhash, spelling, suffixes, toxicity, urls, vectors
from chatpack.llm.oracles import ORACLE_SQL as ORACLE_SQL

#: The public vocabulary that the token queries use; operators take any path.
VOCABULARY = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, block, place, slot, release, deadline of every document."""
    return mixing.report(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    return secrets.digests(table(spark, sf_dir, "documents"))


#: Fixed values of the url query: verdict, host and path of each rule.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every page."""
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, word and place counts, labels and score of every document."""
    return licenses.digests(table(spark, sf_dir, "documents"))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return quality_model.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, score and verdict of every document; the documents of quality 1 are the target."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality_rules.score_documents(table(spark, sf_dir, "documents"), trusted)


def op11_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return suffixes.digests(table(spark, sf_dir, "documents"))


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score of the ten best documents of each benchmark item."""
    return ranked.best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of all documents."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op3_secrets that the fixed patterns give."""
    return op3_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host, path, rule of op4_urls, and the rule's verdict."""
    verdict = F.when(F.col("label") == 1, "allow").when(F.col("label") == 0, "block").alias("rule_verdict")
    return urls.with_rule(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", verdict)


def license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5_licenses that the phrases give."""
    return op5_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10_quality_rules that the plain rules give."""
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return op10_quality_rules(spark, sf_dir).select(*columns)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_mixing": op2_mixing,
    "op3_secrets": op3_secrets,
    "op4_urls": op4_urls,
    "op5_licenses": op5_licenses,
    "op6_quality_model": op6_quality_model,
    "op7_simhash": op7_simhash,
    "op8_toxicity": op8_toxicity,
    "op9_vectors": op9_vectors,
    "op10_quality_rules": op10_quality_rules,
    "op11_suffixes": op11_suffixes,
    "op12_ranked": op12_ranked,
    "op13_spelling": op13_spelling,
    "secret_counts": secret_counts,
    "url_rules": url_rules,
    "license_places": license_places,
    "quality_counts": quality_counts,
}
