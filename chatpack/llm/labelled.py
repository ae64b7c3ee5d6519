"""Bounded samples of labelled documents, for the classifiers that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, most: int) -> DataFrame:
    """(text, label) of at most about ``most`` labelled documents outside the held-out part.

    Beyond ``most`` a share of the labels is taken by the hash of their id. The sample's
    ids are bounded by that number, so they are broadcast. Conflicting labels of an id
    count as their largest.
    """
    own = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder(F.col("doc_id"), parts) != held_out))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    )
    n = own.count()
    if n > most:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most / n))
    return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("text", "label")


def is_held_out(parts: int, part: int) -> Column:
    return F.coalesce(remainder(F.col("doc_id"), parts) == part, F.lit(False))
