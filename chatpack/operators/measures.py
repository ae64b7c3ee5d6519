"""Measures of messages that are taken once, stored, and met again without a shuffle.

Messages and measures are tables of the same buckets, by record and offset in it, and sorted inside. So joining
them reads bucket by bucket: no side is exchanged, whatever their sizes, and a new index with another
bound does not measure again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatpack.operators.storage import folder

KEY = ["record_idx", "message_offset"]


def bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """``df`` (record_idx, message_offset, ...) as a table of buckets in the shared folder."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, *KEY)  # a file for each bucket
    rows.write.bucketBy(buckets, *KEY).sortBy(*KEY).option("path", folder(spark, "tables")).saveAsTable(name)
    return spark.table(name)


def buckets_for(rows: int, rows_per_bucket: int = 1_000_000) -> int:
    """A power of two, so that tables of different sizes can still meet bucket by bucket."""
    return 1 << max(0, -(-rows // rows_per_bucket) - 1).bit_length()


def with_measures(messages: DataFrame, measures: DataFrame) -> DataFrame:
    """Messages with their stored measures; a message without one is an error, measures without a message are left out."""
    names = [c for c in measures.columns if c not in KEY]
    known = measures.withColumn("__known", F.lit(True))
    found = messages.hint("merge").join(known.hint("merge"), KEY, "left")
    missing = F.raise_error(F.concat(F.lit("no measure of message "), F.col(KEY[1]), F.lit(" of record "), F.col(KEY[0])))
    checked = F.when(F.col("__known"), F.col(names[0])).otherwise(missing.cast(measures.schema[names[0]].dataType))
    return found.withColumn(names[0], checked).drop("__known")
