"""Global positions without a task that sees all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def buckets_of(key: str, rows_per_bucket: int, total: int):
    """The bucket of a hex digest by its first 8 digits, in the digest's order."""
    n = max(1, -(-total // rows_per_bucket))
    return (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * n / F.lit(1 << 32)).cast("long")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the 0-based place of each row in ``order``, which must be total.

    Range partitions are in order and sorted inside; the partition number and the place in it
    are kept, partitions are counted, and their offsets (one row for each partition) are
    added. Sampled ranges may differ between runs of a plan, so rows are placed once and
    stored before they are counted.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns(
        {"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}
    )
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        path = f"{folder.rstrip('/')}/tables/{uuid.uuid4().hex}"
        placed.write.parquet(path)
        placed = spark.read.schema(placed.schema).parquet(path)
    elif spark.sparkContext.master.split("[")[0] == "local":
        placed = placed.persist()
    else:
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    counts = placed.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", "__first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__earlier"))
    return placed.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__earlier") + F.col("__at") - F.col("__first")).drop("__part", "__at", "__first", "__earlier")
