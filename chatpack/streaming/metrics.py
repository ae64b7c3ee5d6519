"""A sink for metrics of a stream that writes each micro-batch once, however often it is replayed.

A micro-batch is summed by step and goes to a folder named by its number, which it replaces: a batch that failed
half-way, or is given again after a restart, leaves one copy. Reading adds the batches' sums, so that means are over
all rows of a step, and keeps the steps that are due.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chatpack.functions import perf


def metrics_sink(rows: DataFrame, path: str, checkpoint: str, step: str, means: tuple[str, ...], sums: tuple[str, ...] = ()) -> StreamingQuery:
    """Starts the sink of a stream (step, means..., sums...) over what is there now; null values count in no mean."""

    def write(batch: DataFrame, number: int) -> None:
        cells = [c for m in means for c in (F.sum(m).alias(f"sum_{m}"), F.count(m).alias(f"n_{m}"))] + [F.sum(s).alias(f"sum_{s}") for s in sums]
        batch.groupBy(F.col(step).alias("step")).agg(F.count(F.lit(1)).alias("rows"), *cells).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_metrics(spark: SparkSession, path: str, means: tuple[str, ...], sums: tuple[str, ...] = (), every: int = 1) -> DataFrame:
    """(step, rows, means..., sums...) of the steps that are due every so many."""
    found = spark.read.parquet(path).where(perf.due(F.col("step"), every))
    cells = [(F.sum(f"sum_{m}") / F.sum(f"n_{m}")).alias(m) for m in means] + [F.sum(f"sum_{s}").alias(s) for s in sums]
    return found.groupBy("step").agg(F.sum("rows").alias("rows"), *cells)
