"""Deterministic epochs over records: shuffle, shards, batches and exact resume.

An epoch's order is that of a digest of seed, epoch and record number, so it does not
depend on partitions. Positions are computed without a window over all rows: a digest's
first bits give its bucket, buckets are counted, and a record's position is the records
of earlier buckets plus its place in its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Records of a bucket, about.
BUCKET = 50_000


def shuffle_key(idx: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), idx.cast("string")))


def shards(records: DataFrame, n: int, dp_size: int, idx: str = "record_idx") -> DataFrame:
    """Adds dp_index: equal contiguous ranges of the records; the remainder is dropped. One shard if dp_size <= 1."""
    if dp_size <= 1:
        return records.withColumn("dp_index", F.lit(0).cast("long"))
    own = n // dp_size
    if own <= 0:
        raise ValueError("fewer records than shards")
    return records.where(F.col(idx) < own * dp_size).withColumn("dp_index", F.floor(F.col(idx) / own).cast("long"))


def epochs(records: DataFrame, n: int, num_epochs: int = 1, seed: int = 0, shuffle: bool = True, dp_size: int = 1, idx: str = "record_idx") -> DataFrame:
    """Records once for each epoch with epoch, dp_index and position (from 0 over all epochs of a shard).

    ``n`` is the number of records, which have numbers from 0 to n - 1 in ``idx``.
    """
    own = n // max(1, dp_size)
    rows = shards(records, n, dp_size, idx).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(num_epochs - 1).cast("long"))))
    if not shuffle:
        return rows.withColumn("position", F.col("epoch") * own + F.col(idx) - F.col("dp_index") * own)
    n_buckets = max(1, -(-own // BUCKET))
    group = ["dp_index", "epoch"]
    keyed = rows.withColumn("__key", shuffle_key(F.col(idx), F.col("epoch"), seed)).withColumn(
        "__bucket", F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("long") * n_buckets / (1 << 32)))
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    earlier = keyed.groupBy(*group, "__bucket").count().select(*group, "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__earlier"))
    inside = Window.partitionBy(*group, "__bucket").orderBy("__key", idx)
    return keyed.withColumn("__nth", F.row_number().over(inside)).join(earlier, [*group, "__bucket"]).withColumn(
        "position", (F.col("epoch") * own + F.col("__earlier") + F.col("__nth") - 1).cast("long")).drop("__key", "__bucket", "__nth", "__earlier")


def batches(stream: DataFrame, total: int, batch_size: int, start_batch: int = 0) -> DataFrame:
    """Adds batch_id and slot from position; the remainder is dropped, and batches before ``start_batch`` are skipped.

    ``total`` is the length of a shard's stream. Resuming after batch k is ``start_batch=k + 1``.
    """
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    full = total // batch_size * batch_size
    return stream.where((F.col("position") < full) & (F.col("position") >= start_batch * batch_size)).withColumns(
        {"batch_id": F.floor(F.col("position") / batch_size).cast("long"), "slot": F.pmod("position", F.lit(batch_size)).cast("long")})


def required_epochs(num_records: int, batch_size: int, num_batches: int, dp_size: int = 1) -> int:
    """Epochs that a shard needs for so many batches; 1 for none."""
    own = num_records // max(1, dp_size)
    if own <= 0:
        raise ValueError("fewer records than shards")
    return 1 if num_batches <= 0 else max(1, -(-batch_size * num_batches // own))


def local_batch(global_batch: int, dp_size: int) -> int:
    if global_batch % dp_size:
        raise ValueError("the global batch must divide by the number of shards")
    return global_batch // dp_size


def data_parallel_index(process: int, dp_size: int) -> int:
    return process % dp_size


def validation_batches(num_steps: int, val_every: int, val_steps: int) -> int:
    return max(1, num_steps // max(val_every or num_steps, 1) * val_steps)


def collate(batched: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` (pandas frame of one batch, in slot order, to a frame) applied to each batch."""
    return batched.groupBy("dp_index", "batch_id").applyInPandas(lambda pdf: fn(pdf.sort_values("slot")), schema)
