"""Epoch orders by a keyed permutation, which needs no shuffle, sort or count.

The place of record x in an epoch is p(x) for a permutation p of [0, n) that seed, epoch and shard key: in each
round x is exchanged with its partner (k - x) mod n or not, by a keyed bit of the larger of the two. Partners
agree on the bit, so a round is its own inverse for any n, and the rounds backwards lead from
a place to its record. So a stream is entered at any batch by looking up the records of its places.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatpack.operators import iterate

# Fixed values of the mixing function: a prime, factors and steps.
PRIME, FACTORS, STEPS = (1 << 31) - 1, (1103515245, 69069069, 1597334677), (12345, 13, 16, 7)


def mixed(x, key):
    """A number below PRIME from two that are not negative."""
    t = (x % PRIME * FACTORS[0] + x // PRIME * STEPS[0] + key) % PRIME
    t = ((t ^ (t >> STEPS[1])) * FACTORS[1] + STEPS[0]) % PRIME
    return ((t ^ (t >> STEPS[2])) * FACTORS[2] + key) % PRIME


def round_keys(n: int, seed: int, epoch: int, shard: int) -> list[tuple[int, int]]:
    """(partner sum, bit key) of each round: three rounds for each bit of n."""
    base = mixed(mixed(mixed(abs(seed), 1) + epoch, 2) + shard, 3)
    keys = [(mixed(base + r, 4), mixed(base + r, 5)) for r in range(3 * n.bit_length())]
    return [((a * PRIME + b) % n, a) for a, b in keys]


def _turn(x: np.ndarray, n: int, keys: list[tuple[int, int]]) -> np.ndarray:
    for total, key in keys:
        partner = (total - x) % n
        x = np.where((mixed(np.maximum(x, partner), key) >> STEPS[3]) & 1, partner, x)
    return x


def place(x: np.ndarray, n: int, seed: int, epoch: int = 0, shard: int = 0) -> np.ndarray:
    """Places of records in an epoch."""
    return _turn(np.asarray(x, np.int64), n, round_keys(n, seed, epoch, shard))


def record(places: np.ndarray, n: int, seed: int, epoch: int = 0, shard: int = 0) -> np.ndarray:
    """Records at places of an epoch."""
    return _turn(np.asarray(places, np.int64), n, round_keys(n, seed, epoch, shard)[::-1])


def _column(way, n: int, seed: int):
    """``way`` as a function of columns (number, epoch, shard), a batch at a time."""

    @F.pandas_udf("long")
    def of(x: pd.Series, epoch: pd.Series, shard: pd.Series) -> pd.Series:
        out = np.zeros(len(x), np.int64)
        for (e, s), rows in x.groupby([epoch.to_numpy(), shard.to_numpy()]).indices.items():
            out[rows] = way(x.to_numpy()[rows], n, seed, int(e), int(s))
        return pd.Series(out)

    return of


def epochs(records: DataFrame, n: int, num_epochs: int = 1, seed: int = 0, dp_size: int = 1, idx: str = "record_idx") -> DataFrame:
    """Records once for each epoch with epoch, dp_index and position, as ``iterate.epochs`` gives, in the permutation's order."""
    own = n // max(1, dp_size)
    rows = iterate.shards(records, n, dp_size, idx).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(num_epochs - 1).cast("long"))))
    at = _column(place, own, seed)(F.col(idx) - F.col("dp_index") * own, F.col("epoch"), F.col("dp_index"))
    return rows.withColumn("position", F.col("epoch") * own + at)


def addresses(spark: SparkSession, n: int, first: int, count: int, seed: int = 0, dp_size: int = 1) -> DataFrame:
    """(dp_index, position, epoch, record_idx) of ``count`` positions from ``first`` on, in each shard, without reading records."""
    shards = max(1, dp_size)
    own = n // shards
    if own <= 0:
        raise ValueError("fewer records than shards")
    rows = spark.range(count * shards).select((F.col("id") % shards).alias("dp_index"), (F.floor(F.col("id") / shards) + first).alias("position"))
    rows = rows.withColumn("epoch", F.floor(F.col("position") / own))
    at = _column(record, own, seed)(F.col("position") - F.col("epoch") * own, F.col("epoch"), F.col("dp_index"))
    return rows.withColumn("record_idx", at + F.col("dp_index") * own)


def batches(records: DataFrame, n: int, batch_size: int, first_batch: int, num_batches: int, seed: int = 0, dp_size: int = 1, idx: str = "record_idx") -> DataFrame:
    """Records of some batches with dp_index, position, epoch, batch_id and slot: only addressed records are joined."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    wanted = addresses(records.sparkSession, n, first_batch * batch_size, num_batches * batch_size, seed, dp_size).withColumnRenamed("record_idx", idx)
    found = records.join(wanted, idx)
    return found.withColumns({"batch_id": F.floor(F.col("position") / batch_size).cast("long"), "slot": F.pmod("position", F.lit(batch_size)).cast("long")})
