"""A streaming source of training batches, whose offset is the batch number.

The source holds no records: a batch is the addresses of its records, computed from their places in the
epoch permutation, and a join with the records table fetches them. So the checkpoint of a streaming query is the
state of the iterator: a query that is started again goes on with the batch after the last one committed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from chatpack.operators import permute

SCHEMA = "dp_index bigint, batch_id bigint, slot bigint, epoch bigint, position bigint, record_idx bigint"
#: Positions that one task gives.
SLICE = 1 << 20


@dataclass
class Slice(InputPartition):
    """Positions first to last - 1 of a shard."""

    shard: int
    first: int
    last: int


class TrainingBatches(DataSource):
    """Options: records, batch_size, num_epochs, seed, dp_size, shuffle, start_batch, and until (the batch to stop before)."""

    @classmethod
    def name(cls) -> str:
        return "training_batches"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> BatchReader:
        return BatchReader({k.lower(): v for k, v in self.options.items()})


class BatchReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        number = lambda name, default=None: int(options[name] if default is None else options.get(name, default))
        self.batch_size, self.seed, self.shards = number("batch_size"), number("seed", 0), max(1, number("dp_size", 1))
        self.shuffle = str(options.get("shuffle", "true")).lower() == "true"
        self.own = number("records") // self.shards
        if self.batch_size <= 0 or self.own <= 0:
            raise ValueError("batch_size and the records of a shard must be positive")
        self.total = self.own * number("num_epochs", 1) // self.batch_size
        self.start = min(number("start_batch", 0), self.total)
        self.until = min(number("until", self.total), self.total)

    def initialOffset(self) -> dict:
        return {"batch": self.start}

    def latestOffset(self) -> dict:
        return {"batch": self.until}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        first, last = start["batch"] * self.batch_size, end["batch"] * self.batch_size
        return [Slice(s, at, min(at + SLICE, last)) for s in range(self.shards) for at in range(first, last, SLICE)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        for at in range(partition.first, partition.last, 1 << 16):
            position = np.arange(at, min(at + (1 << 16), partition.last))
            epoch = position // self.own
            record = position - epoch * self.own
            if self.shuffle:
                for e in np.unique(epoch).tolist():
                    record[epoch == e] = permute.record(record[epoch == e], self.own, self.seed, e, partition.shard)
            shard = np.full(len(position), partition.shard)
            columns = [shard, position // self.batch_size, position % self.batch_size, epoch, position, record + partition.shard * self.own]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=[f.split()[0] for f in SCHEMA.split(", ")])


def batch_stream(spark: SparkSession, **options) -> DataFrame:
    """The stream of batches; see ``TrainingBatches`` for the options."""
    spark.dataSource.register(TrainingBatches)
    return spark.readStream.format("training_batches").options(**{k: str(v) for k, v in options.items()}).load()
