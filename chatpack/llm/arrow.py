"""Small helpers for Arrow-batched work inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], list]],
    schema: StructType | str,
    names: list[str],
) -> DataFrame:
    """Map Arrow batches of ``df`` to batches with the columns ``names``.

    ``make`` runs once per task and returns the function that turns a batch into
    a list of columns (Python lists or Arrow arrays), so that models are unpacked
    once per task and never once per row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                for part in pieces(batch):
                    yield pa.RecordBatch.from_arrays([_array(x) for x in step(part)], names=names)

    return df.mapInArrow(run, schema)


def _array(x) -> pa.Array:
    return x if isinstance(x, pa.Array) else pa.array(x)


def pieces(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, so that results of long texts are not held for a whole batch."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def texts(batch: pa.RecordBatch, name: str) -> Iterator[str]:
    """The strings of a column, null as the empty string."""
    for x in batch.column(name):
        yield x.as_py() or ""


def raw_texts(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    for x in batch.column(name).cast(pa.binary()):
        yield x.as_py() or b""
