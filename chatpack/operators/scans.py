"""Running values over ordered rows, in two phases and without a task for each key.

Rows go to range partitions, so that a key with very many rows lies in many of them. One pass over a
partition gives its rows running values as if the partition stood alone, and one summary: the keys at its ends and
the values that its last run leaves. The summaries, one for each partition, are chained on the driver into
what each partition takes over from those before it, and that is added to the rows of
its first run.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatpack.operators.storage import stored

#: How a running value is made: ("sum", column), ("first", column), ("lag", column, k) or ("lead", column).
Running = tuple


def scan(df: DataFrame, order: list[str], keys: list[str], running: dict[str, Running]) -> DataFrame:
    """Adds running values to rows in a total ``order``; they start anew wherever one of ``keys`` changes.

    sum: of the run's rows so far, this one included, null as 0. first: the value of the run's first row. lag: the value
    k rows before, lead: of the next row; null beyond the run. Keys may be null, and null equals null.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    added = {n: _kind(kinds[own[1]], own[0]) for n, own in running.items()}
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    helpers = {"__head": T.BooleanType(), "__at": T.LongType(), "__summary": T.BinaryType()}
    schema = T.StructType([*ordered.schema, *(T.StructField(n, t) for n, t in (added | helpers).items())])
    local = stored(ordered.mapInArrow(_pass(keys, running), schema))
    taken = _chain(local, running)
    fields = [T.StructField(f"__{n}", T.ArrayType(added[n]) if own[0] == "lag" else added[n]) for n, own in running.items()]
    schema = T.StructType([T.StructField("__part", T.IntegerType()), T.StructField("__has", T.BooleanType()), T.StructField("__follows", T.BooleanType()), *fields])
    over = df.sparkSession.createDataFrame(taken, schema)  # at most a row for each partition
    return local.join(F.broadcast(over), "__part", "left").select(*df.columns, *[_with(n, own).alias(n) for n, own in running.items()])


def _kind(kind: T.DataType, how: str) -> T.DataType:
    return kind if how != "sum" else T.LongType() if isinstance(kind, T.IntegralType) else T.DoubleType()


def _with(name: str, own: Running):
    """A running value together with what its partition takes over."""
    local, over = F.col(name), F.col(f"__{name}")
    head = F.col("__head") & F.col("__has")
    if own[0] == "sum":
        return F.when(head, local + over).otherwise(local)
    if own[0] == "first":
        return F.when(head, over).otherwise(local)
    if own[0] == "lag":
        at = F.size(over) - own[2] + F.col("__at").cast("int")
        return F.when(head & (F.col("__at") < own[2]), F.get(over, at)).otherwise(local)
    return F.when(F.col("__summary").isNotNull() & F.col("__follows"), over).otherwise(local)


def _changed(column: pa.Array) -> np.ndarray:
    a, b = column.slice(0, len(column) - 1), column.slice(1)
    differs = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(differs, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _totals(column: pa.Array, run: np.ndarray, before) -> np.ndarray:
    """Running sums of each run; ``before`` is the sum that the first row's run has already, that row included."""
    values = pc.fill_null(column, 0).to_numpy(zero_copy_only=False)
    values = values.astype(np.int64 if values.dtype.kind in "iu" else np.float64)
    if before is not None:
        values = np.concatenate([[before], values[1:]]).astype(values.dtype)
    if values.dtype == np.float64:
        return pd.Series(values).groupby(run).cumsum().to_numpy()
    sums = np.cumsum(values)
    starts = np.flatnonzero(np.diff(run, prepend=-1))
    return sums - np.repeat(np.where(starts > 0, sums[starts - 1], 0), np.diff(np.append(starts, len(run))))


def _pass(keys: list[str], running: dict[str, Running]):
    """The pass over one partition. The last row is held back until the next is known, or gets the summary."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, its place in its run, whether the run is the first one, and its running values
        first, rows = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is None:
                first = {"key": [batch.column(k)[0].as_py() for k in keys], "lead": {n: batch.column(own[1])[0].as_py() for n, own in running.items() if own[0] == "lead"}}
                rows, at, head, past = batch, 0, True, {}
            else:
                row, at, head, past = held
                rows = pa.Table.from_batches([row, batch]).combine_chunks().to_batches()[0]
            out, held = _batch(rows, keys, running, at, head, past)
            if rows.num_rows > 1:
                yield out.slice(0, rows.num_rows - 1)
        if held is not None:
            row, at, head, past = held
            last = out.slice(rows.num_rows - 1)
            summary = {"first": first, "key": [row.column(k)[0].as_py() for k in keys], "single": head, "values": {n: past[n] for n, own in running.items() if own[0] in ("sum", "first")}}
            summary["values"] |= {n: past[n][-own[2] :] for n, own in running.items() if own[0] == "lag"}
            columns = [*last.columns[:-1], pa.array([pickle.dumps(summary)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=last.schema.names)

    return go


def _batch(rows, keys, running, at, head, past):
    """Running values of some rows, and what the row after them needs of the last one.

    ``at``, ``head`` and ``past`` are those of the first row if it has been seen before: ``past`` has sums and first values, and the
    values that lag may ask for, its own included.
    """
    n = rows.num_rows
    new = np.zeros(n, bool)
    for k in keys:
        new[1:] |= _changed(rows.column(k))
    run = np.cumsum(new)
    index = np.arange(n)
    start = np.maximum.accumulate(np.where(new, index, 0))
    place = index - start + np.where(run == 0, at, 0)
    out, left = [], {}
    for name, own in running.items():
        column = rows.column(own[1])
        if own[0] == "sum":
            values = pa.array(_totals(column, run, past.get(name)))
            left[name] = values[n - 1].as_py()
        elif own[0] == "first":
            known = pa.concat_arrays([pa.array([past[name]], column.type), column.slice(1)]) if name in past else column
            values = known.take(pa.array(start))
            left[name] = values[n - 1].as_py()
        elif own[0] == "lag":
            before = past.get(name, [])[:-1]
            known = pa.concat_arrays([pa.array(before, column.type), column])
            source = index + len(before) - own[2]
            values = known.take(pa.array(np.maximum(source, 0), mask=(place < own[2]) | (source < 0)))
            size = min(own[2] + 1, int(place[-1]) + 1)
            left[name] = known.slice(len(known) - min(size, len(known))).to_pylist()
        else:
            follows = np.append(~new[1:], False)
            values = column.take(pa.array(np.minimum(index + 1, n - 1), mask=~follows))
        out.append(values)
    is_head = head & (run == 0)
    helpers = [pa.array(is_head), pa.array(place), pa.nulls(n, pa.binary())]
    names = [*rows.schema.names, *running, "__head", "__at", "__summary"]
    return pa.RecordBatch.from_arrays([*rows.columns, *out, *helpers], names=names), (rows.slice(n - 1), int(place[-1]), bool(is_head[-1]), left)


def _chain(local: DataFrame, running: dict[str, Running]) -> list[tuple]:
    """What each partition takes over: (part, has, follows, values...)."""
    found = local.where("__summary is not null").select("__part", "__summary").collect()
    parts = [(r[0], pickle.loads(bytes(r[1]))) for r in sorted(found)]
    out, state, key = [], None, None
    for i, (part, own) in enumerate(parts):
        has = state is not None and key == own["first"]["key"]
        follows = i + 1 < len(parts) and parts[i + 1][1]["first"]["key"] == own["key"]
        row = []
        for name, how in running.items():
            if how[0] == "lead":
                row.append(parts[i + 1][1]["first"]["lead"][name] if follows else None)
            else:
                row.append(state[name] if has else None)
        if has or follows:
            out.append((part, has, follows, *row))
        values = dict(own["values"])
        if has and own["single"]:
            for name, how in running.items():
                if how[0] == "sum":
                    values[name] = state[name] + values[name]
                elif how[0] == "first":
                    values[name] = state[name]
                elif how[0] == "lag":
                    values[name] = [*state[name], *values[name]][-how[2] :]
        state, key = values, own["key"]
    return out
