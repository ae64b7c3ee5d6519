"""Greedy next-fit packing of messages into bounded chunks, and resolving chunks to messages.

A chunk holds consecutive messages of one session. A message that does not fit starts a new
chunk; no message is split. The fold needs a session's messages in order and a running
sum that resets on its own value, which no window frame can express.

Messages lie in range partitions, so a session of any length is packed by many tasks. A partition
packs its own sessions for good. Its first session may have begun in an earlier one, whose open chunk is not known yet.
But whatever is open, packing goes on from the first message that does not fit, and from there the chunk
starts are a chain: the start after each message is found on prefix sums, and doubling these pointers gives where
the chain of each possible first start ends. This *transfer* has no more entries than a chunk has
messages. Folding a session's transfers gives what is open before each partition; then the first sessions are packed again from there.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatpack.operators.storage import stored

#: Messages up to which a session is packed by one task.
SESSION_ROWS = 1_000_000


class Fold:
    """Next-fit over messages of one session: ``chunk``, its ``total``, and whether it holds messages."""

    def __init__(self, max_length: int, total: int = 0, chunk: int = 0, used: bool = False):
        self.most, self.total, self.chunk, self.used = max_length, total, chunk, used

    def add(self, size: int) -> int:
        """The chunk of the next message."""
        if self.used and self.total + size > self.most:
            self.chunk, self.total = self.chunk + 1, 0
        self.total, self.used = self.total + size, True
        return self.chunk


class Transfer:
    """What messages make of an open chunk: (total, chunk) before them to (total, chunk) after them."""

    def __init__(self, sizes: np.ndarray, max_length: int):
        n, self.most = len(sizes), max_length
        ends = np.cumsum(sizes)
        begins = ends - sizes
        # The next start after a chunk that starts at each message; a message over the bound is alone.
        after = np.maximum(np.searchsorted(ends, begins + max_length, "right"), np.arange(n) + 1)
        last, more = np.where(after < n, after, np.arange(n)), (after < n).astype(np.int64)
        for _ in range(n.bit_length()):
            more, last = more + more[last], last[last]
        # First starts: the first message, and those that a chunk open before can just not hold.
        able = (begins <= max_length) & ((sizes > 0) | (np.arange(n) == 0))
        self.ends, self.total, self.chunks = ends[able], (ends[-1] - begins[last])[able], more[able]
        self.whole = int(ends[-1])

    def after(self, total: int, chunk: int) -> tuple[int, int]:
        at = int(np.searchsorted(self.ends, self.most - total, "right"))
        if at == len(self.ends):
            return total + self.whole, chunk
        return int(self.total[at]), chunk + 1 + int(self.chunks[at])


def assign_chunks(messages: DataFrame, max_length: int, session: str = "session_id", position: str = "message_idx", length: str = "length", oversize: str = "raise", session_rows: int = SESSION_ROWS) -> DataFrame:
    """Adds chunk_id (from 0 in each session) to messages (session, position, length, ...).

    A message longer than ``max_length`` is an error, or with ``oversize="own"`` a chunk of its own. Tables whose sessions all
    have at most ``session_rows`` messages are spread by session; others by ranges, which cut sessions. The result is the same.
    """
    if max_length <= 0:
        raise ValueError("max_length must be positive")
    if oversize not in ("raise", "own"):
        raise ValueError("oversize is raise or own")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in messages.schema)
    if messages.groupBy(session).count().where(F.col("count") > session_rows).isEmpty():
        ordered = messages.repartition(session).sortWithinPartitions(session, position)
        fold = _pack(max_length, session, length, oversize, False)
        return ordered.mapInArrow(fold, f"{kinds}, chunk_id bigint, __head boolean, __left binary").drop("__head", "__left")
    ordered = messages.repartitionByRange(session, position).sortWithinPartitions(session, position).withColumn("__part", F.spark_partition_id())
    local = stored(ordered.mapInArrow(_pack(max_length, session, length, oversize, True), f"{kinds}, __part int, chunk_id bigint, __head boolean, __left binary"))
    left = local.where("__left is not null").select(F.col(session).alias("__session"), "__part", "__left")
    before = stored(left.repartition("__session").sortWithinPartitions("__session", "__part").mapInArrow(_fold_parts, "__part int, __total bigint, __chunk bigint"))
    heads = local.join(before, "__part", "left")
    goes_on = F.col("__head") & F.col("__chunk").isNotNull()
    again = heads.where(goes_on).repartition("__part").sortWithinPartitions("__part", position)
    packed = again.mapInArrow(_repack(max_length, length, messages.columns), f"{kinds}, chunk_id bigint")
    return heads.where(~goes_on).select(*messages.columns, "chunk_id").unionByName(packed)


def _pack(max_length: int, session: str, length: str, oversize: str, parts: bool):
    """Packs sorted sessions. With ``parts``, rows of the first session are marked, and two rows say what they leave:
    the partition's last one (transfer of the first session if it is the last one too, total, chunk), and
    the last one of a first session that ends here, with nothing."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, own, sizes, held = None, None, Fold(max_length), [], None
        for batch in batches:
            n = batch.num_rows
            keys, lengths = batch.column(session).to_pylist(), batch.column(length).to_pylist()
            out, head, left = np.zeros(n, np.int64), np.zeros(n, bool), [None] * (n + 1)
            for i, (key, size) in enumerate(zip(keys, lengths)):
                if oversize == "raise" and size > max_length:
                    raise ValueError(f"a message of session {key} has length {size}, more than {max_length}")
                if last is None or key != last[0]:
                    if first is None:
                        first = (key,)
                    elif last == first:
                        left[i] = b""  # of the row before; place 0 is the row that is held
                    last, own = (key,), Fold(max_length)
                out[i] = own.add(size)
                if parts and last == first:
                    head[i] = True
                    sizes.append(size)
            names = [*batch.schema.names, "chunk_id", "__head", "__left"]
            columns = [*batch.columns, pa.array(out), pa.array(head)]
            if not parts:
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.binary())], names=names)
            elif n:
                # The last row waits: only the partition's very last one gets what is left.
                if held is not None:
                    yield pa.RecordBatch.from_arrays([*held, pa.array(left[:1], pa.binary())], names=names)
                held = [c.slice(n - 1) for c in columns]
                yield pa.RecordBatch.from_arrays([*(c.slice(0, n - 1) for c in columns), pa.array(left[1:n], pa.binary())], names=names)
        if held is not None:
            through = Transfer(np.array(sizes, np.int64), max_length) if last == first else None
            yield pa.RecordBatch.from_arrays([*held, pa.array([pickle.dumps((through, own.total, own.chunk))], pa.binary())], names=names)

    return fold


def _fold_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is open before each partition into which a session goes on, from its partitions in order."""
    last, state = None, None
    for batch in batches:
        rows = []
        for key, part, left in zip(*[c.to_pylist() for c in batch.columns]):
            if last is None or last[0] != key:
                last, state = (key,), None
            if state is not None:
                rows.append((part, *state))
            if left:
                through, total, chunk = pickle.loads(left)
                state = through.after(*state) if through and state else (total, chunk)
        kinds = (pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["__part", "__total", "__chunk"])


def _repack(max_length: int, length: str, columns: list[str]):
    """Packs the first sessions of partitions again, after what is open before them."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own = None, None
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            for i, (p, total, chunk, size) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("__part", "__total", "__chunk", length)])):
                if p != part:
                    part, own = p, Fold(max_length, total, chunk, True)
                out[i] = own.add(size)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out)], names=[*columns, "chunk_id"])

    return fold


def describe_chunks(assigned: DataFrame, session: str = "session_id", position: str = "message_idx", length: str = "length", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row for each chunk: its range of positions, messages and sums of the measures."""
    return assigned.groupBy(session, "chunk_id").agg(
        F.min(position).alias("first_message"), F.max(position).alias("last_message"), F.count("*").alias("num_messages"),
        F.sum(length).cast("long").alias("measured_length"), *[F.sum(c).cast("long").alias(c) for c in extra],
    )


def block_range(chunks: DataFrame, messages_per_record: int, first: str = "first_message", last: str = "last_message") -> DataFrame:
    """Adds the chunk's pointers into fixed-size blocks: block and offset of its start, and of its end (exclusive offset)."""
    n = messages_per_record
    return chunks.withColumns({
        "start_block": F.floor(F.col(first) / n).cast("long"), "start_message_offset": F.pmod(F.col(first), F.lit(n)).cast("long"),
        "end_block": F.floor(F.col(last) / n).cast("long"), "end_message_offset": (F.pmod(F.col(last), F.lit(n)) + 1).cast("long"),
    })


def resolve(chunks: DataFrame, records: DataFrame) -> DataFrame:
    """Chunks (session_id, chunk_id, start_block, ...) with their messages from block records, and the first block's meta.

    The range of blocks is unfolded, so that the join is on equal keys; a chunk's blocks are
    then put in order and cut at both ends.
    """
    wanted = chunks.select("*", F.explode(F.sequence("start_block", "end_block")).alias("block_idx"))
    joined = wanted.join(records.select("session_id", "block_idx", "session_meta", "messages"), ["session_id", "block_idx"])
    from_ = F.when(F.col("block_idx") == F.col("start_block"), F.col("start_message_offset")).otherwise(0)
    until = F.when(F.col("block_idx") == F.col("end_block"), F.col("end_message_offset")).otherwise(F.size("messages"))
    part = F.slice("messages", (from_ + 1).cast("int"), (until - from_).cast("int"))
    keys = [c for c in chunks.columns]
    # Meta of the first block; variants cannot be compared, so blocks are sorted by their number only.
    got = joined.select(*keys, "block_idx", "session_meta", part.alias("part")).groupBy("session_id", "chunk_id").agg(
        *[F.first(c).alias(c) for c in keys if c not in ("session_id", "chunk_id")],
        F.min_by("session_meta", "block_idx").alias("session_meta"),
        F.map_from_entries(F.collect_list(F.struct("block_idx", "part"))).alias("parts"),
    )
    ordered = F.transform(F.sequence("start_block", "end_block"), lambda k: F.element_at("parts", k))
    return got.withColumn("messages", F.flatten(ordered)).drop("parts")


def checked_lengths(length: Column, max_length: int) -> Column:
    """``length``, or an error where it is over the bound; equal is allowed."""
    return F.when(length <= max_length, length).otherwise(F.raise_error(F.concat(F.lit("length exceeds max_length: "), length)).cast("long"))
