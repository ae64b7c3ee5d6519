"""Mixing sources to target weights by Pfair scheduling.

The documents of a source form blocks of a fixed number of rows. With a weight w, block j
of a source is released at slot floor(j / w) and has its deadline at ceil((j + 1) / w). Of
the released blocks each slot takes the one with the earliest deadline. As the weights
add up to one, every deadline is met, so at any slot a source is less than one block from
its share, as long as it has blocks. Slots of a source that has run out stay empty.

Releases and deadlines come from the target weights themselves, in whole numbers without
rounding. The blocks are dealt by one task, which holds one entry for each source and
passes over the blocks (a row for each ``BLOCK_ROWS`` documents at most, and no texts); it jumps over
slots for which no block is left. All else is columns: a row's rank in its source
gives its block, and the block gives its slot.

Ranks need no task that sees a whole source. Rows are put in buckets by the first digits of the digest of
their id, about the square root of all rows in each; a row's rank is the rows in earlier
buckets of its source plus its place in its bucket. A hot source has more buckets.

Defined results: rows with a null source form the source "(none)"; sources that given
weights leave out share one weight as "(other)"; every row keeps its place once (in a source by
the digest of its id, then the id; rows without an id come by the digest of nothing); no row is dropped; an empty table gives an empty table. Columns
of the input keep their names and values, whatever they are.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatpack.llm.components import stored

BLOCK_ROWS = 64
#: Default weights are the square roots of the numbers of rows, in whole parts of so many.
ROOT_PARTS = 1024
NONE, OTHER = "(none)", "(other)"


def dealt(sources, total: int):
    """(source, block, slot, release, deadline) of all blocks of ``sources`` (source, weight, blocks), by earliest deadline first.

    Weights are whole numbers of which all sources, also those without blocks, have ``total``.
    """
    ready: list[tuple] = []
    waiting = [(0, -(-total // k), s, 0, k, n) for s, k, n in sources if n]  # by release
    heapq.heapify(waiting)
    now = 0
    while waiting or ready:
        if not ready and waiting[0][0] > now:
            now = waiting[0][0]  # the slots up to there belong to sources that have run out
        while waiting and waiting[0][0] <= now:
            release, deadline, s, j, k, n = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, j, release, k, n))
        deadline, s, j, release, k, n = heapq.heappop(ready)
        yield s, j, now, release, deadline
        now += 1
        if j + 1 < n:
            heapq.heappush(waiting, ((j + 1) * total // k, -(-(j + 2) * total // k), s, j + 1, k, n))


def whole(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the ratios of ``weights``."""
    exact = [Fraction(w) for w in weights]
    scale = max((x.denominator for x in exact), default=1)  # powers of two: the largest holds all
    return [int(x * scale) for x in exact]


def _deal(batches):
    rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("mix_source", "weight", "blocks")))]
    weights = whole([w for _, w, _ in rows])
    plan = dealt([(s, k, n) for (s, _, n), k in zip(rows, weights)], sum(weights))
    names = ["mix_source", "block", "slot", "release", "deadline"]
    while part := [x for _, x in zip(range(8192), plan)]:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], names=names)


def source_of(source: Column, named: list[str] | None) -> Column:
    own = F.coalesce(source.cast("string"), F.lit(NONE))
    return own if named is None else F.when(own.isin(named), own).otherwise(OTHER)


def placed(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(row, mix_source, block, place, slot, release, deadline): each row of ``docs`` as a struct, with its place in the mix.

    ``weights`` has the target weight of each source; sources it leaves out share the
    smallest of them. Without it, weights are the square roots of the sources' sizes.
    """
    if weights and any(w <= 0 for w in weights.values()):
        raise ValueError("weights are positive")
    named = sorted(weights) if weights else None
    sizes = stored(docs.groupBy(source_of(F.col("source"), named).alias("mix_source")).agg(F.count(F.lit(1)).alias("n_rows")))
    total = sizes.agg(F.sum("n_rows")).first()[0] or 0
    per_bucket = max(1024, int(total**0.5))
    sizes = sizes.withColumn("n_buckets", F.ceil(F.col("n_rows") / per_bucket))
    if weights:
        own = docs.sparkSession.createDataFrame([*weights.items(), *([(OTHER, min(weights.values()))] if OTHER not in weights else [])], "mix_source string, weight double")
        # A source that is named keeps its slots even without rows; "(other)" has some only with rows.
        shares_ = own.join(sizes, "mix_source", "left").where(F.col("n_rows").isNotNull() | F.col("mix_source").isin(named))
    else:
        shares_ = sizes.withColumn("weight", F.floor(F.sqrt("n_rows") * ROOT_PARTS).cast("double"))
    blocks = F.ceil(F.coalesce("n_rows", F.lit(0)) / block_rows).cast("long")
    kind = "mix_source string, block long, slot long, release long, deadline long"
    plan = stored(shares_.select("mix_source", "weight", blocks.alias("blocks")).coalesce(1).mapInArrow(_deal, kind))

    digest = F.md5(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = (
        docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        .withColumn("mix_source", source_of(F.col("row.source"), named))
        .join(sizes.select("mix_source", "n_buckets"), "mix_source")
        .withColumn("digest", digest)
        .withColumn("bucket", F.expr("cast(conv(substr(digest, 1, 8), 16, 10) as long) * n_buckets div 4294967296L"))
    )
    before = Window.partitionBy("mix_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("mix_source", "bucket").count().select("mix_source", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("mix_source", "bucket").orderBy("digest", "row.doc_id")
    ranked = rows.withColumn("nth", F.row_number().over(inside)).join(offsets, ["mix_source", "bucket"])
    rank = F.col("earlier") + F.col("nth") - 1
    block = F.floor(rank / block_rows).cast("long")
    return (
        ranked.select("row", "mix_source", block.alias("block"), F.pmod(rank, F.lit(block_rows)).cast("long").alias("place"))
        .join(plan, ["mix_source", "block"]).select("row", "mix_source", "block", "place", "slot", "release", "deadline")
    )


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` in the order of the mix: ranges of slots by partition, sorted inside, so that written files follow it."""
    order = ["slot", "place"]
    ordered = placed(docs, weights, block_rows).select("row", *order).repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def report(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id and the place in the mix of every document."""
    return placed(docs.select("doc_id", "source"), weights).select(
        "row.doc_id", "row.source", "block", "place", "slot", "release", "deadline"
    )
