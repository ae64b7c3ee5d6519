"""Positions inside packed sequences, over (row, pos, ...) tables.

A row may hold any number of tokens: values that run along a row are two-phase scans over ranges of
positions, never windows over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatpack.operators.scans import scan


def segment_start(df: DataFrame, row: str, pos: str, segment: str) -> DataFrame:
    """Adds kstart: the position at which the token's segment began."""
    return scan(df, [row, pos], [row, segment], {"kstart": ("first", pos)})


def segment_positions(df: DataFrame, row: str, pos: str, segment: str) -> DataFrame:
    """Adds position: relative to the first token of the row's largest segment; padding (segment 0) gets 2^30."""
    first = df.groupBy(row, segment).agg(F.min(pos).alias("__first")).groupBy(row).agg(F.max_by("__first", segment).alias("__first"))
    position = F.when(F.col(segment) == 0, F.lit(1 << 30)).otherwise(F.col(pos) - F.col("__first")).cast("long")
    return df.join(first, row).withColumn("position", position).drop("__first")


def from_cu_seqlens(df: DataFrame, row: str, cu: str) -> DataFrame:
    """(row, pos, segment, kstart) of every token of cumulative lengths [0, n1, n1 + n2, ...]."""
    parts = F.posexplode(F.slice(cu, 2, F.size(cu) - 1)).alias("segment", "until")
    starts = df.select(row, cu, parts).withColumn("kstart", F.get(cu, F.col("segment"))).where("until > kstart")
    return starts.select(row, F.explode(F.sequence("kstart", F.col("until") - 1)).alias("pos"), "segment", "kstart")


def text_positions(df: DataFrame, row: str, pos: str, mask: str) -> DataFrame:
    """Adds text_pos: tokens seen so far less one, 0 where masked."""
    seen = scan(df, [row, pos], [row], {"__seen": ("sum", mask)})
    return seen.withColumn("text_pos", F.when(F.col(mask) == 1, F.col("__seen") - 1).otherwise(0).cast("long")).drop("__seen")


def next_tokens(df: DataFrame, row: str, pos: str, *columns: str) -> DataFrame:
    """Adds next_<column>; null at a row's end."""
    return scan(df, [row, pos], [row], {f"next_{c}": ("lead", c) for c in columns})


def causal_conv(df: DataFrame, row: str, pos: str, x: str, taps: list[float]) -> DataFrame:
    """Adds conv: a causal convolution with zeros before the row; the last tap weighs the token itself."""
    k = len(taps)
    earlier = {f"__lag{k - 1 - i}": ("lag", x, k - 1 - i) for i in range(k - 1)}
    found = scan(df, [row, pos], [row], earlier) if earlier else df
    terms = [F.lit(w) * F.coalesce(F.col(c), F.lit(0.0)) for w, c in zip(taps, [*earlier, x])]
    return found.withColumn("conv", sum(terms[1:], terms[0])).drop(*earlier)


def chunk_decay(df: DataFrame, row: str, pos: str, g: str, chunk: int = 64) -> DataFrame:
    """Adds decay: running sum of ``g`` inside chunks of positions, which are windows of at most ``chunk`` tokens."""
    w = Window.partitionBy(row, F.floor(F.col(pos) / chunk)).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("decay", F.sum(g).over(w))


def left_pads(tokens: Column) -> Column:
    """Tokens before the first one that is not 0."""
    first = F.array_position(F.transform(tokens, lambda t: t != 0), True)
    return F.when(first > 0, first - 1).otherwise(F.size(tokens)).cast("long")


def right_pads(tokens: Column, pad: int) -> Column:
    """Trailing pads of one row; a batch uses the largest of its rows."""
    first = F.array_position(F.reverse(F.transform(tokens, lambda t: t != pad)), True)
    return F.when(first > 0, first - 1).otherwise(F.size(tokens)).cast("long")


def pads(df: DataFrame, keys: list[str], pos: str, starts: Column, ends: Column) -> DataFrame:
    """(keys..., left_pads, right_pads) of token rows: those before the first that ``starts`` the text, and after the last that
    ``ends`` it; all of them if there is none. Counted from positions, so that no row is gathered."""
    n = F.max(pos) + 1
    return df.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(starts, F.col(pos))), n).cast("long").alias("left_pads"),
        (n - 1 - F.coalesce(F.max(F.when(ends, F.col(pos))), F.lit(-1))).cast("long").alias("right_pads"))


def batch_right_pads(df: DataFrame, batch: str, tokens: str, pad: int) -> DataFrame:
    """The largest number of trailing pads in each batch."""
    return df.groupBy(batch).agg(F.max(right_pads(F.col(tokens), pad)).alias("right_pads"))
