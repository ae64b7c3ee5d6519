"""Supervision masks and padded examples, as array columns and as token rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatpack.operators.scans import scan
from chatpack.operators.storage import stored


def positions_of(ids: Column, token: int) -> Column:
    """0-based positions of a token."""
    return F.filter(F.transform(ids, lambda x, i: F.when(x == token, i)), lambda i: i.isNotNull())


def with_loss_mask(df: DataFrame, ids: str, start: int, end: int, assistant: int, name: str = "loss_mask") -> DataFrame:
    """Adds 1 for tokens of assistant turns, from the third after a start marker to the end marker.

    The k-th start belongs to the k-th end, as far as both exist. A span adds 1 where it opens and
    takes 1 after its end, so crossing spans of malformed input may give other values. The
    spans are columns of their own, so that they are found once for a row. For rows of many turns see ``loss_mask_rows``.
    """
    token = F.col(ids)
    spans = F.transform(
        F.slice("__starts", 1, F.least(F.size("__starts"), F.size("__ends"))),
        lambda s, k: F.struct((s + 3).alias("open"), (F.get("__ends", k) + 1).alias("close"), (F.get(token, s + 1) == assistant).alias("own")))
    count = lambda i, f: F.size(F.filter("__spans", lambda x: x[f] <= i))
    return (
        df.withColumns({"__starts": positions_of(token, start), "__ends": positions_of(token, end)})
        .withColumn("__spans", F.filter(spans, lambda x: F.coalesce(x["own"], F.lit(False))))
        .withColumn(name, F.transform(token, lambda _, i: count(i, "open") - count(i, "close")))
        .drop("__starts", "__ends", "__spans")
    )


def loss_mask_rows(tokens: DataFrame, row: str, pos: str, token: str, start: int, end: int, assistant: int, name: str = "loss_mask") -> DataFrame:
    """``tokens`` (row, pos, token, ...) with the mask of ``with_loss_mask``, for rows of any number of tokens.

    Start and end markers get their numbers by running counts and meet by number; spans become steps up and
    down, and the mask is their running sum. A token costs the same however many turns there are.
    """
    marks = tokens.select(row, pos, token).withColumns({"__s": (F.col(token) == start).cast("int"), "__e": (F.col(token) == end).cast("int")})
    numbered = scan(marks, [row, pos], [row], {"__starts": ("sum", "__s"), "__ends": ("sum", "__e"), "__next": ("lead", token)})
    numbered = stored(numbered.where("__s + __e > 0"))
    starts = numbered.where("__s = 1").select(row, F.col("__starts").alias("__nth"), (F.col(pos) + 3).alias("__open"), (F.col("__next") == assistant).alias("__own"))
    ends = numbered.where("__e = 1").select(row, F.col("__ends").alias("__nth"), (F.col(pos) + 1).alias("__close"))
    spans = starts.where("__own").join(ends, [row, "__nth"])
    steps = spans.select(row, F.inline(F.array(F.struct(F.col("__open").alias(pos), F.lit(1).alias("__step")), F.struct(F.col("__close").alias(pos), F.lit(-1).alias("__step")))))
    steps = steps.groupBy(row, pos).agg(F.sum("__step").alias("__step"))
    stepped = tokens.join(steps, [row, pos], "left").select(*tokens.columns, F.coalesce("__step", F.lit(0)).alias("__step"))
    return scan(stepped, [row, pos], [row], {name: ("sum", "__step")}).drop("__step")


def padded(values: Column, length: int, fill: int) -> Column:
    """Right-padded to a length; longer arrays are an error."""
    n = F.size(values)
    return F.when(n <= length, F.concat(values, F.array_repeat(F.lit(fill), F.greatest(F.lit(length) - n, F.lit(0))))).otherwise(
        F.raise_error(F.concat(F.lit("example exceeds max_length: "), n)).cast("array<int>"))


def attention_mask(ids: Column, length: int) -> Column:
    return F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size(ids), F.lit(0))))


def supervised_tokens(mask: Column) -> Column:
    """Sum of the mask without its first position, which predicts nothing."""
    return F.aggregate(F.slice(mask, 2, F.greatest(F.size(mask) - 1, F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)
