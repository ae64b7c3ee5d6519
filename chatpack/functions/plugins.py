"""Plug-in measures and tokenizers, and the images that messages refer to."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_tokenizer(make: Callable[[], Callable[[str], Sequence[int]]]) -> Callable[[Column], Column]:
    """A column function from text to token ids. ``make`` runs once for each Arrow batch stream, on the executor."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = make()
        for texts in batches:
            yield texts.map(lambda t: list(own(t or "")))

    return encode


def token_measure(make: Callable[[], Callable[[str], Sequence[int]]], text_of: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A measure that counts a plug-in tokenizer's tokens of a message's text."""
    encode = text_tokenizer(make)
    return lambda message: F.size(encode(text_of(message))).cast("long")


def image_refs(messages: DataFrame, key: list[str], blocks: str = "blocks") -> DataFrame:
    """(key..., ordinal, url) of the image blocks of each message, in order, and image (its bytes) if blocks have such a field.

    A block names its image by ``url``, ``path`` or ``file``, whichever it has first, or holds its bytes; others are left out.
    The urls are paths for ``spark.read.format("binaryFile")``; decoding is left to the caller.
    """
    fields = messages.schema[blocks].dataType.elementType.fieldNames()
    named = [k for k in ("url", "path", "file") if k in fields]
    held = [k for k in ("image",) if k in fields]
    images = F.filter(blocks, lambda b: (b["type"] == "image") & F.coalesce(*[F.when(b[k].isNotNull(), True) for k in named + held], F.lit(False)))
    url = F.coalesce(*[F.col(f"b.{k}") for k in named], F.lit(None).cast("string")).alias("url")
    return messages.select(*key, F.posexplode(images).alias("ordinal", "b")).select(*key, "ordinal", url, *[F.col(f"b.{k}") for k in held])


def guarded(blocks: Column, has_processor: bool) -> Column:
    """``blocks``, or an error if they hold an image and there is nothing to process it."""
    bad = F.coalesce(F.exists(blocks, lambda b: b["type"] == "image"), F.lit(False))
    return blocks if has_processor else F.when(bad, F.raise_error(F.lit("images need a processor"))).otherwise(blocks)
