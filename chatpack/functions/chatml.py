"""ChatML text and message measures as columns.

A message is a struct of role and content, where content is a string or, in the block form,
an array of structs (type, text, url). Blocks of types other than text and image add nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the format.
START, END, VISION_START, VISION_END, IMAGE_PAD = "<|im_start|>", "<|im_end|>", "<|vision_start|>", "<|vision_end|>", "<|image_pad|>"


def render(role: Column, body: Column) -> Column:
    """One message; null role or body counts as empty."""
    return F.concat(F.lit(START), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")), F.lit(END + "\n"))


def merged_tokens(grid: Column, merge: int) -> Column:
    """Vision tokens of a grid struct (t, h, w)."""
    return F.floor(grid["h"] / merge) * F.floor(grid["w"] / merge) * grid["t"]


def image_text(tokens: Column) -> Column:
    return F.concat(F.lit(VISION_START), F.repeat(F.lit(IMAGE_PAD), tokens.cast("int")), F.lit(VISION_END))


def render_blocks(role: Column, blocks: Column, grids: Column | None = None, merge: int = 2) -> Column:
    """A message of blocks. The i-th image block takes the i-th grid of ``grids``; a missing grid is an error."""
    ordinal = lambda i: F.size(F.filter(F.slice(blocks, 1, i + 1), lambda b: b["type"] == "image"))

    def one(b, i):
        image = F.lit("")
        if grids is not None:
            grid = F.get(grids, ordinal(i) - 1)
            image = F.when(grid.isNull(), F.raise_error(F.lit("image block without a grid")).cast("string")).otherwise(image_text(merged_tokens(grid, merge)))
        return F.when(b["type"] == "text", F.coalesce(b["text"], F.lit(""))).when(b["type"] == "image", image).otherwise("")

    return render(role, F.array_join(F.transform(blocks, one), ""))


def has_images(blocks: Column) -> Column:
    return F.coalesce(F.exists(blocks, lambda b: b["type"] == "image"), F.lit(False))


def char_length(role: Column, body: Column) -> Column:
    """The default measure: characters of the rendered message."""
    return F.length(render(role, body)).cast("long")


def vision_measure(length: Column, grids: Column, merge: int = 2) -> Column:
    """Struct (length, vision_tokens, vision_patches, num_images) from a message's length and grids."""
    total = lambda f: F.aggregate(F.coalesce(grids, F.array().cast("array<struct<t:int,h:int,w:int>>")), F.lit(0).cast("long"), lambda a, g: a + f(g))
    return F.struct(
        length.cast("long").alias("length"),
        total(lambda g: merged_tokens(g, merge)).alias("vision_tokens"),
        total(lambda g: (g["t"] * g["h"] * g["w"]).cast("long")).alias("vision_patches"),
        F.coalesce(F.size(grids), F.lit(0)).cast("long").alias("num_images"),
    )
