"""Bookkeeping of image grids (t, h, w) and of positions on three axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cu_seqlens(grids: Column) -> Column:
    """[0, then running sums of h * w for each frame] of an array of grids."""
    frames = F.flatten(F.transform(grids, lambda g: F.array_repeat((g["h"] * g["w"]).cast("long"), g["t"].cast("int"))))
    zero = F.array(F.lit(0).cast("long"))
    return F.aggregate(frames, zero, lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def cu_seqlens_rows(grids: DataFrame, row: str, ordinal: str) -> DataFrame:
    """(row, frame, until) as a table, for long lists: a running sum over frames; frame 0 is the leading zero."""
    frames = grids.select(row, ordinal, F.explode(F.sequence(F.lit(1), "t")).alias("f"), (F.col("h") * F.col("w")).cast("long").alias("n"))
    w = Window.partitionBy(row).orderBy(ordinal, "f")
    ends = frames.select(row, F.row_number().over(w).cast("long").alias("frame"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("until"))
    return ends.union(grids.select(row).distinct().select(row, F.lit(0).cast("long"), F.lit(0).cast("long")))


def pad_plan(patches: Column, images: Column, max_patches: int, max_images: int, merge: int) -> Column:
    """Status and grids that fill a vision budget: one that absorbs what is left, then the smallest ones.

    status is ok, or says why the budget cannot be filled.
    """
    extra, dummies = max_patches - patches, max_images - images
    absorbed = extra - (dummies - 1) * merge * merge
    status = (
        F.when((extra < 0) | (dummies < 0), "over budget")
        .when((dummies == 0) & (extra > 0), "patches left without an image to hold them")
        .when((dummies > 0) & ((absorbed < merge * merge) | (F.pmod(absorbed, F.lit(merge * merge)) != 0)), "patches cannot be divided")
        .otherwise("ok")
    )
    grid = lambda h, w: F.struct(F.lit(1).alias("t"), F.lit(h).alias("h"), w.cast("int").alias("w"))
    plan = F.concat(F.array(grid(merge, absorbed / merge)), F.array_repeat(grid(merge, F.lit(merge)), F.greatest(dummies - 1, F.lit(0)).cast("int")))
    return F.struct(status.alias("status"), F.when((status == "ok") & (dummies > 0), plan).otherwise(F.array().cast("array<struct<t:int,h:int,w:int>>")).alias("grids"))


def budget_divides(per_sample: int, batch: int, merge: int) -> bool:
    return per_sample * batch % (merge * merge) == 0


def spatial_coords(grids: DataFrame, row: str, ordinal: str, merge: int) -> DataFrame:
    """(row, ordinal, token, y, x) of every patch, in merge-block order inside each frame."""
    m = merge
    tokens = grids.select(row, ordinal, "h", "w", F.explode(F.sequence(F.lit(0), (F.col("t") * F.col("h") * F.col("w") - 1).cast("int"))).alias("token"))
    inside = F.pmod("token", F.col("h") * F.col("w"))
    block, part = F.floor(inside / (m * m)), F.pmod(inside, F.lit(m * m))
    wide = F.floor(F.col("w") / m)
    y = F.floor(block / wide) * m + F.floor(part / m)
    x = F.pmod(block, wide) * m + F.pmod(part, F.lit(m))
    return tokens.select(row, ordinal, F.col("token").cast("long").alias("token"), y.cast("long").alias("y"), x.cast("long").alias("x"))


def rope_positions(runs: DataFrame, row: str, ordinal: str, merge: int) -> DataFrame:
    """(row, token, pt, ph, pw) from runs (row, ordinal, n for text, or t, h, w for an image).

    A text token advances all axes by one; an image takes (t, h / merge, w / merge) and advances by
    the largest. A run's start is the sum of the advances before it, so the positions are closed forms.
    """
    gh, gw = F.floor(F.col("h") / merge), F.floor(F.col("w") / merge)
    image = F.col("t").isNotNull()
    size = F.when(image, F.col("t") * gh * gw).otherwise(F.col("n")).cast("long")
    step = F.when(image, F.greatest(F.col("t").cast("long"), gh, gw)).otherwise(F.col("n")).cast("long")
    before = Window.partitionBy(row).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    r = runs.withColumns({"gh": gh, "gw": gw, "size": size, "step": step}).where("size > 0")
    r = r.withColumns({"start": F.coalesce(F.sum("step").over(before), F.lit(0)), "offset": F.coalesce(F.sum("size").over(before), F.lit(0))})
    k = r.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)))
    axis = lambda e: F.col("start") + F.when(image, e).otherwise(F.col("k"))
    return k.select(
        row, (F.col("offset") + F.col("k")).alias("token"), axis(F.floor(F.col("k") / (F.col("gh") * F.col("gw")))).cast("long").alias("pt"),
        axis(F.pmod(F.floor(F.col("k") / F.col("gw")), F.col("gh"))).cast("long").alias("ph"), axis(F.pmod("k", F.col("gw"))).cast("long").alias("pw"))


def split_frames(grids: DataFrame, row: str, ordinal: str) -> DataFrame:
    """Grids of videos as one grid for each frame: (row, ordinal, t = 1, h, w) with new ordinals."""
    frames = grids.select(row, F.col(ordinal).alias("__o"), F.explode(F.sequence(F.lit(1), "t")).alias("__f"), "h", "w")
    nth = F.row_number().over(Window.partitionBy(row).orderBy("__o", "__f")) - 1
    return frames.select(row, nth.alias(ordinal), F.lit(1).alias("t"), "h", "w")


def token_runs(tokens: DataFrame, grids: DataFrame, row: str, pos: str, token: str, image_token: int) -> DataFrame:
    """(row, ordinal, n, t, h, w) runs of a token stream: each stretch of image tokens takes the next grid (row, ordinal).

    Stretches are told apart by the text between them; one without a grid is an error.
    """
    w = Window.partitionBy(row).orderBy(pos)
    image = F.col(token) == image_token
    changed = (F.lag("__image").over(w).isNull() | (F.lag("__image").over(w) != F.col("__image"))).cast("int")
    numbered = tokens.withColumn("__image", image).withColumn("__c", changed).withColumn("__run", F.sum("__c").over(w))
    runs = numbered.groupBy(row, "__run", "__image").agg(F.count("*").cast("int").alias("n"))
    nth = F.when(F.col("__image"), F.sum(F.col("__image").cast("int")).over(Window.partitionBy(row).orderBy("__run")) - 1)
    own = grids.withColumnRenamed("ordinal", "__nth")
    joined = runs.withColumn("__nth", nth).join(own, [row, "__nth"], "left")
    missing = F.col("__image") & F.col("t").isNull()
    t = F.when(missing, F.raise_error(F.lit("image tokens without a grid")).cast("int")).otherwise(F.col("t"))
    return joined.select(row, F.col("__run").alias("ordinal"), F.when(~F.col("__image"), F.col("n")).alias("n"), t.alias("t"), "h", "w")


def rope_delta(positions: DataFrame, row: str) -> DataFrame:
    """(row, delta): the largest position plus 1, less the number of tokens."""
    return positions.groupBy(row).agg((F.max(F.greatest("pt", "ph", "pw")) + 1 - F.count("*")).cast("long").alias("delta"))


def bilinear(length: Column, index: Column, table: int) -> Column:
    """Struct (low, high, weight): the neighbours of a point of an even grid over a table of positions."""
    at = F.when(length > 1, index * (table - 1) / (length - 1)).otherwise(0.0)
    low = F.floor(at)
    return F.struct(low.alias("low"), F.least(low + 1, F.lit(table - 1)).alias("high"), (at - low).alias("weight"))
