"""Token statistics: distributions, frequency tables and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatpack.operators.scans import scan
from chatpack.operators.storage import stored

RANKS = (0.5, 0.95, 0.99)
#: Distinct values of a metric that one task weighs.
VALUES_AT_ONCE = 100_000


def two_places(c):
    """Half up at two decimals, by integer arithmetic on doubles."""
    return F.floor(c * 100 + 0.5) / 100


def distributions(df: DataFrame, metrics: list[str], by: tuple[str, ...] = (), values_at_once: int = VALUES_AT_ONCE) -> DataFrame:
    """(by..., metric, sum, min, max, mean, median, std, p95, p99) of integer columns, all zero without rows.

    Rows are first summed to frequencies of values, which are stored. Percentiles are exact: where no metric has more than
    ``values_at_once`` distinct values, an aggregate weighs them; else running sums of frequencies over ranges of values give
    each value its ranks, and the values at the wanted ranks are picked.
    """
    keys = [*by, "metric"]
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("value")) for m in metrics])).alias("m")).select(*by, "m.*")
    found = stored(long.where("value is not null").groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n")))
    totals = found.groupBy(*keys).agg(
        F.sum("n").alias("__n"), F.sum(F.col("value") * F.col("n")).alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"), F.count(F.lit(1)).alias("__values")
    ).withColumn("__mean", F.col("sum") / F.col("__n"))
    groups = long.select(*keys).distinct() if by else df.sparkSession.createDataFrame([(m,) for m in metrics], "metric string")
    totals = stored(_joined(groups, totals, keys))
    most = totals.agg(F.max("__values")).first()[0] or 0
    spread = F.sum(F.col("n") * F.pow(F.col("value") - F.col("__mean"), 2)).alias("__squares")
    if most <= values_at_once:
        some = found.groupBy(*keys).agg(F.percentile("value", F.array(*map(F.lit, RANKS)), F.col("n")).alias("__q"))
        squares = _joined(found, totals.select(*keys, "__mean"), keys).groupBy(*keys).agg(spread)
        some = _joined(some, squares, keys)
    else:
        until = scan(found, [*keys, "value"], keys, {"__until": ("sum", "n")})
        each = _joined(until, totals.select(*keys, "__n", "__mean"), keys)
        at = lambda rank: F.max(F.when((F.col("__until") - F.col("n") <= rank) & (rank < F.col("__until")), F.col("value")))
        place = [(F.col("__n") - 1) * F.lit(q) for q in RANKS]
        low, high = [at(F.floor(x)) for x in place], [at(F.ceil(x)) for x in place]
        picked = [c.alias(f"__{side}{i}") for side, cells in (("low", low), ("high", high)) for i, c in enumerate(cells)]
        some = _joined(each.groupBy(*keys).agg(spread, *picked), totals.select(*keys, "__n"), keys)
        between = [F.when(F.floor(x) == F.ceil(x), F.col(f"__low{i}").cast("double")).otherwise((F.ceil(x) - x) * F.col(f"__low{i}") + (x - F.floor(x)) * F.col(f"__high{i}")) for i, x in enumerate(place)]
        some = some.select(*keys, "__squares", F.array(*between).alias("__q"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    q = [zero(two_places(F.get("__q", F.lit(i)))).alias(n) for i, n in enumerate(("median", "p95", "p99"))]
    std = zero(two_places(F.sqrt(F.col("__squares") / F.col("__n")))).alias("std")
    return _joined(totals, some, keys).select(
        *keys, zero(F.col("sum")).cast("long").alias("sum"), zero(F.col("min")).alias("min"), zero(F.col("max")).alias("max"), zero(two_places(F.col("__mean"))).alias("mean"), q[0], std, *q[1:])


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join in which null keys are equal."""
    right = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [left[k].eqNullSafe(right[f"__{k}"]) for k in keys]
    return left.join(right, same, "left").drop(*[f"__{k}" for k in keys])


def frequencies(df: DataFrame, value: str) -> DataFrame:
    """(value, n) of every value."""
    return df.groupBy(F.col(value).cast("long").alias("value")).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """(keys..., n, first_seen), to be ordered by n descending and then by first_seen."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(ordinal).alias("first_seen"))


def image_shapes(images: DataFrame) -> dict[str, int]:
    """How many of ``images`` (height, width, ordinal) have each shape, as "HxW"; most frequent first, then first seen."""
    found = histogram(images, ["height", "width"], "ordinal").orderBy(F.desc("n"), "first_seen")
    return {f"{r['height']}x{r['width']}": r["n"] for r in found.collect()}


def summary(messages: DataFrame, chunks: DataFrame, images: DataFrame | None = None) -> dict:
    """The statistics document: distributions of messages and of chunks, shapes of ``images``, and frequency tables of the chunks."""
    per = {"per_message": (messages, ["length", "text_tokens", "vision_tokens", "num_images"]),
           "per_chunk": (chunks, ["measured_length", "text_tokens", "vision_tokens", "vision_patches", "num_images", "num_messages"])}
    doc: dict = {k: {r["metric"]: {c: r[c] for c in r.asDict() if c != "metric"} for r in distributions(df, m).collect()} for k, (df, m) in per.items()}
    doc["per_message"]["num_messages"], doc["per_chunk"]["num_chunks"] = messages.count(), chunks.count()
    doc["image_shapes"] = {} if images is None else image_shapes(images)
    doc["vision_variability"] = {
        f"{m}_per_chunk": {str(r["value"]): r["n"] for r in frequencies(chunks, m).orderBy("value").collect()} for m in ("num_images", "vision_tokens", "vision_patches")
    }
    return doc
