"""Vector arithmetic on arrays, expert routing and masked losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))


def _with(value: Column, use) -> Column:
    """``use(value)``, in which the value is computed once and not at each of its uses inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rms_norm(x: Column, weight: Column | None = None, eps: float = 1e-6, plus_one: bool = False) -> Column:
    """x / sqrt(mean of squares + eps), times the weight or one plus the weight."""
    scale = 1 / F.sqrt(_sum(F.transform(x, lambda v: v.cast("double") * v)) / F.size(x) + eps)
    if weight is None:
        return _with(scale, lambda s: F.transform(x, lambda v: v * s))
    return _with(scale, lambda s: F.zip_with(x, weight, lambda v, w: v * s * (1 + w if plus_one else w)))


def layer_norm(x: Column, eps: float = 1e-6) -> Column:
    centred = _with(_sum(x) / F.size(x), lambda mean: F.transform(x, lambda v: v - mean))
    scaled = lambda c: _with(F.sqrt(_sum(F.transform(c, lambda v: v * v)) / F.size(x) + eps), lambda s: F.transform(c, lambda v: v / s))
    return _with(centred, scaled)


def l2_norm(x: Column, eps: float = 1e-6) -> Column:
    scale = 1 / F.sqrt(_sum(F.transform(x, lambda v: v.cast("double") * v)) + eps)
    return _with(scale, lambda s: F.transform(x, lambda v: v * s))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def silu(x: Column) -> Column:
    return x * sigmoid(x)


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def gelu_tanh(x: Column) -> Column:
    return 0.5 * x * (1 + F.tanh(0.7978845608028654 * (x + 0.044715 * x * x * x)))


def softmax(x: Column) -> Column:
    e = _with(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v.cast("double") - top)))
    return _with(e, lambda e: _with(_sum(e), lambda total: F.transform(e, lambda v: v / total)))


def global_norm(df: DataFrame, values: str) -> DataFrame:
    """(norm): the root of the sum of squares over all arrays of a table, as of all gradients together."""
    squares = F.aggregate(values, F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    return df.agg(F.sqrt(F.coalesce(F.sum(squares), F.lit(0.0))).alias("norm"))


def rope_angles(position: Column, size: int, theta: float = 10_000.0) -> Column:
    """position / theta^(2i / size) for each i below size / 2."""
    return F.transform(F.sequence(F.lit(0), F.lit(size // 2 - 1)), lambda i: position / F.pow(F.lit(theta), 2 * i / size))


def mrope_axis(i: Column, h: int | None = None, w: int | None = None) -> Column:
    """The axis of frequency i in the interleaved layout: indices 1, 4, 7 take h, 2, 5, 8 take w, others t.

    ``h`` and ``w`` are how many frequencies these axes have; without them they go on to the end.
    """
    of = lambda k, n: (F.pmod(i, F.lit(3)) == k) & (F.lit(True) if n is None else i < 3 * n)
    return F.when(of(1, h), "h").when(of(2, w), "w").otherwise("t")


def mrope_angles(t: Column, h: Column, w: Column, size: int, sections: tuple[int, int, int], theta: float = 10_000.0) -> Column:
    """Angles of the size / 2 frequencies, each from the position of its axis."""
    at = lambda i: mrope_axis(i, sections[1], sections[2])
    position = lambda i: F.when(at(i) == "h", h).when(at(i) == "w", w).otherwise(t)
    return F.transform(F.sequence(F.lit(0), F.lit(size // 2 - 1)), lambda i: position(i) / F.pow(F.lit(theta), 2 * i / size))


def rotated(x: Column, angles: Column) -> Column:
    """The first 2 * size(angles) parts turned by the angles, part i with part i + size(angles); parts beyond stay as they are."""
    half = F.size(angles)

    def part(turns):
        turn = lambda i: F.get(turns, F.pmod(i, half))
        of = lambda i, name: turn(i)[name]
        return F.transform(x, lambda v, i: F.when(i < half, v.cast("double") * of(i, "cos") - F.get(x, i + half) * of(i, "sin"))
                           .when(i < 2 * half, v.cast("double") * of(i, "cos") + F.get(x, i - half) * of(i, "sin")).otherwise(v.cast("double")))

    return _with(F.transform(angles, lambda a: F.struct(F.cos(a).alias("cos"), F.sin(a).alias("sin"))), part)


def router(tokens: DataFrame, token: str, logits: str, k: int, renormalise: bool = True) -> DataFrame:
    """(token, expert, prob, rank, weight): the k likeliest experts of each token, ties to the lowest."""
    each = F.transform(softmax(F.col(logits)), lambda p, i: F.struct((-p).alias("minus"), i.alias("expert")))
    top = tokens.select(token, F.slice(F.array_sort(each), 1, k).alias("__top"))
    total = F.greatest(F.aggregate("__top", F.lit(0.0), lambda a, x: a - x["minus"]), F.lit(1e-9))
    prob = -F.col("__at.minus")
    return top.select(token, total.alias("__total"), F.posexplode("__top").alias("__rank", "__at")).select(
        token, F.col("__at.expert").alias("expert"), prob.alias("prob"), (F.col("__rank") + 1).alias("rank"), (prob / F.col("__total") if renormalise else prob).alias("weight"))


def balance_loss(tokens: DataFrame, token: str, logits: str, k: int, experts: int, coef: float = 1.0, kind: str = "switch") -> DataFrame:
    """Router auxiliary loss: ``switch`` (experts * shares * mean probabilities) or ``variance`` (squared distance from 1 / experts)."""
    probs = tokens.select(token, F.col(logits).alias("__x")).select(token, F.posexplode(softmax(F.col("__x"))).alias("expert", "prob"))
    mean = probs.groupBy("expert").agg(F.avg("prob").alias("p"), F.count("*").alias("n"))
    if kind == "variance":
        return mean.agg((coef * F.sum((F.col("p") - 1 / experts) * (F.col("p") - 1 / experts))).alias("aux_loss"))
    share = router(tokens, token, logits, k).groupBy("expert").agg(F.count("*").alias("c"))
    return share.join(mean, "expert").agg((coef * experts * F.sum(F.col("c") / F.col("n") * F.col("p"))).alias("aux_loss"))


def cross_entropy(df: DataFrame, logits: str, target: str, mask: str) -> DataFrame:
    """(loss, tokens): sum of the masked negative log-likelihoods over the mask's sum, 1 at least."""
    top = F.array_max(logits)
    total = F.log(_sum(F.transform(logits, lambda v: F.exp(v.cast("double") - top)))) + top
    nll = total - F.get(logits, F.col(target).cast("int"))
    m = F.col(mask)
    return df.select(nll.alias("nll"), m.alias("m")).agg(
        (F.sum(F.col("nll") * F.col("m")) / F.greatest(F.sum("m"), F.lit(1))).alias("loss"), F.sum("m").cast("long").alias("tokens"))


def gather(tokens: DataFrame, vocabulary: DataFrame, token: str = "token_id") -> DataFrame:
    """Token rows with the row of their id; Spark broadcasts the vocabulary if it is small enough."""
    return tokens.join(vocabulary, token)


def scatter(tokens: DataFrame, features: DataFrame, row: str, pos: str, image_token: int, token: str = "token_id") -> DataFrame:
    """Embeddings of image tokens replaced by features (row, ordinal, feature) in order; what is left over is dropped."""
    images = tokens.where(F.col(token) == image_token).withColumn("ordinal", (F.row_number().over(Window.partitionBy(row).orderBy(pos)) - 1).cast("long"))
    found = images.join(features, [row, "ordinal"], "left").select(row, pos, "feature")
    return tokens.join(found, [row, pos], "left").withColumn("embedding", F.coalesce("feature", "embedding")).drop("feature")
