"""Training arithmetic as tables and columns: FLOPs, step metrics and learning rates.

FLOPs are those of a table of matrix products: each layer of a config unfolds to rows
(inputs, outputs) with a multiplicity, a product costs 2 * inputs * outputs for each token, and
training costs three times the forward pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRAINING = 3
# Peak bf16 TFLOPS by device.
PEAK_TFLOPS = {
    "h100_sxm": 989.0,
    "h100_pcie": 756.0,
    "a100_sxm_80gb": 312.0,
    "a100_sxm_40gb": 312.0,
    "a100_pcie_80gb": 312.0,
    "a100_pcie_40gb": 312.0,
}


def peak_tflops(spec: Column) -> Column:
    """A device name or a number as text; null stays null, anything else is an error."""
    known = F.create_map(*[F.lit(x) for kv in PEAK_TFLOPS.items() for x in kv])
    value = F.coalesce(F.try_element_at(known, spec), spec.try_cast("double"))
    return F.when(spec.isNull(), F.lit(None).cast("double")).when(value.isNotNull(), value).otherwise(
        F.raise_error(F.concat(F.lit("unknown peak_tflops: "), spec)).cast("double"))


def is_moe_layer(layer: Column, experts: Column, sparse_step: Column, mlp_only: Column) -> Column:
    return (experts > 0) & ~F.coalesce(F.array_contains(mlp_only, layer), F.lit(False)) & (F.pmod(layer + 1, F.greatest(sparse_step, F.lit(1))) == 0)


def is_full_attention(layer: Column, every: int = 4) -> Column:
    """Layer kinds of hybrid decoders: every fourth is full attention."""
    return F.pmod(layer + 1, F.lit(every)) == 0


def _product(*sizes) -> Column:
    out = F.lit(1).cast("decimal(38,0)")
    for s in sizes:
        out = (out * (F.col(s) if isinstance(s, str) else s if isinstance(s, Column) else F.lit(s)).cast("long")).cast("decimal(38,0)")
    return out


def _total(layers: DataFrame, names: list[str], products: Column, head: Column) -> DataFrame:
    per_layer = F.aggregate(products, F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x).cast("decimal(38,0)"))
    return layers.withColumn("__flops", 2 * per_layer).groupBy(*names).agg(
        (TRAINING * (F.sum("__flops") + F.first(2 * head))).cast("long").alias("flops_per_token"))


def _layered(configs: DataFrame) -> DataFrame:
    return configs.withColumn("layer", F.explode(F.sequence(F.lit(0), F.col("layers").cast("int") - 1)))


def decoder_flops(configs: DataFrame, name: str = "name") -> DataFrame:
    """(name, flops_per_token) of decoders with dense or expert layers.

    ``configs`` has name, d (width), heads, kv_heads, head_dim, mlp, vocab, layers, seq_len, experts,
    top_k, moe_mlp, sparse_step and mlp_only (layers that stay dense).
    """
    moe = is_moe_layer(F.col("layer"), F.col("experts"), F.col("sparse_step"), F.col("mlp_only"))
    feed = F.when(moe, _product("d", "experts") + _product(3, "top_k", "d", "moe_mlp")).otherwise(_product(3, "d", "mlp"))
    products = F.array(
        _product("d", F.col("heads") + 2 * F.col("kv_heads"), "head_dim"),
        _product("seq_len", "heads", "head_dim"),  # causal: half of all pairs
        _product("heads", "head_dim", "d"), feed.cast("decimal(38,0)"),
    )
    return _total(_layered(configs), [name], products, _product("d", "vocab"))


def hybrid_flops(configs: DataFrame, name: str = "name") -> DataFrame:
    """(name, flops_per_token) of decoders that mix full attention with linear attention layers.

    Besides the columns of ``decoder_flops`` it needs key_heads, key_dim, value_heads, value_dim
    (of the linear layers), shared_mlp and attention_every.
    """
    full = F.pmod(F.col("layer") + 1, F.col("attention_every")) == 0
    key, value = F.col("key_heads") * F.col("key_dim"), F.col("value_heads") * F.col("value_dim")
    attention = (_product("d", 2, "heads", "head_dim") + _product("d", 2, "kv_heads", "head_dim") + _product("seq_len", "heads", "head_dim") + _product("heads", "head_dim", "d"))
    linear = (_product("d", 2 * key + value) + _product("d", value) + _product("d", 2, "value_heads") + _product(value, "d") + _product("value_heads", "key_dim", "value_dim"))
    experts = _product("d", "experts") + _product("top_k", 3, "moe_mlp", "d") + _product(3, "d", "shared_mlp") + _product("d", 1)
    products = F.array(F.when(full, attention).otherwise(linear).cast("decimal(38,0)"), F.when(F.col("experts") > 0, experts).otherwise(_product(3, "d", "mlp")).cast("decimal(38,0)"))
    return _total(_layered(configs), [name], products, _product("d", "vocab"))


def vision_flops(grids: DataFrame, config: dict[str, int], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., vision_flops) of the image grids (t, h, w); attention stays inside an image.

    ``config`` has d, mlp, depth, inputs (numbers of a patch), merge, out and mergers.
    """
    d, merge = config["d"], config["merge"]
    n = (F.col("t") * F.col("h") * F.col("w")).cast("long")
    sums = grids.groupBy(*by).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n"), F.coalesce(F.sum(n * n), F.lit(0)).alias("nn"),
        F.coalesce(F.sum((F.col("t") * F.floor(F.col("h") / merge) * F.floor(F.col("w") / merge)).cast("long")), F.lit(0)).alias("m"))
    side = d * merge * merge
    patches = _product("n", config["inputs"], d)
    block = _product("n", d, 4 * d) + _product("nn", 2 * d) + _product("n", 2, d, config["mlp"])
    mergers = _product("m", side, side + config["out"], config["mergers"])
    total = TRAINING * 2 * (patches + block * config["depth"] + mergers)
    return sums.select(*by, F.when((F.col("n") > 0) & (F.col("m") > 0), total).otherwise(0).cast("long").alias("vision_flops"))


def flops_per_device(per_token: Column, seq_len: Column, batch: Column, devices: Column, vision: Column | None = None) -> Column:
    total = per_token.cast("decimal(38,0)") * seq_len * batch + (vision if vision is not None else F.lit(0))
    return total.cast("double") / F.greatest(devices, F.lit(1))


def step_metrics(flops: Column, seconds: Column, tokens: Column, peak: Column, devices: Column = None) -> dict[str, Column]:
    """Tokens a second (in all and by device), TFLOPS by device and the share of the peak; all 0 for no time."""
    devices = F.lit(1) if devices is None else devices
    ok = seconds > 0
    per = lambda x: F.when(ok, x / F.when(ok, seconds)).otherwise(0.0)
    tflops = per(flops / 1e12)
    return {
        "step_time": F.when(ok, seconds).otherwise(0.0), "tokens_per_s": per(tokens), "tokens_per_s_per_device": per(tokens / F.greatest(devices, F.lit(1))),
        "tflops_per_device": tflops, "mfu": F.when(peak > 0, tflops / peak).otherwise(0.0),
    }


def step_times(events: DataFrame, ts: str, warmup: int, by: tuple[str, ...] = (), ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds step_time: seconds since the previous row, 0 for the first ``warmup`` ones and for the first of all; ``ties`` order equal times."""
    w = Window.partitionBy(*by).orderBy(ts, *ties)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    seconds = at - F.lag(at).over(w)
    return events.withColumn("step_time", F.when(F.row_number().over(w) <= max(warmup, 1), 0.0).otherwise(seconds / 1e6))


def micro_batches(metrics: DataFrame, step: str) -> DataFrame:
    """Micro-batch rows (loss, grad_norm, supervised_tokens, flops, seconds) by step: means of the first two, sums of the others."""
    return metrics.groupBy(step).agg(
        F.avg("loss").alias("loss"), F.avg("grad_norm").alias("grad_norm"), F.sum("supervised_tokens").alias("supervised_tokens"),
        F.sum("flops").alias("flops"), F.sum("seconds").alias("seconds"))


def validation_means(rows: DataFrame, step: str) -> DataFrame:
    """Mean loss and sum of tokens over the validation batches (step, loss, tokens) of each step."""
    return rows.groupBy(step).agg(F.avg("loss").alias("loss"), F.sum("tokens").alias("tokens"))


def due(step: Column, every: int) -> Column:
    """Whether a step is logged."""
    return F.pmod(step, F.lit(every)) == 0


def logged(metrics: DataFrame, step: str, every: int) -> DataFrame:
    """Rows that are due for logging; a table without loss or grad_norm is an error."""
    if missing := {"loss", "grad_norm"} - set(metrics.columns):
        raise KeyError(sorted(missing))
    return metrics.where(due(F.col(step), every))


def retained(checkpoints: DataFrame, step: str, keep: int = 2) -> DataFrame:
    """The latest checkpoints of a run; there are few, and the limit is the feature."""
    return checkpoints.orderBy(F.desc(step)).limit(keep)


def learning_rate(step: Column, kind: str, peak: float, num_steps: int, warmup: int = 0, end_factor: float = 0.0, stable: float = 0.8) -> Column:
    """``linear`` (constant after warm-up), ``cosine`` or ``wsd`` (stable, then linear decay)."""
    decay = max(num_steps - warmup, 1)
    after = step - warmup
    if kind == "linear":
        rate = F.lit(float(peak))
    elif kind == "cosine":
        share = F.least(F.greatest(after, F.lit(0)), F.lit(decay)) / decay
        rate = peak * ((1 - end_factor) * 0.5 * (1 + F.cos(share * math.pi)) + end_factor)
    elif kind == "wsd":
        flat = int(decay * stable)
        length = max(decay - flat, 1)
        share = F.least(F.greatest(after - flat, F.lit(0)), F.lit(length)) / length
        rate = peak - (peak - peak * end_factor) * share
    else:
        raise ValueError(f"unknown schedule {kind!r}: linear, cosine or wsd")
    return F.when(step < warmup, peak * step / max(warmup, 1)).otherwise(rate)
