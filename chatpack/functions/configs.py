"""Model config documents as tables: builders with aliases, checks and the way back.

A config document is a JSON string; a builder makes the columns that the FLOP tables take. A missing
field is an error that names it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatpack.functions.mapping import dtype_of

# Our column, then the document's fields by preference.
FIELDS = {
    "d": ("hidden_size",),
    "heads": ("num_attention_heads",),
    "kv_heads": ("num_key_value_heads",),
    "head_dim": ("head_dim",),
    "mlp": ("intermediate_size",),
    "vocab": ("vocab_size",),
    "layers": ("num_hidden_layers",),
}
EXPERT_FIELDS = {
    "experts": ("num_experts", "num_local_experts"),
    "top_k": ("num_experts_per_tok",),
    "moe_mlp": ("moe_intermediate_size",),
}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of a JSON file, or of all of a folder and those below it."""
    files = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def field(doc: Column, *names: str, kind: str = "bigint", default=None) -> Column:
    """The first of the fields that the document has; the default, or an error, without one."""
    found = [F.try_variant_get(doc, f"$.{n}", kind) for n in names]
    last = F.lit(default).cast(kind) if default is not None else F.raise_error(F.lit("missing " + " or ".join(names))).cast(kind)
    return F.coalesce(*found, last)


def decoder(docs: DataFrame, name: str, text: str, nested: bool = False) -> DataFrame:
    """(name, d, heads, ..., dtype, tied) of config documents in the column ``text``; ``nested`` ones keep them in text_config."""
    doc = F.parse_json(text)
    body = F.variant_get(doc, "$.text_config", "variant") if nested else doc
    moe = F.coalesce(F.try_variant_get("doc", "$.num_experts", "bigint"), F.try_variant_get("doc", "$.num_local_experts", "bigint"), F.lit(0)) > 0
    d = F.col("doc")
    expert = {k: F.when(moe, field(d, *v)).otherwise(F.lit(0).cast("bigint")) for k, v in EXPERT_FIELDS.items()}
    dtype = F.coalesce(F.try_variant_get(d, "$.torch_dtype", "string"), F.try_variant_get(d, "$.dtype", "string"), F.lit("bfloat16"))
    return docs.withColumn("doc", body).select(
        name, *[field(d, *v).alias(k) for k, v in FIELDS.items()], *[c.alias(k) for k, c in expert.items()],
        field(d, "decoder_sparse_step", default=1).alias("sparse_step"),
        F.coalesce(F.try_variant_get(d, "$.mlp_only_layers", "array<int>"), F.array().cast("array<int>")).alias("mlp_only"),
        dtype_of(dtype).alias("dtype"), field(d, "tie_word_embeddings", kind="boolean", default=False).alias("tied"),
    )


def vision_dtype(doc: Column) -> Column:
    """The vision part's dtype: its own, or the text part's."""
    own = F.try_variant_get(doc, "$.vision_config.dtype", "string")
    return dtype_of(F.coalesce(own, F.try_variant_get(doc, "$.text_config.dtype", "string"), F.try_variant_get(doc, "$.dtype", "string")))


def to_document(configs: DataFrame, name: str) -> DataFrame:
    """(name, document): the JSON document of each config row, with sorted fields."""
    fields = sorted([*((v[0], k) for k, v in (FIELDS | EXPERT_FIELDS).items()), ("decoder_sparse_step", "sparse_step"), ("mlp_only_layers", "mlp_only"), ("torch_dtype", "dtype"), ("tie_word_embeddings", "tied")])
    return configs.select(name, F.to_json(F.struct(*[F.col(k).alias(v) for v, k in fields])).alias("document"))


def unpivoted(configs: DataFrame, name: str) -> DataFrame:
    """(name, field, value) rows, for comparing configs."""
    columns = [c for c in configs.columns if c != name]
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.to_json(F.struct(F.col(c).alias("v"))).alias("value")) for c in columns])
    return configs.select(name, F.explode(rows).alias("r")).select(name, "r.field", "r.value")


def dispatch(models: DataFrame, model: str, families: list[tuple[str, str]]) -> DataFrame:
    """Adds family: that of the first pattern that the model's name matches; none is an error. ``families`` is a bounded list."""
    out = F.raise_error(F.concat(F.lit("unknown model: "), F.col(model))).cast("string")
    for pattern, family in reversed(families):
        out = F.when(F.col(model).rlike(pattern), family).otherwise(out)
    return models.withColumn("family", out)
