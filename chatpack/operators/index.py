"""Chunk indexes over payload datasets, their statistics, and training streams from them."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatpack.functions import chatml
from chatpack.operators import iterate, packing, permute, stats
from chatpack.sources import dataset

#: A measure takes a message (role, content as variant) and gives its length, or a struct with length and any of
#: vision_tokens, vision_patches, num_images and image_sizes (an array of height and width).
Measure = Callable[[Column], Column]
MEASURES = ("vision_tokens", "vision_patches", "num_images")
SIZES = "array<struct<height:long,width:long>>"
#: Fields of an example that no meta field of the same name replaces.
RESERVED = ("session_id", "chunk_id", "messages")


def content_text(message: Column) -> Column:
    """The text of a message whose content is a string or a list of blocks."""
    content = message["content"]
    is_text = F.schema_of_variant(content) == "STRING"
    blocks = F.try_variant_get(content, "$", "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "")
    return F.when(is_text, F.try_variant_get(content, "$", "string")).otherwise(F.coalesce(joined, F.lit("")))


def char_measure(message: Column) -> Column:
    """Characters of the rendered message."""
    return chatml.char_length(message["role"], content_text(message))


def message_rows(payload: DataFrame) -> DataFrame:
    """(session_id, message_idx, block_idx, record_idx, message) of every message."""
    each = payload.select("session_id", "block_idx", "record_idx", "message_start", F.posexplode("messages").alias("at", "message"))
    return each.select("session_id", (F.col("message_start") + F.col("at")).alias("message_idx"), "block_idx", "record_idx", "message")


def build_chunk_index(spark: SparkSession, payload_path: str, path: str, max_length: int, measure: Measure = char_measure, records_per_shard: int = 100_000, overwrite: bool = False, profile: dict[str, Any] | None = None) -> dict[str, Any]:
    """Packs a payload dataset's messages into chunks, and writes the index and its statistics.

    The measure runs once for each message: what it gives is stored before it is used.
    """
    dataset.positive(max_length=max_length, records_per_shard=records_per_shard)
    payload = dataset.read(spark, payload_path, dataset.PAYLOAD)
    about = dataset.metadata(spark, payload_path)
    rows = message_rows(payload).withColumn("m", measure(F.col("message")))
    fields = rows.schema["m"].dataType.fieldNames() if rows.schema["m"].dataType.typeName() == "struct" else []
    of = lambda name: F.coalesce(F.col(f"m.{name}").cast("long"), F.lit(0)) if name in fields else F.lit(0).cast("long")
    length = F.col("m.length") if fields else F.col("m")
    sized = "image_sizes" in fields
    own = [of(k).alias(k) for k in MEASURES] + ([F.col("m.image_sizes").cast(SIZES).alias("image_sizes")] if sized else [])
    measured = rows.select("session_id", "message_idx", "block_idx", "record_idx", length.cast("long").alias("length"), *own)
    messages = packing.assign_chunks(measured, max_length).withColumn("text_tokens", F.col("length") - F.col("vision_tokens")).persist()
    n = about["messages_per_record"]
    chunks = packing.describe_chunks(messages, extra=MEASURES).withColumn("text_tokens", F.col("measured_length") - F.col("vision_tokens"))
    pointers = packing.block_range(chunks, n)
    dataset.write(
        dataset.with_record_idx(pointers, "session_id", "chunk_id"), path, dataset.INDEX,
        {"payload_path": payload_path, "payload_num_records": about["num_records"], "max_length": max_length, "profile_metadata": profile or {}}, records_per_shard, overwrite)
    place = F.struct("record_idx", "message_idx", "k").alias("ordinal")
    images = messages.select("record_idx", "message_idx", F.posexplode("image_sizes").alias("k", "size")).select("size.height", "size.width", place) if sized else None
    doc = stats.summary(messages, dataset.read(spark, path), images)
    spark.createDataFrame([(json.dumps(doc, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/token_stats")
    messages.unpersist()
    return dataset.metadata(spark, path) | {"token_stats": doc}


def examples(spark: SparkSession, path: str, chunks: DataFrame | None = None) -> DataFrame:
    """Chunks of an index with their messages and session_meta, resolved from the payload."""
    about = dataset.metadata(spark, path)
    own = chunks if chunks is not None else dataset.read(spark, path, dataset.INDEX)
    return packing.resolve(own, dataset.read(spark, about["payload_path"], dataset.PAYLOAD))


def rendered(message: Column) -> Column:
    """The message in ChatML."""
    return chatml.render(message["role"], content_text(message))


def example_fields(found: DataFrame) -> DataFrame:
    """``found`` (session_id, chunk_id, session_meta, messages) with example: its meta fields and its own, by name, as variants.

    Meta fields named like its own give way to them.
    """
    meta = F.map_filter(F.coalesce("session_meta", F.create_map().cast("map<string,variant>")), lambda k, v: ~k.isin(*RESERVED))
    own = F.create_map(*[c for k in RESERVED for c in (F.lit(k), F.to_variant_object(F.col(k)) if k == "messages" else F.col(k).cast("variant"))])
    return found.withColumn("example", F.map_concat(meta, own))


def training_stream(spark: SparkSession, path: str, batch_size: int, shuffle: bool = True, seed: int = 0, num_epochs: int = 1, dp_size: int = 1, start_batch: int = 0) -> DataFrame:
    """Examples with dp_index, batch_id and slot: shuffled, sharded, batched and cut at the resume point."""
    dataset.positive(batch_size=batch_size)
    about = dataset.metadata(spark, path)
    index = dataset.read(spark, path, dataset.INDEX)
    n, own = about["num_records"], about["num_records"] // max(1, dp_size)
    stream = permute.epochs(index, n, num_epochs, seed, dp_size) if shuffle else iterate.epochs(index, n, num_epochs, seed, False, dp_size)
    placed = iterate.batches(stream, own * num_epochs, batch_size, start_batch)
    resolved = examples(spark, path, index).select("session_id", "chunk_id", "session_meta", "messages")
    return placed.join(resolved, ["session_id", "chunk_id"])


def save_state(spark: SparkSession, path: str, next_batch: int, step: int | None = None, rng: list[int] | None = None, metrics: dict[str, float] | None = None, every: int = 1, keep: int = 2, **stream: Any) -> bool:
    """One checkpoint of a run: the place of its stream with the stream's arguments, its step, random state and metrics.

    All of it is one file in a folder of its own for each place, so it is there as a whole or not at all. Steps that are no
    multiple of ``every`` are not saved (False comes back); of the others the last ``keep`` stay.
    """
    if step is not None and step % every:
        return False
    doc = {"stream": {"start_batch": next_batch} | stream, "step": step, "rng": rng, "metrics": metrics or {}}
    spark.createDataFrame([(json.dumps(doc, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/batch={next_batch}")
    places = spark.read.schema("value string, batch long").text(path).select("batch").orderBy(F.desc("batch"))
    for old in [r["batch"] for r in places.collect()][keep:]:
        dataset.delete(spark, f"{path}/batch={old}")
    return True


def saved_state(spark: SparkSession, path: str) -> dict[str, Any]:
    """The latest checkpoint: stream, step, rng and metrics."""
    last = spark.read.schema("value string, batch long").text(path).orderBy(F.desc("batch")).first()
    if last is None:
        raise ValueError(f"{path} holds no state")
    return json.loads(last["value"])


def resumed_stream(spark: SparkSession, index_path: str, path: str) -> DataFrame:
    """The rest of the stream whose latest place was saved."""
    return training_stream(spark, index_path, **saved_state(spark, path)["stream"])
