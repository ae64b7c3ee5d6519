"""Chat datasets: JSON Lines to blocked records, and Parquet datasets with a sidecar.

Line numbers are physical and start at 1, blank lines included. They need no task that sees the
whole file: Spark tells each line's split by its start offset, lines are counted per split,
and a line's number is its place in its split plus the lines of the splits before it.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from chatpack.operators.storage import stored

MESSAGE = "struct<role:string,content:variant>"
SIDECAR = "metadata"
RECORDS = "records"
#: Record numbers that are filters of a scan.
ADDRESSES = 1000
PAYLOAD, INDEX = "payload", "index"


def positive(**values: int) -> None:
    for name, v in values.items():
        if v <= 0:
            raise ValueError(f"{name} must be positive, not {v}")


def line_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, first, earlier, filled): each split's first row id, the lines of its file before it, and its lines that are not blank."""
    counts = _raw_lines(spark, path).groupBy("file", "split").agg(
        F.count("*").alias("n"), F.min("at").alias("first"), F.count_if(F.col("value").rlike(r"\S")).alias("filled"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("file", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"), "filled")


def _raw_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value"), F.monotonically_increasing_id().alias("at")
    )


def read_lines(spark: SparkSession, path: str, offsets: DataFrame | None = None) -> DataFrame:
    """(file, stem, source_line, value) of every physical line; ``offsets`` are those of ``line_offsets``, if they are there already."""
    raw = _raw_lines(spark, path)
    offsets = (line_offsets(spark, path) if offsets is None else offsets).drop("filled")
    # Rows of a split are consecutive, so their ids are; the offsets have a row for each split only.
    numbered = raw.join(F.broadcast(offsets), ["file", "split"]) if offsets.count() <= 100_000 else raw.join(offsets, ["file", "split"])
    stem = F.regexp_extract("file", r"([^/]*?)(\.[^./]*)?$", 1)
    return numbered.select("file", stem.alias("stem"), (F.col("earlier") + F.col("at") - F.col("first") + 1).alias("source_line"), "value")


def session_id(stem: Column, line: Column) -> Column:
    return F.format_string("%s-%09d", stem, line)


def read_sessions(spark: SparkSession, path: str, offsets: DataFrame | None = None) -> DataFrame:
    """(session_id, source_line, session_meta, messages) of every line that is not blank.

    A line without a list of messages is an error. Its own session_id is ignored.
    """
    lines = read_lines(spark, path, offsets).where(F.col("value").rlike(r"\S"))
    doc = F.parse_json("value")
    kind = F.schema_of_variant(F.variant_get("doc", "$.messages", "variant"))
    ok = F.coalesce(kind.startswith("ARRAY"), F.lit(False))
    fields = F.expr("cast(doc as map<string,variant>)")
    return lines.withColumn("doc", doc).withColumn(
        "messages", F.when(ok, F.expr(f"cast(variant_get(doc, '$.messages', 'variant') as array<{MESSAGE}>)"))
        .otherwise(F.raise_error(F.concat(F.lit("no list of messages in line "), F.col("source_line"))).cast(f"array<{MESSAGE}>"))
    ).select(
        session_id(F.col("stem"), F.col("source_line")).alias("session_id"), "source_line",
        F.map_filter(fields, lambda k, v: ~k.isin("messages", "session_id")).alias("session_meta"), "messages",
    )


def blocks(sessions: DataFrame, messages_per_record: int = 128) -> DataFrame:
    """Sessions cut into records of a fixed number of messages; sessions without messages give none."""
    positive(messages_per_record=messages_per_record)
    n = F.size("messages")
    count = F.ceil(n / messages_per_record).cast("int")
    ids = F.when(n > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    start = (F.col("block_idx") * messages_per_record).cast("long")
    part = F.slice("messages", start.cast("int") + 1, messages_per_record)
    return sessions.select("*", F.explode(ids).alias("block_idx")).select(
        "session_id", "source_line", F.col("block_idx").cast("long").alias("block_idx"), start.alias("message_start"),
        (start + F.size(part)).alias("message_end"), "session_meta", part.alias("messages"),
    )


def message_blocks(messages: DataFrame, messages_per_record: int = 128, session: str = "session_id", position: str = "message_idx", message: str = "message") -> DataFrame:
    """The records of ``blocks`` for a table that has a row for each message, at positions from 0.

    Rows are grouped by record, so no session is held whole. Messages of equal position are in any order.
    """
    positive(messages_per_record=messages_per_record)
    order = lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)
    found = F.collect_list(F.struct(F.col(position).alias("at"), F.col(message).alias("message")))
    return messages.groupBy(F.col(session).alias("session_id"), F.floor(F.col(position) / messages_per_record).alias("block_idx")).agg(
        F.min(position).alias("message_start"), (F.max(position) + 1).alias("message_end"),
        F.transform(F.array_sort(found, order), lambda m: m["message"]).alias("messages"))


def with_record_idx(df: DataFrame, *order: str) -> DataFrame:
    """Adds record_idx, the 0-based place in the given order, without a task that sees all rows.

    Rows are range-partitioned and counted per partition; a row's number is its place
    in its partition plus the rows of the partitions before it.
    """
    from chatpack.operators.ordering import numbered

    return numbered(df, list(order), "record_idx")


def write(df: DataFrame, path: str, kind: str, metadata: dict[str, Any], records_per_shard: int, overwrite: bool = False) -> dict[str, Any]:
    """Records (with record_idx) as Parquet shards and a sidecar; no records is an error.

    A non-empty folder is refused unless ``overwrite``. The shards of each write go to a folder of their own, and the
    sidecar that names it is written last, as one file under a new version: readers see the dataset of before or the
    new one, whatever fails in between. The version before stays readable until the next write. Records and
    shards are counted by the write itself.
    """
    positive(records_per_shard=records_per_shard)
    spark = df.sparkSession
    taken = exists(spark, path)
    if taken and not overwrite:
        raise FileExistsError(path)
    versions = _versions(spark, path)
    version = max(versions, default=0) + 1
    folder = f"records-{uuid.uuid4().hex}" if taken else RECORDS
    shard, seen = F.floor(F.col("record_idx") / records_per_shard).cast("int"), Observation()
    ordered = df.withColumn("shard", shard).repartition("shard").sortWithinPartitions("shard", "record_idx")
    counted = ordered.observe(seen, F.count(F.lit(1)).alias("n"), F.max("shard").alias("last"))
    counted.write.partitionBy("shard").parquet(f"{path}/{folder}")
    n = seen.get["n"]
    if not n:
        delete(spark, f"{path}/{folder}")
        raise ValueError("a dataset needs at least one record")
    doc = {"version": 1, "kind": kind, "num_records": n, "num_shards": seen.get["last"] + 1, "records_per_shard": records_per_shard, "records": folder} | metadata
    spark.createDataFrame([(json.dumps(doc, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/{SIDECAR}/v={version}")
    for old in sorted(versions)[:-1]:
        delete(spark, f"{path}/{versions[old].get('records', RECORDS)}")
        delete(spark, f"{path}/{SIDECAR}/v={old}")
    return doc


def _versions(spark: SparkSession, path: str) -> dict[int, dict[str, Any]]:
    """The sidecars of all versions that were committed."""
    if not exists(spark, f"{path}/{SIDECAR}"):
        return {}
    found = spark.read.schema("value string, v int").text(f"{path}/{SIDECAR}").collect()
    return {r["v"]: json.loads(r["value"]) for r in found}


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder of any file system that Spark reads holds something."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and len(fs.listStatus(p)) > 0


def metadata(spark: SparkSession, path: str) -> dict[str, Any]:
    """The sidecar of the last version."""
    versions = {} if path.endswith((".jsonl", ".json")) else _versions(spark, path)
    if not versions:
        raise ValueError(f"{path} is no compiled dataset: it has no sidecar")
    return versions[max(versions)]


def read(spark: SparkSession, path: str, kind: str | None = None, keep_shard: bool = False) -> DataFrame:
    """The records of a dataset; another kind than asked for is an error."""
    doc = metadata(spark, path)
    if kind and doc["kind"] != kind:
        raise ValueError(f"{path} is a {doc['kind']} dataset; a {kind} dataset is needed")
    found = shards(spark, path, doc["records"])
    if found != doc["num_shards"]:
        raise FileNotFoundError(f"{path} has {found} of {doc['num_shards']} shards")
    rows = spark.read.parquet(f"{path}/{doc['records']}")
    return rows if keep_shard else rows.drop("shard")


def records_at(spark: SparkSession, path: str, wanted: DataFrame, kind: str | None = None) -> DataFrame:
    """The records with the numbers in ``wanted`` (record_idx, ...), joined with its columns.

    A number is an address: it gives the record's shard, and shards are sorted by it. Only addressed shards are listed, and
    in them only the row groups and pages whose range of numbers has wanted ones are read, as far as
    the wanted numbers are few enough (ADDRESSES) to be a filter; then, and for any number of them, a join picks the records.
    """
    doc = metadata(spark, path)
    size = doc["records_per_shard"]
    rows = read(spark, path, kind, keep_shard=True)
    some = wanted.select(F.col("record_idx").cast("long").alias("i")).distinct().limit(ADDRESSES + 1).collect()
    if len(some) <= ADDRESSES:
        numbers = sorted(r["i"] for r in some if r["i"] is not None)
        ranges: dict[int, list[int]] = {}
        for i in numbers:
            ranges.setdefault(i // size, []).append(i)
        near = F.lit(False)
        for own in ranges.values():
            near = near | F.col("record_idx").between(own[0], own[-1])
        rows = rows.where(F.col("shard").isin(list(ranges)) & near & F.col("record_idx").isin(numbers))
        return rows.drop("shard").join(F.broadcast(wanted), "record_idx")
    own = wanted.withColumn("shard", F.floor(F.col("record_idx") / size).cast("int"))
    return rows.join(own, ["shard", "record_idx"]).drop("shard")


def shards(spark: SparkSession, path: str, folder: str = RECORDS) -> int:
    """Shard folders of a dataset's records that hold a file."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}/shard=*/*.parquet")
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return len({f.getPath().getParent().getName() for f in files or []})


def compile_jsonl(spark: SparkSession, source: str, path: str, messages_per_record: int = 128, records_per_shard: int = 10_000, overwrite: bool = False) -> dict[str, Any]:
    """A JSON Lines file as a payload dataset; num_sessions counts all lines that are not blank."""
    positive(messages_per_record=messages_per_record, records_per_shard=records_per_shard)
    offsets = stored(line_offsets(spark, source))
    records = with_record_idx(blocks(read_sessions(spark, source, offsets), messages_per_record), "session_id", "block_idx")
    n = offsets.agg(F.sum("filled")).first()[0] or 0
    return write(records, path, PAYLOAD, {"source_path": source, "messages_per_record": messages_per_record, "num_sessions": n}, records_per_shard, overwrite)
