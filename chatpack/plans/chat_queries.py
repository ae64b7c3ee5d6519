"""Queries on conversations: blocks, packing, statistics, epochs, encoding and positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatpack.functions import chatml, segments
from chatpack.operators import encode, index, iterate, measures, packing, permute, stats
from chatpack.operators.scans import scan
from chatpack.plans.tables import ASSISTANT, END, MAX_LENGTH, START, messages, read, shared_folder, token_ids, tokens
from chatpack.sources import dataset
from chatpack.sources.batches import batch_stream
from chatpack.streaming.packing import pack_stream

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_RENDER = "'<|im_start|>' || coalesce(role,'') || chr(10) || coalesce(text,'') || '<|im_end|>' || chr(10)"
_PACKED = f"""WITH RECURSIVE m AS (SELECT conv_id, turn, length({_RENDER}) AS len, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
f AS (SELECT conv_id, rn, turn, len, CAST(0 AS BIGINT) AS chunk_id, len AS cur FROM m WHERE rn = 1
UNION ALL SELECT m.conv_id, m.rn, m.turn, m.len, CASE WHEN f.cur + m.len > {MAX_LENGTH} THEN f.chunk_id + 1 ELSE f.chunk_id END,
CASE WHEN f.cur + m.len > {MAX_LENGTH} THEN m.len ELSE f.cur + m.len END FROM f JOIN m ON m.conv_id = f.conv_id AND m.rn = f.rn + 1)
"""
_CHUNKS = "SELECT conv_id, chunk_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS num_messages, CAST(sum(len) AS BIGINT) AS measured_length FROM f GROUP BY conv_id, chunk_id"


def blocks(spark, sf_dir):
    return dataset.message_blocks(messages(spark, sf_dir).withColumn("message", F.struct("role", "text")), 3)


def compiled(spark, sf_dir):
    """The conversations as a payload dataset in the shared folder, and its path."""
    path = shared_folder(spark, "datasets")
    rows = messages(spark, sf_dir).withColumn("message", F.struct("role", F.col("text").cast("variant").alias("content")))
    records = dataset.message_blocks(rows, 3).withColumn("session_meta", F.create_map().cast("map<string,variant>"))
    about = {"source_path": f"{sf_dir}/conversations.parquet", "messages_per_record": 3, "num_sessions": rows.select("session_id").distinct().count()}
    dataset.write(dataset.with_record_idx(records, "session_id", "block_idx"), f"{path}/payload", dataset.PAYLOAD, about, 1000)
    return path


def assigned(spark, sf_dir):
    return packing.assign_chunks(messages(spark, sf_dir), MAX_LENGTH, oversize="own")


@query("SELECT conv_id, turn // 3 AS block_idx, min(turn) AS message_start, max(turn) + 1 AS message_end, count(*) AS num_messages FROM conversations GROUP BY 1, 2")
def session_blocks(spark, sf_dir):
    return blocks(spark, sf_dir).select(F.col("session_id").alias("conv_id"), "block_idx", "message_start", "message_end", F.size("messages").cast("long").alias("num_messages"))


@query(f"SELECT conv_id, turn, md5({_RENDER}) AS rendered FROM conversations")
def chatml_render(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(chatml.render(F.col("role"), F.col("text"))).alias("rendered"))


@query(f"SELECT conv_id, turn, length({_RENDER}) AS length FROM conversations")
def message_lengths(spark, sf_dir):
    return messages(spark, sf_dir).select(F.col("session_id").alias("conv_id"), F.col("message_idx").alias("turn"), "length")


@query(f"SELECT conv_id, turn, length({_RENDER}) AS length FROM conversations WHERE length({_RENDER}) > 1000")
def oversize_messages(spark, sf_dir):
    return message_lengths(spark, sf_dir).where("length > 1000")


@query(_PACKED + _CHUNKS)
def pack_chunks(spark, sf_dir):
    return packing.describe_chunks(assigned(spark, sf_dir)).select(
        F.col("session_id").alias("conv_id"), "chunk_id", F.col("first_message").alias("first_turn"), F.col("last_message").alias("last_turn"), "num_messages", "measured_length")


_JOINED = _PACKED.replace("SELECT conv_id, turn, length", "SELECT CASE WHEN conv_id % 3 = 0 THEN 0 ELSE conv_id END AS conv_id, conv_id * 1000 + turn AS turn, length").replace("PARTITION BY conv_id ORDER BY turn", "PARTITION BY CASE WHEN conv_id % 3 = 0 THEN 0 ELSE conv_id END ORDER BY conv_id, turn")


@query(_JOINED + "SELECT conv_id, turn, len AS length, chunk_id FROM f")
def pack_hot_session(spark, sf_dir):
    """A third of all conversations as one session, packed by ranges of messages."""
    own = messages(spark, sf_dir).select(
        F.when(F.col("session_id") % 3 == 0, 0).otherwise(F.col("session_id")).cast("long").alias("session_id"),
        (F.col("session_id") * 1000 + F.col("message_idx")).alias("message_idx"), "length")
    packed = packing.assign_chunks(own, MAX_LENGTH, oversize="own", session_rows=0)
    return packed.select(F.col("session_id").alias("conv_id"), F.col("message_idx").alias("turn"), "length", "chunk_id")


@query(_PACKED + f"SELECT conv_id, chunk_id, first_turn // 3 AS start_block, first_turn % 3 AS start_message_offset, last_turn // 3 AS end_block, last_turn % 3 + 1 AS end_message_offset FROM ({_CHUNKS})")
def chunk_pointers(spark, sf_dir):
    chunks = packing.block_range(pack_chunks(spark, sf_dir), 3, "first_turn", "last_turn")
    return chunks.select("conv_id", "chunk_id", "start_block", "start_message_offset", "end_block", "end_message_offset")


@query(_PACKED + f"SELECT f.conv_id, chunk_id, count(*) AS num_messages, md5(string_agg({_RENDER}, '' ORDER BY f.turn)) AS example FROM f JOIN conversations c ON c.conv_id = f.conv_id AND c.turn = f.turn GROUP BY 1, 2")
def chunk_examples(spark, sf_dir):
    """Chunks resolved through their pointers into blocks of three messages."""
    records = blocks(spark, sf_dir).withColumn("session_meta", F.lit(None).cast("string"))
    pointers = chunk_pointers(spark, sf_dir).withColumnRenamed("conv_id", "session_id")
    text = F.array_join(F.transform("messages", lambda m: chatml.render(m["role"], m["text"])), "")
    return packing.resolve(pointers, records).select(F.col("session_id").alias("conv_id"), "chunk_id", F.size("messages").cast("long").alias("num_messages"), F.md5(text).alias("example"))


def _distribution_sql(source: str, metrics: list[str], by: str = "") -> str:
    two = lambda e: f"floor(({e}) * 100 + 0.5) / 100"
    one = lambda m: (
        f"SELECT {by}'{m}' AS metric, CAST(coalesce(sum({m}),0) AS BIGINT) AS sum, coalesce(min({m}),0) AS min, coalesce(max({m}),0) AS max, {two(f'avg({m})')} AS mean, {two(f'quantile_cont({m},0.5)')} AS median, "
        f"{two(f'stddev_pop({m})')} AS std, {two(f'quantile_cont({m},0.95)')} AS p95, {two(f'quantile_cont({m},0.99)')} AS p99 FROM ({source}) {'GROUP BY ALL' if by else ''}")
    return " UNION ALL ".join(one(m) for m in metrics)


_MEASURED = f"SELECT role, CAST(length({_RENDER}) AS BIGINT) AS length, CAST(length(text) AS BIGINT) AS text_length FROM conversations"


@query(_distribution_sql(_MEASURED, ["length", "text_length"]))
def stats_per_message(spark, sf_dir):
    return stats.distributions(messages(spark, sf_dir).select("length", F.length("text").alias("text_length")), ["length", "text_length"])


@query(_distribution_sql(_MEASURED, ["length"], "role, "))
def stats_per_role(spark, sf_dir):
    return stats.distributions(messages(spark, sf_dir), ["length"], ("role",))


@query(_PACKED + ", c AS (" + _CHUNKS + ") " + _distribution_sql("SELECT * FROM c", ["measured_length", "num_messages"]))
def stats_per_chunk(spark, sf_dir):
    return stats.distributions(pack_chunks(spark, sf_dir), ["measured_length", "num_messages"])


@query(_PACKED + f"SELECT num_messages AS value, count(*) AS n FROM ({_CHUNKS}) GROUP BY 1")
def freq_messages_per_chunk(spark, sf_dir):
    return stats.frequencies(pack_chunks(spark, sf_dir), "num_messages")


@query("SELECT role, count(*) AS n, min(conv_id * 1000 + turn) AS first_seen FROM conversations GROUP BY role")
def role_histogram(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("ordinal", F.col("conv_id") * 1000 + F.col("turn"))
    return stats.histogram(c, ["role"], "ordinal")


@query("SELECT count(*) AS num_records, count(DISTINCT conv_id) AS num_sessions, CAST(ceil(count(*) / 1000.0) AS BIGINT) AS num_shards FROM (SELECT DISTINCT conv_id, turn // 3 FROM conversations)")
def dataset_counts(spark, sf_dir):
    """What the sidecar of the compiled dataset says."""
    doc = dataset.metadata(spark, f"{compiled(spark, sf_dir)}/payload")
    return spark.createDataFrame([(doc["num_records"], doc["num_sessions"], doc["num_shards"])], "num_records long, num_sessions long, num_shards long")


@query("SELECT row_number() OVER (ORDER BY conv_id, turn // 3) - 1 AS record_idx, conv_id, turn // 3 AS block_idx, min(turn) AS message_start, max(turn) + 1 AS message_end, count(*) AS num_messages FROM conversations GROUP BY conv_id, turn // 3")
def compiled_records(spark, sf_dir):
    """Numbered records of the compiled dataset, read back from its shards."""
    records = dataset.read(spark, f"{compiled(spark, sf_dir)}/payload", dataset.PAYLOAD)
    return records.select("record_idx", F.col("session_id").alias("conv_id"), "block_idx", "message_start", "message_end", F.size("messages").cast("long").alias("num_messages"))


@query(f"SELECT conv_id, turn // 3 AS block_idx, min(turn) AS message_start, max(turn) + 1 AS message_end, count(*) AS num_messages, md5(string_agg({_RENDER}, '' ORDER BY turn)) AS text FROM conversations GROUP BY 1, 2")
def jsonl_records(spark, sf_dir):
    """Records compiled from JSON Lines files that hold the conversations, blank lines between them."""
    path = shared_folder(spark, "datasets")
    c = read(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content"))))
    own = F.transform(turns, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    lines = c.groupBy("conv_id").agg(own.alias("messages")).select(F.concat(F.to_json(F.struct("conv_id", "messages")), F.lit("\n")).alias("value"))
    lines.write.text(f"{path}/lines")
    dataset.compile_jsonl(spark, f"{path}/lines", f"{path}/payload", messages_per_record=3, records_per_shard=500)
    records = dataset.read(spark, f"{path}/payload", dataset.PAYLOAD)
    text = F.array_join(F.transform("messages", lambda m: chatml.render(m["role"], index.content_text(m))), "")
    return records.select(F.col("session_meta")["conv_id"].cast("long").alias("conv_id"), "block_idx", "message_start", "message_end", F.size("messages").cast("long").alias("num_messages"), F.md5(text).alias("text"))


@query("WITH r AS (SELECT row_number() OVER (ORDER BY conv_id, turn // 3) - 1 AS record_idx, conv_id, turn // 3 AS block_idx, count(*) AS num_messages FROM conversations GROUP BY conv_id, turn // 3) SELECT i AS place, r.* FROM range(100) w(i) JOIN r ON r.record_idx = (i * 7919) % (SELECT count(*) FROM r)")
def scattered_records(spark, sf_dir):
    """A hundred scattered records of the compiled conversations, with their places in the request."""
    path = f"{compiled(spark, sf_dir)}/payload"
    n = dataset.metadata(spark, path)["num_records"]
    wanted = spark.range(100).select(F.col("id").alias("place"), (F.col("id") * 7919 % n).alias("record_idx"))
    found = dataset.records_at(spark, path, wanted, dataset.PAYLOAD)
    return found.select("place", "record_idx", F.col("session_id").alias("conv_id"), "block_idx", F.size("messages").cast("long").alias("num_messages"))


@query(f"SELECT conv_id, turn, length({_RENDER}) AS length FROM conversations")
def stored_measures(spark, sf_dir):
    """Messages of the compiled records with measures that were stored before, joined bucket by bucket."""
    records = dataset.read(spark, f"{compiled(spark, sf_dir)}/payload", dataset.PAYLOAD)
    rows = index.message_rows(records).withColumn("message_offset", F.col("message_idx") - F.col("block_idx") * 3)
    n = measures.buckets_for(rows.count())
    own = measures.bucketed(rows.select("record_idx", "message_offset", index.char_measure(F.col("message")).alias("length")), n)
    messages_ = measures.bucketed(rows.select("record_idx", "message_offset", "session_id", "message_idx"), n)
    found = measures.with_measures(messages_, own)
    return found.select(F.col("session_id").alias("conv_id"), F.col("message_idx").alias("turn"), "length")


def indexed(spark, sf_dir):
    """The chunk index of the compiled dataset: its path and its sidecar with the statistics."""
    path = compiled(spark, sf_dir)
    return f"{path}/index", index.build_chunk_index(spark, f"{path}/payload", f"{path}/index", MAX_LENGTH)


@query(_PACKED + ", c AS (" + _CHUNKS + ") " + _distribution_sql("SELECT len AS length FROM f", ["length"]) + " UNION ALL " + _distribution_sql("SELECT * FROM c", ["measured_length", "num_messages"]))
def index_statistics(spark, sf_dir):
    """Rows of the statistics document that is written beside the chunk index."""
    doc = indexed(spark, sf_dir)[1]["token_stats"]
    found = {"length": doc["per_message"]["length"]} | {m: doc["per_chunk"][m] for m in ("measured_length", "num_messages")}
    names = {"sum": int, "min": int, "max": int, "mean": float, "median": float, "std": float, "p95": float, "p99": float}
    kinds = ", ".join(f"{n} {'long' if t is int else 'double'}" for n, t in names.items())
    return spark.createDataFrame([(m, *[t(v[n]) for n, t in names.items()]) for m, v in found.items()], f"metric string, {kinds}")


@query(_PACKED + f"SELECT f.conv_id, chunk_id, count(*) AS num_messages, md5(string_agg({_RENDER}, '' ORDER BY f.turn)) AS example FROM f JOIN conversations c ON c.conv_id = f.conv_id AND c.turn = f.turn GROUP BY 1, 2")
def index_examples(spark, sf_dir):
    """Chunks of the stored index, resolved from the shards of the payload."""
    found = index.examples(spark, indexed(spark, sf_dir)[0])
    text = F.array_join(F.transform("messages", lambda m: chatml.render(m["role"], index.content_text(m))), "")
    return found.select(F.col("session_id").alias("conv_id"), "chunk_id", F.size("messages").cast("long").alias("num_messages"), F.md5(text).alias("example"))


_N = "(SELECT count(*) FROM documents)"


def _records(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_idx"))
    return docs, docs.count()


def _epoch_sql(dp: int, epochs: int = 2, seed: int = 7) -> str:
    own = f"({_N} // {dp})"
    return (f"SELECT doc_id AS record_idx, epoch, doc_id // {own} AS dp_index, epoch * {own} + row_number() OVER (PARTITION BY doc_id // {own}, epoch ORDER BY md5('{seed}:' || epoch || ':' || doc_id), doc_id) - 1 AS position "
            f"FROM documents, range({epochs}) r(epoch) WHERE doc_id < {own} * {dp}")


@query(_epoch_sql(1))
def epoch_shuffle(spark, sf_dir):
    docs, n = _records(spark, sf_dir)
    return iterate.epochs(docs, n, num_epochs=2, seed=7).select("record_idx", "epoch", "dp_index", "position")


@query(f"SELECT doc_id AS record_idx, doc_id // ({_N} // 3) AS dp_index FROM documents WHERE doc_id < {_N} // 3 * 3")
def dp_shards(spark, sf_dir):
    docs, n = _records(spark, sf_dir)
    return iterate.shards(docs, n, 3)


def _batch_sql(start: int) -> str:
    return f"SELECT record_idx, dp_index, position, position // 16 AS batch_id, position % 16 AS slot FROM ({_epoch_sql(4)}) WHERE position < 2 * ({_N} // 4) // 16 * 16 AND position >= {start * 16}"


def _batches(spark, sf_dir, start):
    docs, n = _records(spark, sf_dir)
    stream = iterate.epochs(docs, n, num_epochs=2, seed=7, dp_size=4)
    return iterate.batches(stream, 2 * (n // 4), 16, start).select("record_idx", "dp_index", "position", "batch_id", "slot")


@query(_batch_sql(0))
def epoch_batches(spark, sf_dir):
    return _batches(spark, sf_dir, 0)


@query(_batch_sql(5))
def resume_after(spark, sf_dir):
    """The stream after five batches: exactly the rest of the uninterrupted one."""
    return _batches(spark, sf_dir, 5)


def _mixed_sql(x: str, key: str) -> str:
    """The mixing function of the epoch permutation."""
    p = permute.PRIME
    a, b, c = permute.FACTORS
    t = f"(({x})::BIGINT % {p} * {a} + ({x})::BIGINT // {p} * {permute.STEPS[0]} + {key}) % {p}"
    t = f"list_transform([{t}], lambda t: (xor(t, t >> {permute.STEPS[1]}) * {b} + {permute.STEPS[0]}) % {p})"
    return f"list_transform({t}, lambda t: (xor(t, t >> {permute.STEPS[2]}) * {c} + {key}) % {p})[1]"


def _permuted_sql(dp: int, epochs: int = 2, seed: int = 7) -> str:
    own = f"({_N} // {dp})"
    return f"""WITH RECURSIVE own AS (SELECT CAST({own} AS BIGINT) AS n), every AS (SELECT e, s, {_mixed_sql(_mixed_sql(_mixed_sql(str(seed), "1") + " + e", "2") + " + s", "3")} AS base FROM range({epochs}) a(e), range({dp}) b(s)),
rounds AS (SELECT e, s, r, {_mixed_sql("base + r", "4")} AS a, {_mixed_sql("base + r", "5")} AS b FROM every, own, range(200) c(r) WHERE r < 3 * length(ltrim(bin(n), '0'))),
walk AS (SELECT doc_id, e, doc_id // n AS s, CAST(0 AS BIGINT) AS r, doc_id % n AS x FROM documents, own, range({epochs}) a(e) WHERE doc_id < n * {dp}
UNION ALL SELECT doc_id, e, s, r + 1, CASE WHEN ({_mixed_sql("greatest(x, p)", "a")} >> {permute.STEPS[3]}) & 1 = 1 THEN p ELSE x END
FROM (SELECT walk.*, a, ((a * {permute.PRIME} + b) % n - x + n) % n AS p FROM walk JOIN rounds USING (e, s, r), own)),
done AS (SELECT doc_id AS record_idx, e AS epoch, s AS dp_index, e * n + x AS position FROM walk, own WHERE r = 3 * length(ltrim(bin(n), '0')))
"""


@query(_permuted_sql(1) + "SELECT * FROM done")
def permuted_epochs(spark, sf_dir):
    """Two epochs in the order of a keyed permutation, without an exchange."""
    docs, n = _records(spark, sf_dir)
    return permute.epochs(docs, n, num_epochs=2, seed=7).select("record_idx", "epoch", "dp_index", "position")


@query(_permuted_sql(4) + "SELECT *, position // 16 AS batch_id, position % 16 AS slot FROM done, own WHERE position >= 80 AND position < 2 * n // 16 * 16".replace("SELECT *", "SELECT record_idx, epoch, dp_index, position"))
def permuted_batches(spark, sf_dir):
    """All whole batches after the fifth of four shards, found by their places."""
    docs, n = _records(spark, sf_dir)
    found = permute.batches(docs, n, 16, 5, max(0, 2 * (n // 4) // 16 - 5), seed=7, dp_size=4)
    return found.select("record_idx", "epoch", "dp_index", "position", "batch_id", "slot")


@query(_permuted_sql(4) + "SELECT record_idx, epoch, dp_index, position, position // 16 AS batch_id, position % 16 AS slot FROM done, own WHERE position < 2 * n // 16 * 16")
def resumed_batch_stream(spark, sf_dir):
    """All batches by a stream that is stopped after the third and started again: what both runs have written."""
    _, n = _records(spark, sf_dir)
    out = shared_folder(spark, "streams")
    for until in (3, 1 << 40):
        stream = batch_stream(spark, records=n, batch_size=16, num_epochs=2, seed=7, dp_size=4, until=until)
        stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


@query(f"SELECT b AS num_batches, CASE WHEN b <= 0 THEN 1 ELSE greatest(1, (16 * b + {_N} // 4 - 1) // ({_N} // 4)) END AS epochs FROM range(0, 200, 20) r(b)")
def required_epochs(spark, sf_dir):
    _, n = _records(spark, sf_dir)
    rows = [(b, iterate.required_epochs(n, 16, b, 4)) for b in range(0, 200, 20)]
    return spark.createDataFrame(rows, "num_batches long, epochs long")


_IDS = """WITH t AS (SELECT conv_id, turn, list_concat([1, CASE role WHEN 'assistant' THEN 3 WHEN 'system' THEN 4 ELSE 2 END, 5], list_concat(list_transform(string_split(text, ' '), lambda w: CAST(length(w) + 10 AS INTEGER)), [6, 5])) AS ids FROM conversations),
u AS (SELECT conv_id, turn, unnest(ids) AS token, generate_subscripts(ids, 1) AS k FROM t),
tok AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS pos, token FROM u),
s AS (SELECT conv_id, pos, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS nth FROM tok WHERE token = 1),
e AS (SELECT conv_id, pos, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS nth FROM tok WHERE token = 6),
sp AS (SELECT s.conv_id, s.pos + 3 AS o, e.pos + 1 AS c FROM s JOIN e USING (conv_id, nth) JOIN tok a ON a.conv_id = s.conv_id AND a.pos = s.pos + 1 WHERE a.token = 3),
d AS (SELECT conv_id, o AS pos, 1 AS x FROM sp UNION ALL SELECT conv_id, c, -1 FROM sp),
dd AS (SELECT conv_id, pos, sum(x) AS x FROM d GROUP BY 1, 2),
mask AS (SELECT tok.conv_id, tok.pos, token, CAST(sum(coalesce(x, 0)) OVER (PARTITION BY tok.conv_id ORDER BY tok.pos) AS INTEGER) AS mask FROM tok LEFT JOIN dd ON dd.conv_id = tok.conv_id AND dd.pos = tok.pos)
"""


def _masked(spark, sf_dir):
    return encode.with_loss_mask(token_ids(spark, sf_dir), "ids", START, END, ASSISTANT, "mask")


@query(_IDS + "SELECT conv_id, count(*) AS n_tokens, md5(string_agg(mask, ',' ORDER BY pos)) AS mask FROM mask GROUP BY conv_id")
def loss_mask_tokens(spark, sf_dir):
    return _masked(spark, sf_dir).select("conv_id", F.size("ids").cast("long").alias("n_tokens"), F.md5(F.array_join("mask", ",")).alias("mask"))


@query(_IDS + "SELECT conv_id, pos, token, mask::BIGINT AS mask FROM mask")
def loss_mask_rows(spark, sf_dir):
    """The mask of every token as a row, by running sums over ranges."""
    return encode.loss_mask_rows(tokens(spark, sf_dir), "conv_id", "pos", "token", START, END, ASSISTANT, "mask")


@query(_IDS + "SELECT conv_id, CAST(sum(mask) FILTER (WHERE pos > 0) AS BIGINT) AS supervised FROM mask GROUP BY conv_id")
def supervised_tokens(spark, sf_dir):
    return _masked(spark, sf_dir).select("conv_id", encode.supervised_tokens(F.col("mask")).alias("supervised"))


@query(_IDS + ", p AS (SELECT conv_id, count(*) AS n, string_agg(token, ',' ORDER BY pos) AS ids FROM tok GROUP BY conv_id) SELECT conv_id, n, n <= 512 AS fits, md5(ids || repeat(',0', CAST(greatest(512 - n, 0) AS INTEGER))) AS token_ids, n AS attended FROM p")
def padded_examples(spark, sf_dir):
    """Padded to 512 tokens; conversations that are longer stay whole and do not fit."""
    ids = token_ids(spark, sf_dir).withColumn("fits", F.size("ids") <= 512)
    filled = F.when(F.col("fits"), encode.padded(F.col("ids"), 512, 0)).otherwise(F.col("ids"))
    attended = F.aggregate(encode.attention_mask(F.col("ids"), 512), F.lit(0).cast("long"), lambda a, x: a + x)
    return ids.select("conv_id", F.size("ids").cast("long").alias("n"), "fits", F.md5(F.array_join(filled, ",")).alias("token_ids"), attended.alias("attended"))


_SEG = _IDS + ", g AS (SELECT *, CAST(sum(CASE WHEN token = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS BIGINT) AS segment FROM tok)"


def _segments(spark, sf_dir):
    t = tokens(spark, sf_dir).withColumn("start", (F.col("token") == START).cast("int"))
    return scan(t, ["conv_id", "pos"], ["conv_id"], {"segment": ("sum", "start")})


@query(_SEG + " SELECT conv_id, pos, segment, min(pos) OVER (PARTITION BY conv_id, segment) AS kstart FROM g")
def segment_kstart(spark, sf_dir):
    return segments.segment_start(_segments(spark, sf_dir), "conv_id", "pos", "segment").select("conv_id", "pos", "segment", "kstart")


@query(_SEG + ", z AS (SELECT conv_id, min(pos) AS first FROM g WHERE segment = (SELECT max(segment) FROM g h WHERE h.conv_id = g.conv_id) GROUP BY conv_id) SELECT conv_id, pos, pos - first AS position FROM g JOIN z USING (conv_id)")
def segment_positions(spark, sf_dir):
    return segments.segment_positions(_segments(spark, sf_dir), "conv_id", "pos", "segment").select("conv_id", "pos", "position")


@query(_IDS + "SELECT conv_id, coalesce(min(pos) FILTER (WHERE token > 20), count(*)) AS left_pads, count(*) - 1 - coalesce(max(pos) FILTER (WHERE token <> 5), -1) AS right_pads FROM tok GROUP BY conv_id")
def pad_counts(spark, sf_dir):
    return segments.pads(tokens(spark, sf_dir), ["conv_id"], "pos", F.col("token") > 20, F.col("token") != 5)


@query(_IDS + "SELECT conv_id // 16 AS batch, max(right_pads) AS right_pads FROM (SELECT conv_id, count(*) - 1 - coalesce(max(pos) FILTER (WHERE token <> 5), -1) AS right_pads FROM tok GROUP BY conv_id) GROUP BY 1")
def batch_right_pads(spark, sf_dir):
    own = segments.pads(tokens(spark, sf_dir), ["conv_id"], "pos", F.col("token") > 20, F.col("token") != 5)
    return own.groupBy(F.floor(F.col("conv_id") / 16).alias("batch")).agg(F.max("right_pads").alias("right_pads"))


@query(_IDS + "SELECT conv_id, pos, token, lead(token) OVER (PARTITION BY conv_id ORDER BY pos) AS next_token FROM tok")
def next_token_targets(spark, sf_dir):
    t = segments.next_tokens(tokens(spark, sf_dir), "conv_id", "pos", "token")
    return t.withColumn("pos", F.col("pos").cast("long"))


@query(_IDS + "SELECT conv_id, pos, CAST(CASE WHEN token > 9 THEN sum(CASE WHEN token > 9 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) - 1 ELSE 0 END AS BIGINT) AS text_pos FROM tok")
def text_positions(spark, sf_dir):
    t = tokens(spark, sf_dir).withColumn("m", (F.col("token") > 9).cast("int"))
    return segments.text_positions(t, "conv_id", "pos", "m").select("conv_id", F.col("pos").cast("long").alias("pos"), "text_pos")


@query(_IDS + "SELECT conv_id, pos, token * 0.5 + coalesce(lag(token) OVER w, 0) * 0.25 + coalesce(lag(token, 2) OVER w, 0) * 0.125 AS conv FROM tok WINDOW w AS (PARTITION BY conv_id ORDER BY pos)".replace("0.5", "0.5::DOUBLE").replace("0.25", "0.25::DOUBLE").replace("0.125", "0.125::DOUBLE"))
def causal_conv(spark, sf_dir):
    t = tokens(spark, sf_dir).withColumn("x", F.col("token").cast("double"))
    return segments.causal_conv(t, "conv_id", "pos", "x", [0.125, 0.25, 0.5]).select("conv_id", F.col("pos").cast("long").alias("pos"), "conv")


@query(_IDS + "SELECT conv_id, pos, CAST(sum(token) OVER (PARTITION BY conv_id, pos // 64 ORDER BY pos) AS BIGINT) AS decay FROM tok")
def chunk_decay(spark, sf_dir):
    return segments.chunk_decay(tokens(spark, sf_dir), "conv_id", "pos", "token").select("conv_id", F.col("pos").cast("long").alias("pos"), "decay")


@query(_PACKED + "SELECT conv_id, turn, len AS length, chunk_id FROM f")
def stream_pack(spark, sf_dir):
    """Conversations as a stream, packed with state, to a table that is read back."""
    c = read(spark, sf_dir, "conversations")
    folder = shared_folder(spark, "streams")
    stream = spark.readStream.schema(c.schema).parquet(f"{sf_dir}/conversations.parquet*")
    rows = stream.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("message_idx"), chatml.char_length(F.col("role"), F.col("text")).alias("length"))
    packed = pack_stream(rows, MAX_LENGTH).select(F.col("session_id").alias("conv_id"), F.col("message_idx").alias("turn"), "length", "chunk_id")
    packed.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("conv_id long, turn long, length long, chunk_id long").parquet(f"{folder}/rows")
