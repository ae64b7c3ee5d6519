"""Queries of the training arithmetic: grids, schedules, FLOPs, metrics, name mapping and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatpack.functions import mapping, perf, vecmath, vision
from chatpack.plans.tables import read, shared_folder
from chatpack.streaming.metrics import metrics_sink, read_metrics

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def near(c):
    """Eight decimals, by the same arithmetic as in the SQL."""
    return F.floor(c * 1e8 + 0.5) / 1e8


def _near(e: str) -> str:
    return f"floor(({e}) * 1e8 + 0.5) / 1e8"


# Grids (row, ordinal, t, h, w) that stand for the images of some examples.
GRIDS = [(1, 0, 1, 4, 4), (1, 1, 2, 4, 8), (2, 0, 1, 8, 8), (3, 0, 2, 4, 4), (3, 1, 1, 2, 2), (3, 2, 3, 6, 4)]
_GRIDS = "(VALUES " + ", ".join(map(str, GRIDS)) + ") AS g(ex, ordinal, t, h, w)"


def grids(spark):
    return spark.createDataFrame(GRIDS, "ex int, ordinal int, t int, h int, w int")


def grid_arrays(spark):
    own = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "t", "h", "w"))), lambda g: F.struct(g["t"].alias("t"), g["h"].alias("h"), g["w"].alias("w")))
    return grids(spark).groupBy("ex").agg(own.alias("grids"))


@query(f"SELECT ex, CAST(sum(t * (h // 2) * (w // 2)) AS BIGINT) AS vision_tokens, CAST(sum(t * h * w) AS BIGINT) AS vision_patches, count(*) AS num_images FROM {_GRIDS} GROUP BY ex")
def vision_tokens(spark, sf_dir):
    from chatpack.functions.chatml import vision_measure

    return grid_arrays(spark).withColumn("m", vision_measure(F.lit(0), F.col("grids"))).select("ex", "m.vision_tokens", "m.vision_patches", "m.num_images")


@query(f"SELECT ex, count(*) FILTER (WHERE x = 'pad') AS pads, count(*) FILTER (WHERE x = 'start') AS starts FROM (SELECT ex, 'start' AS x FROM {_GRIDS} UNION ALL SELECT ex, 'pad' FROM {_GRIDS}, range(1000) r(i) WHERE i < t * (h // 2) * (w // 2)) GROUP BY ex")
def image_blocks(spark, sf_dir):
    """Messages of image blocks rendered with their grids."""
    from chatpack.functions import chatml

    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), F.lit(text).alias("text"))
    blocks = F.concat(F.array(block("text", "see")), F.transform("grids", lambda g: block("image", "")), F.array(block("audio", "x")))
    text = grid_arrays(spark).withColumn("blocks", blocks).withColumn("text", chatml.render_blocks(F.lit("user"), F.col("blocks"), F.col("grids")))
    count = lambda s: (F.size(F.split("text", s)) - 1).cast("long")
    return text.select("ex", count(r"<\|image_pad\|>").alias("pads"), count(r"<\|vision_start\|>").alias("starts"))


_CU = f"SELECT ex, row_number() OVER (PARTITION BY ex ORDER BY ordinal, f) AS frame, CAST(sum(h * w) OVER (PARTITION BY ex ORDER BY ordinal, f) AS BIGINT) AS until FROM {_GRIDS}, range(1, 10) r(f) WHERE f <= t UNION ALL SELECT DISTINCT ex, 0, 0 FROM {_GRIDS}"


@query(_CU)
def vision_cu_seqlens(spark, sf_dir):
    return vision.cu_seqlens_rows(grids(spark), "ex", "ordinal")


@query(f"SELECT ex, string_agg(until, ',' ORDER BY frame) AS cu FROM ({_CU}) GROUP BY ex")
def vision_cu_arrays(spark, sf_dir):
    return grid_arrays(spark).select("ex", F.array_join(vision.cu_seqlens(F.col("grids")), ",").alias("cu"))


@query(f"SELECT ex, until AS pos, frame AS segment, kstart FROM (SELECT ex, frame - 1 AS frame, lag(until) OVER (PARTITION BY ex ORDER BY frame) AS kstart, until AS top FROM ({_CU})) c, range(0, 400) r(until) WHERE until >= kstart AND until < top")
def cu_segments(spark, sf_dir):
    from chatpack.functions import segments

    rows = grid_arrays(spark).select("ex", vision.cu_seqlens(F.col("grids")).alias("cu"))
    return segments.from_cu_seqlens(rows, "ex", "cu").withColumn("segment", F.col("segment").cast("long"))


@query("SELECT * FROM (VALUES (16, 1, 'ok', '1x2x22,1x2x2'), (16, 3, 'patches left without an image to hold them', ''), (64, 3, 'ok', ''), (66, 3, 'over budget', ''), (62, 2, 'patches cannot be divided', ''), (60, 2, 'ok', '1x2x2')) v(patches, images, status, plan)")
def vision_pad_plan(spark, sf_dir):
    rows = spark.createDataFrame([(16, 1), (16, 3), (64, 3), (66, 3), (62, 2), (60, 2)], "patches int, images int")
    p = vision.pad_plan(F.col("patches"), F.col("images"), 64, 3, 2)
    plan = F.array_join(F.transform("p.grids", lambda g: F.concat_ws("x", g["t"], g["h"], g["w"])), ",")
    return rows.withColumn("p", p).select("patches", "images", "p.status", plan.alias("plan"))


@query(f"""SELECT ex, ordinal, k AS token, ((k % (h * w)) // 4) // (w // 2) * 2 + (k % 4) // 2 AS y, ((k % (h * w)) // 4) % (w // 2) * 2 + k % 2 AS x FROM {_GRIDS}, range(0, 400) r(k) WHERE k < t * h * w""")
def spatial_coords(spark, sf_dir):
    return vision.spatial_coords(grids(spark), "ex", "ordinal", 2)


# Runs of a token stream (row, ordinal, n, t, h, w): text runs have n, images have a grid.
RUNS = [(1, 0, 2, None, None, None), (1, 1, None, 1, 4, 4), (1, 2, 2, None, None, None), (2, 0, 1, None, None, None), (2, 1, None, 2, 4, 8), (2, 2, 3, None, None, None), (2, 3, None, 1, 2, 6), (2, 4, 1, None, None, None)]
_RUNS = "(VALUES " + ", ".join(map(str, RUNS)).replace("None", "NULL::INT") + ") AS g(ex, ordinal, n, t, h, w)"
_ROPE = f"""WITH r AS (SELECT *, coalesce(t * (h // 2) * (w // 2), n) AS size, coalesce(greatest(t, h // 2, w // 2), n) AS step FROM {_RUNS}),
s AS (SELECT *, sum(size) OVER w1 - size AS off, sum(step) OVER w1 - step AS start FROM r WINDOW w1 AS (PARTITION BY ex ORDER BY ordinal)),
p AS (SELECT ex, CAST(off + k AS BIGINT) AS token, CAST(start + CASE WHEN t IS NULL THEN k ELSE k // ((h // 2) * (w // 2)) END AS BIGINT) AS pt,
CAST(start + CASE WHEN t IS NULL THEN k ELSE (k // (w // 2)) % (h // 2) END AS BIGINT) AS ph, CAST(start + CASE WHEN t IS NULL THEN k ELSE k % (w // 2) END AS BIGINT) AS pw FROM s, range(0, 100) x(k) WHERE k < size) """


def _runs(spark):
    return spark.createDataFrame(RUNS, "ex int, ordinal int, n int, t int, h int, w int")


@query(_ROPE + "SELECT * FROM p")
def mrope_positions(spark, sf_dir):
    return vision.rope_positions(_runs(spark), "ex", "ordinal", 2)


@query(_ROPE + "SELECT ex, max(greatest(pt, ph, pw)) + 1 - count(*) AS delta FROM p GROUP BY ex")
def mrope_delta(spark, sf_dir):
    return vision.rope_delta(vision.rope_positions(_runs(spark), "ex", "ordinal", 2), "ex")


@query(_ROPE + "SELECT * FROM p")
def mrope_from_tokens(spark, sf_dir):
    """The same positions from a token stream, in which each image is a stretch of one token."""
    size = F.coalesce(F.col("t") * F.floor(F.col("h") / 2) * F.floor(F.col("w") / 2), F.col("n"))
    each = _runs(spark).select("ex", "ordinal", F.col("t").isNotNull().alias("image"), F.explode(F.sequence(F.lit(1).cast("long"), size.cast("long"))).alias("k"))
    stream = each.select("ex", (F.col("ordinal") * 1000 + F.col("k")).alias("pos"), F.when(F.col("image"), 7).otherwise(1).alias("token"))
    images = _runs(spark).where("t is not null").select("ex", F.when((F.col("ex") == 2) & (F.col("ordinal") == 3), 1).otherwise(0).alias("ordinal"), "t", "h", "w")
    return vision.rope_positions(vision.token_runs(stream, images, "ex", "pos", "token", 7), "ex", "ordinal", 2)


@query(f"SELECT ex, row_number() OVER (PARTITION BY ex ORDER BY ordinal, f) - 1 AS frame, h, w FROM {_GRIDS}, range(1, 10) r(f) WHERE f <= t")
def video_frames(spark, sf_dir):
    return vision.split_frames(grids(spark), "ex", "ordinal").select("ex", F.col("ordinal").cast("long").alias("frame"), "h", "w")


@query(f"SELECT i, floor(i * 15 / 6.0)::BIGINT AS low, least(floor(i * 15 / 6.0) + 1, 15)::BIGINT AS high, {_near('i * 15 / 6.0::DOUBLE - floor(i * 15 / 6.0)')} AS weight FROM range(7) r(i)")
def bilinear_neighbours(spark, sf_dir):
    b = vision.bilinear(F.lit(7), F.col("id"), 16)
    return spark.range(7).select(F.col("id").alias("i"), b["low"].alias("low"), b["high"].cast("long").alias("high"), near(b["weight"]).alias("weight"))


def _rates(spark, kind, steps=100, warmup=10, end=0.1):
    return spark.range(steps + 1).select(F.col("id").alias("step"), near(perf.learning_rate(F.col("id"), kind, 2.0, steps, warmup, end)).alias("lr"))


@query(f"SELECT i AS step, {_near('CASE WHEN i < 10 THEN 2.0::DOUBLE * i / 10 ELSE 2.0 END')} AS lr FROM range(101) r(i)")
def lr_linear(spark, sf_dir):
    return _rates(spark, "linear")


@query(f"SELECT i AS step, {_near('CASE WHEN i < 10 THEN 2.0::DOUBLE * i / 10 ELSE 2.0 * (0.9 * 0.5 * (1 + cos(pi() * least(i - 10, 90) / 90)) + 0.1) END')} AS lr FROM range(101) r(i)")
def lr_cosine(spark, sf_dir):
    return _rates(spark, "cosine")


@query(f"SELECT i AS step, {_near('CASE WHEN i < 10 THEN 2.0::DOUBLE * i / 10 WHEN i < 82 THEN 2.0 ELSE 2.0::DOUBLE - 1.8::DOUBLE * least(i - 82, 18) / 18 END')} AS lr FROM range(101) r(i)")
def lr_wsd(spark, sf_dir):
    return _rates(spark, "wsd")


# Small decoder configs: name, d, heads, kv_heads, head_dim, mlp, vocab, layers, seq_len, experts, top_k, moe_mlp, sparse_step.
CONFIGS = [("dense", 64, 4, 2, 16, 128, 1000, 3, 8, 0, 0, 0, 1), ("experts", 64, 4, 2, 16, 128, 1000, 4, 8, 8, 2, 32, 2), ("long", 128, 8, 4, 16, 256, 5000, 6, 4096, 0, 0, 0, 1)]
_CONFIG_COLS = "name, d, heads, kv_heads, head_dim, mlp, vocab, layers, seq_len, experts, top_k, moe_mlp, sparse_step"
_CONFIGS = "(VALUES " + ", ".join(map(str, CONFIGS)) + f") AS c({_CONFIG_COLS})"
_DECODER = "3 * CAST(sum(2 * d * (heads + 2 * kv_heads) * head_dim + 2 * seq_len * heads * head_dim + 2 * heads * head_dim * d + CASE WHEN experts > 0 AND (l + 1) % sparse_step = 0 THEN 2 * d * experts + top_k * 6 * d * moe_mlp ELSE 6 * d * mlp END) + any_value(2 * d * vocab) AS BIGINT)"


def _configs(spark):
    schema = ", ".join(f"{c} {'string' if c == 'name' else 'long'}" for c in _CONFIG_COLS.split(", "))
    return spark.createDataFrame(CONFIGS, schema).withColumn("mlp_only", F.array().cast("array<int>"))


@query(f"SELECT name, {_DECODER} AS flops_per_token FROM {_CONFIGS}, range(10) r(l) WHERE l < layers GROUP BY name")
def flops_decoder(spark, sf_dir):
    return perf.decoder_flops(_configs(spark))


@query(f"""SELECT name, 3 * CAST(sum(CASE WHEN (l + 1) % 4 = 0 THEN 4 * d * heads * head_dim + 4 * d * kv_heads * head_dim + 2 * seq_len * heads * head_dim + 2 * heads * head_dim * d
ELSE 2 * d * (2 * 64 + 128) + 2 * d * 128 + 4 * d * 8 + 2 * 128 * d + 2 * 8 * 16 * 16 END + CASE WHEN experts > 0 THEN 2 * d * experts + top_k * 6 * moe_mlp * d + 6 * d * 48 + 2 * d ELSE 6 * d * mlp END) + any_value(2 * d * vocab) AS BIGINT) AS flops_per_token
FROM {_CONFIGS}, range(10) r(l) WHERE l < layers GROUP BY name""")
def flops_hybrid(spark, sf_dir):
    extra = {"key_heads": 4, "key_dim": 16, "value_heads": 8, "value_dim": 16, "shared_mlp": 48, "attention_every": 4}
    return perf.hybrid_flops(_configs(spark).withColumns({k: F.lit(v).cast("long") for k, v in extra.items()}))


VISION = {"d": 32, "mlp": 64, "depth": 2, "inputs": 24, "merge": 2, "out": 48, "mergers": 2}


@query(f"SELECT ex, CAST(3 * 2 * (n * 24 * 32 + 2 * (n * 32 * 128 + nn * 64 + n * 2 * 32 * 64) + m * 128 * (128 + 48) * 2) AS BIGINT) AS vision_flops FROM (SELECT ex, sum(t * h * w) AS n, sum((t * h * w) * (t * h * w)) AS nn, sum(t * (h // 2) * (w // 2)) AS m FROM {_GRIDS} GROUP BY ex)")
def flops_vision(spark, sf_dir):
    return perf.vision_flops(grids(spark), VISION, ("ex",))


@query(f"SELECT event_id, step_time, {_near('CASE WHEN step_time > 0 THEN 64 / step_time ELSE 0 END')} AS tokens_per_s, {_near('CASE WHEN step_time > 0 THEN 1e12 / 1e12 / step_time / 312 ELSE 0 END')} AS mfu FROM (SELECT event_id, CASE WHEN row_number() OVER w <= 2 THEN 0.0::DOUBLE ELSE (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6::DOUBLE END AS step_time FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def step_metrics(spark, sf_dir):
    """Times between a user's events as step times, with the metrics of a fixed step."""
    timed = perf.step_times(read(spark, sf_dir, "events"), "ts", 2, ("user_id",), ("event_id",))
    m = perf.step_metrics(F.lit(1e12), F.col("step_time"), F.lit(64), F.lit(312.0))
    return timed.select("event_id", "step_time", near(m["tokens_per_s"]).alias("tokens_per_s"), near(m["mfu"]).alias("mfu"))


@query("SELECT user_id AS step, avg(value) AS loss, avg(abs(value)) AS grad_norm, count(*) AS supervised_tokens, user_id % 10 = 0 AS due FROM events GROUP BY 1".replace("avg(value)", _near("avg(value)")).replace("avg(abs(value))", _near("avg(abs(value))")))
def micro_batch_metrics(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("step"), F.col("value").alias("loss"), F.abs("value").alias("grad_norm"), F.lit(1).alias("supervised_tokens"), F.lit(1.0).alias("flops"), F.lit(1.0).alias("seconds"))
    m = perf.micro_batches(rows, "step")
    return m.select("step", near(F.col("loss")).alias("loss"), near(F.col("grad_norm")).alias("grad_norm"), "supervised_tokens", perf.due(F.col("step"), 10).alias("due"))


@query(f"SELECT user_id AS step, count(*) AS rows, {_near('avg(value)')} AS loss FROM events WHERE user_id % 5 = 0 GROUP BY 1")
def metrics_stream(spark, sf_dir):
    """Metrics of the events as a stream that is given twice, logged every fifth step."""
    out, events = shared_folder(spark, "streams"), read(spark, sf_dir, "events")
    for attempt in range(2):
        stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
        metrics_sink(stream, f"{out}/metrics", f"{out}/state{attempt}", "user_id", ("value",)).awaitTermination()
    found = read_metrics(spark, f"{out}/metrics", ("value",), every=5)
    return found.select("step", "rows", near(F.col("value")).alias("loss"))


@query("SELECT user_id AS step FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 2")
def retained_checkpoints(spark, sf_dir):
    return perf.retained(read(spark, sf_dir, "events").select(F.col("user_id").alias("step")).distinct(), "step")


RULES = [(0, r"model\.layers\.([0-9]+)\.self_attn\.([qkv])_proj\.weight", "layers.$1.attn.$2.kernel"), (1, r"model\.layers\.([0-9]+)\.mlp\.(\w+)\.weight", "layers.$1.mlp.$2.kernel"), (2, r"model\.embed\.weight", "embed"), (3, r"model\..*", "other")]
_KEYS = """(SELECT 'model.layers.' || (i // 6) || CASE i % 6 WHEN 0 THEN '.self_attn.q_proj.weight' WHEN 1 THEN '.self_attn.k_proj.weight' WHEN 2 THEN '.mlp.up.weight' WHEN 3 THEN '.mlp.down.weight' WHEN 4 THEN '.norm' ELSE '.mlp.gate.weight' END AS key FROM range(60) r(i) UNION ALL SELECT 'model.embed.weight' UNION ALL SELECT 'lm_head.weight') k"""


def _keys(spark):
    i = F.col("id")
    tail = F.element_at(F.array(*[F.lit(x) for x in (".self_attn.q_proj.weight", ".self_attn.k_proj.weight", ".mlp.up.weight", ".mlp.down.weight", ".norm", ".mlp.gate.weight")]), (F.pmod(i, F.lit(6)) + 1).cast("int"))
    keys = spark.range(60).select(F.concat(F.lit("model.layers."), F.floor(i / 6).cast("string"), tail).alias("key"))
    return keys.union(spark.createDataFrame([("model.embed.weight",), ("lm_head.weight",)], "key string"))


def _rules(spark):
    return spark.createDataFrame(RULES, "priority int, pattern string, target string")


@query(f"SELECT key, CASE WHEN regexp_matches(key, '^model\\.layers\\.[0-9]+\\.self_attn\\.[qkv]_proj\\.weight') THEN regexp_replace(key, '^model\\.layers\\.([0-9]+)\\.self_attn\\.([qkv])_proj\\.weight', 'layers.\\1.attn.\\2.kernel') WHEN regexp_matches(key, '^model\\.layers\\.[0-9]+\\.mlp') THEN regexp_replace(key, '^model\\.layers\\.([0-9]+)\\.mlp\\.(\\w+)\\.weight', 'layers.\\1.mlp.\\2.kernel') WHEN key = 'model.embed.weight' THEN 'embed' WHEN key LIKE 'model.%' THEN 'other' END AS target FROM {_KEYS}")
def weight_key_map(spark, sf_dir):
    return mapping.map_keys(_keys(spark), _rules(spark)).select("key", "target")


@query(f"SELECT key FROM {_KEYS} WHERE key NOT LIKE 'model.%'")
def weight_unmatched(spark, sf_dir):
    return mapping.unmapped(_keys(spark), _rules(spark))


@query("SELECT i % 4 AS layer, 'gate' AS proj, count(DISTINCT i % 7) AS n FROM range(26) r(i) GROUP BY 1 HAVING count(DISTINCT i % 7) <> 7")
def expert_fill(spark, sf_dir):
    parts = spark.range(26).select(F.pmod("id", F.lit(4)).alias("layer"), F.lit("gate").alias("proj"), F.pmod("id", F.lit(7)).alias("expert"))
    return mapping.expert_gaps(parts, 7)


@query("SELECT i AS layer, 'gate' AS proj, string_agg(e * 10 + i, ',' ORDER BY e) AS stacked FROM range(3) r(i), range(5) s(e) GROUP BY 1")
def expert_stack(spark, sf_dir):
    e, layer = F.pmod("id", F.lit(5)), F.floor(F.col("id") / 5)
    parts = spark.range(15).select(layer.alias("layer"), F.lit("gate").alias("proj"), e.alias("expert"), (e * 10 + layer).alias("v"))
    return mapping.stacked_experts(parts, "v").select("layer", "proj", F.array_join("values", ",").alias("stacked"))


@query("SELECT i AS id, (i + 3) || ',' || (i + 1) || ',' || (i + 2) AS shape, '1,2,0' AS inverse FROM range(5) r(i)")
def shape_transform(spark, sf_dir):
    i = F.col("id").cast("int")
    order = F.array(F.lit(2), F.lit(0), F.lit(1))
    return spark.range(5).select("id", F.array_join(mapping.permuted(F.array(i + 1, i + 2, i + 3), order), ",").alias("shape"), F.array_join(mapping.inverse_order(order), ",").alias("inverse"))


@query("SELECT * FROM (VALUES ('b'), ('d')) v(key)")
def shape_mismatch(spark, sf_dir):
    left = spark.createDataFrame([("a", [1, 2]), ("b", [2, 3]), ("d", [1])], "key string, shape array<int>")
    right = spark.createDataFrame([("a", [1, 2]), ("b", [3, 2])], "key string, shape array<int>")
    return mapping.shape_mismatches(left, right).select("key")


@query("SELECT * FROM (VALUES ('bf16', 'bfloat16'), ('torch.bfloat16', 'bfloat16'), ('float16', 'float16'), ('torch.float32', 'float32')) v(name, dtype)")
def dtype_names(spark, sf_dir):
    return spark.createDataFrame([("bf16",), ("torch.bfloat16",), ("float16",), ("torch.float32",)], "name string").withColumn("dtype", mapping.dtype_of(F.col("name")))


_UNNEST = "(SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").where("embedding is not null")


@query(f"SELECT vec_id, {_near('sum(abs(y))')} AS l1 FROM (SELECT vec_id, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id) / count(*) OVER (PARTITION BY vec_id) + 1e-6) AS y FROM {_UNNEST}) GROUP BY vec_id")
def rms_norm(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", near(vecmath._sum(F.transform(vecmath.rms_norm(F.col("embedding")), F.abs))).alias("l1"))


@query(f"SELECT vec_id, {_near('sum(abs(y))')} AS l1 FROM (SELECT vec_id, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id) + 1e-6) AS y FROM {_UNNEST}) GROUP BY vec_id")
def l2_norm(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", near(vecmath._sum(F.transform(vecmath.l2_norm(F.col("embedding")), F.abs))).alias("l1"))


@query(f"SELECT {_near('sqrt(sum(x * x))')} AS norm FROM {_UNNEST}")
def global_norm(spark, sf_dir):
    return vecmath.global_norm(_vectors(spark, sf_dir), "embedding").select(near(F.col("norm")).alias("norm"))


@query(f"SELECT vec_id, {_near('max(p)')} AS top, {_near('sum(p)')} AS total FROM (SELECT vec_id, exp(x - max(x) OVER w) / sum(exp(x)) OVER w * exp(max(x) OVER w) AS p FROM {_UNNEST} WINDOW w AS (PARTITION BY vec_id)) GROUP BY vec_id")
def softmax(spark, sf_dir):
    p = _vectors(spark, sf_dir).select("vec_id", vecmath.softmax(F.col("embedding")).alias("p"))
    return p.select("vec_id", near(F.array_max("p")).alias("top"), near(vecmath._sum(F.col("p"))).alias("total"))


_PROBS = f"SELECT vec_id, i, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p, x FROM {_UNNEST}"
_TOP = f"SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS rank FROM ({_PROBS})"


def _logits(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.col("embedding").alias("logits"))


@query(f"SELECT vec_id, i AS expert, rank, {_near('p / sum(p) OVER (PARTITION BY vec_id)')} AS weight FROM ({_TOP}) WHERE rank <= 2")
def router_topk(spark, sf_dir):
    r = vecmath.router(_logits(spark, sf_dir), "vec_id", "logits", 2)
    return r.select("vec_id", F.col("expert").cast("long").alias("expert"), F.col("rank").cast("long").alias("rank"), near(F.col("weight")).alias("weight"))


@query(f"SELECT {_near('64 * sum(c / n * p)')} AS aux_loss FROM (SELECT i, count(*) AS c FROM ({_TOP}) WHERE rank <= 2 GROUP BY i) JOIN (SELECT i, avg(p) AS p FROM ({_PROBS}) GROUP BY i) USING (i), (SELECT count(*) AS n FROM embeddings)")
def router_aux(spark, sf_dir):
    return vecmath.balance_loss(_logits(spark, sf_dir), "vec_id", "logits", 2, 64).select(near(F.col("aux_loss")).alias("aux_loss"))


@query(f"SELECT {_near('sum((p - 0.015625) * (p - 0.015625))')} AS aux_loss FROM (SELECT i, avg(p) AS p FROM ({_PROBS}) GROUP BY i)")
def router_variance(spark, sf_dir):
    return vecmath.balance_loss(_logits(spark, sf_dir), "vec_id", "logits", 2, 64, kind="variance").select(near(F.col("aux_loss")).alias("aux_loss"))


@query(f"SELECT {_near('sum(-ln(p)) / greatest(count(*), 1)')} AS loss, count(*) AS tokens FROM ({_PROBS}) JOIN embeddings e USING (vec_id) WHERE i = e.label AND e.label <> 0")
def masked_xent(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select(F.col("embedding").alias("logits"), F.col("label").alias("target"), (F.col("label") != 0).cast("int").alias("m"))
    return vecmath.cross_entropy(rows, "logits", "target", "m").select(near(F.col("loss")).alias("loss"), "tokens")


@query(f"SELECT p AS pos, i AS k, {_near('p / pow(10000.0, 2 * i / 16.0)')} AS angle FROM range(20) a(p), range(8) b(i)")
def rope_angles(spark, sf_dir):
    return spark.range(20).select(F.col("id").alias("pos"), F.posexplode(vecmath.rope_angles(F.col("id"), 16)).alias("k", "angle")).select("pos", F.col("k").cast("long").alias("k"), near(F.col("angle")).alias("angle"))


@query("SELECT e.vec_id, e.label AS token_id, v.n FROM embeddings e JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) v ON v.label = e.label")
def token_gather(spark, sf_dir):
    e = _vectors(spark, sf_dir).select("vec_id", F.col("label").alias("token_id"))
    return vecmath.gather(e, e.groupBy("token_id").agg(F.count("*").alias("n"))).select("vec_id", "token_id", "n")


@query("SELECT i % 3 AS ex, i // 3 AS pos, CASE WHEN (i // 3) % 4 = 1 AND (i // 3) // 4 < 3 THEN 'f' || ((i // 3) // 4) ELSE 't' || i END AS embedding FROM range(60) r(i)")
def feature_scatter(spark, sf_dir):
    i = F.col("id")
    pos = F.floor(i / 3)
    t = spark.range(60).select(F.pmod(i, F.lit(3)).alias("ex"), pos.alias("pos"), F.when(F.pmod(pos, F.lit(4)) == 1, 9).otherwise(0).alias("token_id"), F.concat(F.lit("t"), i.cast("string")).alias("embedding"))
    f = spark.range(9).select(F.floor(i / 3).alias("ex"), F.pmod(i, F.lit(3)).alias("ordinal"), F.concat(F.lit("f"), F.pmod(i, F.lit(3)).cast("string")).alias("feature"))
    return vecmath.scatter(t, f, "ex", "pos", 9).select("ex", "pos", "embedding")


@query(f"""WITH v AS (SELECT vec_id, i, x, label, label / pow(10000.0, 2 * (i % 16) / 32.0) AS a FROM {_UNNEST} JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id)),
r AS (SELECT v.vec_id, v.i, CASE WHEN v.i < 16 THEN v.x * cos(v.a) - o.x * sin(v.a) WHEN v.i < 32 THEN v.x * cos(v.a) + o.x * sin(v.a) ELSE v.x END AS y
FROM v LEFT JOIN v o ON o.vec_id = v.vec_id AND o.i = CASE WHEN v.i < 16 THEN v.i + 16 ELSE v.i - 16 END)
SELECT vec_id, {_near("sum(y * (i + 1) / 64)")} AS turned FROM r GROUP BY vec_id""")
def rope_rotation(spark, sf_dir):
    """Half of each vector turned by the angles of its label's position."""
    y = vecmath.rotated(F.col("embedding"), vecmath.rope_angles(F.col("label"), 32))
    return _vectors(spark, sf_dir).select("vec_id", near(vecmath._sum(F.transform(y, lambda v, i: v * (i + 1) / 64))).alias("turned"))


@query(f"SELECT p AS pos, k, {_near('CASE WHEN k % 3 = 1 AND k < 15 THEN p + 1 WHEN k % 3 = 2 AND k < 12 THEN p + 2 ELSE p END / pow(10000.0, 2 * k / 32.0)')} AS angle FROM range(20) a(p), range(16) b(k)")
def mrope_angles(spark, sf_dir):
    p = F.col("id")
    each = spark.range(20).select(p.alias("pos"), F.posexplode(vecmath.mrope_angles(p, p + 1, p + 2, 32, (7, 5, 4))).alias("k", "angle"))
    return each.select("pos", F.col("k").cast("long").alias("k"), near(F.col("angle")).alias("angle"))


@query("SELECT i AS id, (3 * i) || ',8' AS shape FROM range(1, 6) r(i)")
def shape_reshape(spark, sf_dir):
    target = F.array(F.lit(-1), F.lit(8))
    return spark.range(1, 6).select("id", F.array_join(mapping.reshaped(F.array(F.col("id"), F.lit(4), F.lit(6)), target), ",").alias("shape"))


@query("SELECT * FROM (VALUES (1, 'layers.0.kernel', '2'), (1, 'layers.1.kernel', '3'), (1, 'name', '\"a\"'), (2, 'norm.scale.value', '0.5')) v(id, path, value)")
def nested_paths(spark, sf_dir):
    docs = [(1, '{"name": "a", "layers": [{"kernel": 2}, {"kernel": 3}], "none": {}}'), (2, '{"norm": {"scale": {"value": 0.5}}}')]
    return mapping.flattened(spark.createDataFrame(docs, "id int, text string").withColumn("doc", F.parse_json("text")), "id", "doc")


@query(f"SELECT user_id AS step, {_near('avg(value)')} AS loss, count(*) AS tokens FROM events GROUP BY 1")
def validation_means(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("step"), F.col("value").alias("loss"), F.lit(1).alias("tokens"))
    return perf.validation_means(rows, "step").select("step", near(F.col("loss")).alias("loss"), "tokens")
