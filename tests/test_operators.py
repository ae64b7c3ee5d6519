import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chatpack.functions import chatml, mapping, perf, plugins, segments, vision
from chatpack.operators import encode, iterate, measures, packing, stats


def chunks_of(lengths, most):
    out, chunk, total, count = [], 0, 0, 0
    for n in lengths:
        if count and total + n > most:
            chunk, total, count = chunk + 1, 0, 0
        total, count = total + n, count + 1
        out.append(chunk)
    return out


def test_packing_matches_a_plain_loop(spark):
    rng = random.Random(5)
    sessions = {s: [rng.randint(0, 9) for _ in range(rng.randint(1, 200))] for s in range(40)}
    rows = [(s, i, n) for s, x in sessions.items() for i, n in enumerate(x)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "session_id long, message_idx long, length long")
    got = {(r.session_id, r.message_idx): r.chunk_id for r in packing.assign_chunks(df, 9).collect()}
    assert got == {(s, i): c for s, x in sessions.items() for i, c in enumerate(chunks_of(x, 9))}


@pytest.mark.parametrize("parts", [1, 9, 60])
def test_a_session_packed_by_many_tasks(spark, parts):
    """Ranges cut sessions, one of them into nearly all; chunks are those of a plain loop."""
    rng = random.Random(parts)
    sessions = {s: [rng.choice([0, 0, 1, 3, 9, 30]) for _ in range(rng.randint(1, 12) if s != 3 else 700)] for s in range(8)}
    sessions |= {8: [0] * 60 + [9] + [0] * 60, 9: [40] * 20 + [1] * 90, 10: [1]}
    rows = [(f"s{s:02}", i, n, i * 2) for s, x in sessions.items() for i, n in enumerate(x)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "session_id string, message_idx long, length long, more int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        for most in (1, 10, 64):
            got = packing.assign_chunks(df, most, oversize="own", session_rows=5).collect()
            expected = {(f"s{s:02}", i): c for s, x in sessions.items() for i, c in enumerate(chunks_of(x, most))}
            assert {(r.session_id, r.message_idx): r.chunk_id for r in got} == expected and len(got) == len(rows)
            assert all(r.more == 2 * r.message_idx for r in got)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_packing_rules(spark):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate([3, 3, 4, 1, 6])] + [(2, 0, 1)], "session_id long, message_idx long, length long")
    got = packing.describe_chunks(packing.assign_chunks(df, 6)).orderBy("session_id", "chunk_id").collect()
    assert [(r.session_id, r.num_messages, r.measured_length) for r in got] == [(1, 2, 6), (1, 2, 5), (1, 1, 6), (2, 1, 1)]
    with pytest.raises(Exception, match="more than 5"):
        packing.assign_chunks(df, 5).collect()
    with pytest.raises(ValueError):
        packing.assign_chunks(df, 0)


def mask_of(ids, start, end, assistant):
    s, e = [i for i, x in enumerate(ids) if x == start], [i for i, x in enumerate(ids) if x == end]
    delta = [0] * (len(ids) + 5)
    for a, b in zip(s, e):
        if a + 1 < len(ids) and ids[a + 1] == assistant:
            delta[min(a + 3, len(ids))] += 1
            delta[min(b + 1, len(ids))] -= 1
    out, run = [], 0
    for i in range(len(ids)):
        run += delta[i]
        out.append(run)
    return out


def test_loss_mask(spark):
    rng = random.Random(2)
    cases = [[1, 2, 5, 8, 6, 5, 1, 3, 5, 9, 6, 5], [1, 3, 6, 5], [1, 3, 5, 9], [], [1]] + [[rng.choice([1, 3, 5, 6, 9, 2]) for _ in range(rng.randint(0, 30))] for _ in range(150)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, ids array<int>")
    for r in encode.with_loss_mask(df, "ids", 1, 6, 3).collect():
        assert r.loss_mask == mask_of(r.ids, 1, 6, 3), r.ids
    assert mask_of(cases[0], 1, 6, 3) == [0] * 9 + [1, 1, 0]
    rows = encode.loss_mask_rows(df.select("i", F.posexplode("ids").alias("pos", "token")), "i", "pos", "token", 1, 6, 3).collect()
    assert {(r.i, r.pos): r.loss_mask for r in rows} == {(i, k): m for i, c in enumerate(cases) for k, m in enumerate(mask_of(c, 1, 6, 3))}


def test_padding(spark):
    df = spark.createDataFrame([([5, 6],)], "ids array<int>")
    r = df.select(encode.padded(F.col("ids"), 4, 0).alias("p"), encode.attention_mask(F.col("ids"), 4).alias("a")).first()
    assert (r.p, r.a) == ([5, 6, 0, 0], [1, 1, 0, 0])
    with pytest.raises(Exception, match="exceeds max_length"):
        df.select(encode.padded(F.col("ids"), 1, 0)).collect()


def test_distribution(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4)], "v long")
    r = stats.distributions(df, ["v"]).first()
    assert (r["sum"], r["min"], r["max"], r["mean"], r["median"], r["std"], r["p95"], r["p99"]) == (10, 1, 4, 2.5, 2.5, 1.12, 3.85, 3.97)
    assert list(stats.distributions(df.where("v > 9"), ["v"]).first())[1:] == [0] * 8


def test_distributions_over_ranges_of_values(spark):
    """Percentiles from running sums are those of the aggregate, by group, with null groups and values."""
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randint(-50, 50), 2**40]), rng.randint(0, 3)) for _ in range(700)] + [("c", 5, 5), ("d", None, 1)]
    df = spark.createDataFrame(rows, "g string, v long, w int").repartition(6)
    for by in ((), ("g",)):
        plain = sorted(map(str, stats.distributions(df, ["v", "w"], by).collect()))
        assert plain == sorted(map(str, stats.distributions(df, ["v", "w"], by, values_at_once=0).collect())) and len(plain) == (10 if by else 2)
    expected = df.where("g = 'a'").agg(F.percentile("v", F.lit(0.95)), F.stddev_pop("v"), F.avg("v")).first()
    got = stats.distributions(df, ["v"], ("g",), values_at_once=0).where("g = 'a'").first()
    assert (got.p95, got["mean"]) == pytest.approx((expected[0], expected[2]), abs=0.01) and got["std"] == pytest.approx(expected[1], rel=1e-9)
    assert list(stats.distributions(df.where("w > 9"), ["v"], (), 0).first())[1:] == [0] * 8


def test_epochs(spark):
    df = spark.range(8).withColumnRenamed("id", "record_idx")
    order = lambda seed: {d: [r.record_idx for r in iterate.epochs(df, 8, 1, seed, dp_size=2).where(F.col("dp_index") == d).orderBy("position").collect()] for d in (0, 1)}
    a = order(0)
    assert a == order(0) and a != order(1) and sorted(a[0] + a[1]) == list(range(8)) and a[0] + a[1] != list(range(8))
    plain = iterate.epochs(spark.range(4).withColumnRenamed("id", "record_idx"), 4, shuffle=False)
    assert [r.record_idx for r in iterate.batches(plain, 4, 2, start_batch=1).orderBy("position").collect()] == [2, 3]
    assert iterate.required_epochs(4, 2, 3) == 2 and iterate.required_epochs(4, 2, 0) == 1
    with pytest.raises(ValueError):
        iterate.required_epochs(4, 2, 3, 8)
    assert iterate.local_batch(8, 4) == 2
    with pytest.raises(ValueError):
        iterate.local_batch(8, 3)
    with pytest.raises(ValueError):
        iterate.batches(plain, 4, 0)


def test_collate(spark):
    stream = iterate.batches(iterate.epochs(spark.range(6).withColumnRenamed("id", "record_idx"), 6, shuffle=False), 6, 4)
    got = iterate.collate(stream, lambda pdf: pd.DataFrame({"n": [len(pdf)], "first": [pdf.record_idx.iloc[0]]}), "n long, first long").collect()
    assert [tuple(r) for r in got] == [(4, 0)]


def test_chatml(spark):
    r = spark.createDataFrame([("user", "Hello"), ("assistant", "Hi!")], "role string, text string").select(chatml.render(F.col("role"), F.col("text")).alias("t")).collect()
    assert "".join(x.t for x in r) == "<|im_start|>user\nHello<|im_end|>\n<|im_start|>assistant\nHi!<|im_end|>\n"


def test_segments(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate([0, 0, 1, 1, 1, 2, 2])] + [(2, i, s) for i, s in enumerate([1, 1, 2, 2])], "row int, pos int, seg int")
    k = segments.segment_start(rows, "row", "pos", "seg").where("row = 1").orderBy("pos").collect()
    assert [r.kstart for r in k] == [0, 0, 2, 2, 2, 5, 5]
    p = segments.segment_positions(rows, "row", "pos", "seg").where("row = 2").orderBy("pos").collect()
    assert [r.position for r in p] == [-2, -1, 0, 1]


def test_rope(spark):
    runs = spark.createDataFrame([(1, 0, 2, None, None, None), (1, 1, None, 1, 4, 4), (1, 2, 2, None, None, None)], "ex int, k int, n int, t int, h int, w int")
    got = vision.rope_positions(runs, "ex", "k", 2).orderBy("token").collect()
    assert [r.pt for r in got] == [0, 1, 2, 2, 2, 2, 4, 5]
    assert [r.ph for r in got] == [0, 1, 2, 2, 3, 3, 4, 5]
    assert [r.pw for r in got] == [0, 1, 2, 3, 2, 3, 4, 5]
    assert vision.rope_delta(vision.rope_positions(runs, "ex", "k", 2), "ex").first().delta == -2


def test_metrics(spark):
    one = spark.range(1)
    m = perf.step_metrics(F.lit(1e12), F.lit(1.0), F.lit(64), F.lit(312.0))
    r = one.select(*[c.alias(k) for k, c in m.items()]).first()
    assert (r.tokens_per_s, r.tflops_per_device, r.mfu) == (64.0, 1.0, 1 / 312)
    none = one.select(*[c.alias(k) for k, c in perf.step_metrics(F.lit(1e12), F.lit(0.0), F.lit(64), F.lit(312.0)).items()]).first()
    assert list(none) == [0.0] * 5
    assert one.select(perf.peak_tflops(F.lit("12.5")).alias("x"), perf.peak_tflops(F.lit("h100_sxm")).alias("y")).first() == (12.5, 989.0)
    with pytest.raises(Exception, match="unknown peak_tflops"):
        one.select(perf.peak_tflops(F.lit("abacus"))).collect()


def test_inverse_rules(spark):
    rules = spark.createDataFrame([(0, r"a\.([0-9]+)\.w", "layers.$1.kernel")], "priority int, pattern string, target string")
    back = mapping.map_keys(spark.createDataFrame([("layers.7.kernel",)], "key string"), mapping.inverse_rules(rules)).first()
    assert back.target == "a.7.w"
    rules = spark.createDataFrame([(0, r"(q|k)_proj\.([0-9]+)\.w", "at.$2.$1.kernel"), (1, r"mlp\.(up|down)", "mlp_$1")], "priority int, pattern string, target string")
    keys = spark.createDataFrame([("q_proj.3.w",), ("k_proj.12.w",), ("mlp.up",)], "key string")
    there = mapping.map_keys(keys, rules).select(F.col("target").alias("key"))
    assert {r.target for r in mapping.map_keys(there, mapping.inverse_rules(rules)).collect()} == {r.key for r in keys.collect()}
    with pytest.raises(Exception, match="no way back"):
        mapping.inverse_rules(spark.createDataFrame([(0, "(a)(b)", "x$1")], "priority int, pattern string, target string")).collect()


def test_merged_rules_have_an_order(spark):
    rule = lambda *r: spark.createDataFrame(list(r), "priority int, pattern string, target string")
    got = mapping.merged_rules(rule((0, "a", "1"), (1, "b.*", "2")), rule((0, "a", "3"), (1, "b", "4"))).orderBy("priority").collect()
    assert [tuple(r) for r in got] == [(1, "b.*", "2"), (2, "a", "3"), (3, "b", "4")]


def test_images_by_other_keys(spark):
    rows = spark.createDataFrame([(1, [("image", None, "p.png", None), ("image", None, None, b"x"), ("text", "u", None, None), ("image", None, None, None)])],
                                 "i long, blocks array<struct<type:string,url:string,path:string,image:binary>>")
    assert [(r.ordinal, r.url, r.image) for r in plugins.image_refs(rows, ["i"]).collect()] == [(0, "p.png", None), (1, None, b"x")]
    shapes = stats.image_shapes(spark.createDataFrame([(4, 8, 0), (2, 2, 1), (4, 8, 2), (9, 9, 3)], "height int, width int, ordinal int"))
    assert list(shapes.items()) == [("4x8", 2), ("2x2", 1), ("9x9", 1)]


def test_stream_waits_for_early_messages(spark, tmp_path):
    from chatpack.streaming.packing import pack_stream

    rng = random.Random(1)
    rows = [(s, i, rng.randint(1, 5)) for s in range(6) for i in range(12)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    for k in range(3):
        spark.createDataFrame(shuffled[k::3], "session_id long, message_idx long, length long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id long, message_idx long, length long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    pack_stream(stream, 9).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.session_id, r.message_idx): r.chunk_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    expected = {}
    for s in range(6):
        expected |= {(s, i): c for i, c in enumerate(chunks_of([n for t, _, n in rows if t == s], 9))}
    assert got == expected


def test_plugins(spark):

    rows = spark.createDataFrame([(1, "a bb", [("text", None), ("image", "x.png"), ("image", None)])], "i int, t string, blocks array<struct<type:string,url:string>>")
    encode = plugins.text_tokenizer(lambda: lambda t: [len(w) for w in t.split()])
    assert rows.select(encode("t").alias("ids")).first().ids == [1, 2]
    assert [tuple(r) for r in plugins.image_refs(rows, ["i"]).collect()] == [(1, 0, "x.png")]
    assert rows.select(F.size(plugins.guarded(F.col("blocks"), True)).alias("n")).first().n == 3
    with pytest.raises(Exception, match="need a processor"):
        rows.select(plugins.guarded(F.col("blocks"), False)).collect()


def test_vision_budget(spark):
    one = spark.range(1)
    plan = one.select(vision.pad_plan(F.lit(16), F.lit(1), 64, 3, 2).alias("p")).first().p
    assert plan.status == "ok" and [tuple(g) for g in plan.grids] == [(1, 2, 22), (1, 2, 2)]
    assert one.select(vision.pad_plan(F.lit(16), F.lit(1), 20, 1, 2).alias("p")).first().p.status != "ok"
    assert vision.budget_divides(64, 3, 2) and not vision.budget_divides(63, 1, 2)


def test_stored_measures_meet_without_an_exchange(spark):
    rows = spark.range(500).selectExpr("id div 7 as record_idx", "id % 7 as message_offset", "id * 3 as x")
    own = measures.bucketed(rows.selectExpr("record_idx", "message_offset", "x + 1 as length", "x as more"), 4)
    found = measures.with_measures(measures.bucketed(rows.where("record_idx > 2"), 4), own)
    assert "Exchange" not in found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    got = found.collect()
    assert len(got) == 500 - 21 and all(r.length == r.x + 1 and r.more == r.x for r in got)
    with pytest.raises(Exception, match="no measure of message 6 of record 3"):
        measures.with_measures(measures.bucketed(rows, 4), measures.bucketed(own.where("record_idx <> 3 or message_offset <> 6"), 4)).collect()
    assert [measures.buckets_for(n, 10) for n in (0, 1, 10, 11, 25, 41)] == [1, 1, 1, 2, 4, 8]
