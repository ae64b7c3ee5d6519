import json
import shutil

import pytest
from pyspark.sql import functions as F

from chatpack.functions import configs, mapping
from chatpack.operators import index
from chatpack.sources import dataset


def write(path, sessions, **more):
    path.write_text("".join(json.dumps({"messages": [{"role": "user" if i % 2 == 0 else "assistant", "content": c} for i, c in enumerate(s)]} | more) + "\n" for s in sessions))
    return str(path)


@pytest.fixture
def built(spark, tmp_path):
    def build(sessions, max_length=2, **more):
        source = write(tmp_path / "train.jsonl", sessions, **more)
        dataset.compile_jsonl(spark, source, str(tmp_path / "payload"), messages_per_record=2)
        doc = index.build_chunk_index(spark, str(tmp_path / "payload"), str(tmp_path / "index"), max_length, measure=lambda m: F.lit(1))
        return str(tmp_path / "index"), doc

    return build


def firsts(df):
    return [r.f for r in df.orderBy("position").select(F.expr("messages[0].content::string").alias("f")).collect()]


def test_chunks_span_blocks(spark, built):
    path, doc = built([["red", "ochre", "amber", "moss", "teal", "indigo", "plum"], ["alone"]], batch={"k": [4]})
    rows = index.examples(spark, path).orderBy("session_id", "chunk_id").select("num_messages", "session_id", F.expr("messages[0].content::string").alias("f"), F.to_json(F.col("session_meta")["batch"]).alias("b")).collect()
    starts = [(2, 1, "red"), (2, 1, "amber"), (2, 1, "teal"), (1, 1, "plum"), (1, 2, "alone")]
    assert [tuple(r) for r in rows] == [(n, f"train-{line:09d}", first, '{"k":[4]}') for n, line, first in starts]
    per = doc["token_stats"]["per_chunk"]
    assert per["num_chunks"] == 5 and per["measured_length"]["sum"] == 8 and doc["token_stats"]["image_shapes"] == {} and doc["token_stats"]["per_message"]["length"]["mean"] == 1


def test_resume_and_shards(spark, built):
    names = list("abcdefghijkl")
    path, _ = built([names])
    whole = index.training_stream(spark, path, 2, shuffle=False)
    assert firsts(whole) == names[::2]
    assert firsts(index.training_stream(spark, path, 2, shuffle=False, start_batch=2)) == names[8::2]
    two = index.training_stream(spark, path, 1, shuffle=False, dp_size=2)
    assert firsts(two.where("dp_index = 0")) == names[:6:2] and firsts(two.where("dp_index = 1")) == names[6::2]


def test_a_lost_shard_is_noticed(spark, tmp_path):
    dataset.compile_jsonl(spark, write(tmp_path / "a.jsonl", [["x"], ["y"], ["z"]]), str(tmp_path / "p"), records_per_shard=1)
    assert dataset.read(spark, str(tmp_path / "p")).count() == 3
    shutil.rmtree(tmp_path / "p/records/shard=1")
    with pytest.raises(FileNotFoundError, match="2 of 3 shards"):
        dataset.read(spark, str(tmp_path / "p"))


def test_a_payload_is_no_index(spark, tmp_path):
    dataset.compile_jsonl(spark, write(tmp_path / "a.jsonl", [["x"]]), str(tmp_path / "p"))
    with pytest.raises(ValueError, match="index dataset is needed"):
        index.training_stream(spark, str(tmp_path / "p"), 1)
    index.build_chunk_index(spark, str(tmp_path / "p"), str(tmp_path / "i"), 500)
    with pytest.raises(ValueError, match="payload dataset is needed"):
        index.build_chunk_index(spark, str(tmp_path / "i"), str(tmp_path / "j"), 500)


def test_block_content(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text(json.dumps({"messages": [{"role": "user", "content": [{"type": "text", "text": "ab"}, {"type": "audio"}, {"type": "text", "text": "c"}]}]}) + "\n")
    m = dataset.read_sessions(spark, str(tmp_path / "b.jsonl")).select(F.explode("messages").alias("m"))
    assert m.select(index.content_text(F.col("m")).alias("t")).first().t == "abc"


def test_configs(spark):
    base = {"hidden_size": 64, "num_attention_heads": 4, "num_key_value_heads": 2, "head_dim": 16, "intermediate_size": 128, "vocab_size": 1000, "num_hidden_layers": 2, "torch_dtype": "bfloat16"}
    moe = base | {"num_local_experts": 8, "num_experts_per_tok": 2, "moe_intermediate_size": 32}
    df = spark.createDataFrame([("dense", json.dumps(base)), ("moe", json.dumps(moe))], "name string, text string")
    rows = {r["name"]: r for r in configs.decoder(df, "name", "text").collect()}
    assert (rows["dense"].experts, rows["moe"].experts, rows["moe"].d, rows["dense"].dtype) == (0, 8, 64, "bfloat16")
    back = configs.to_document(configs.decoder(df, "name", "text"), "name")
    again = configs.decoder(back, "name", "document")
    a, b = (configs.unpivoted(x, "name").where("name = 'moe'").select("field", "value") for x in (configs.decoder(df, "name", "text"), again))
    assert mapping.config_mismatches(a, b).count() == 0
    bad = spark.createDataFrame([("x", json.dumps({k: v for k, v in base.items() if k != "head_dim"}))], "name string, text string")
    with pytest.raises(Exception, match="missing head_dim"):
        configs.decoder(bad, "name", "text").collect()
    fam = configs.dispatch(spark.createDataFrame([("a-vl-2b",), ("a-1b",)], "m string"), "m", [("-vl-", "vision"), ("^a-", "text")])
    assert [r.family for r in fam.collect()] == ["vision", "text"]


def test_saved_place(spark, built, tmp_path):
    path, _ = built([[f"{i}a", f"{i}b"] for i in range(9)])
    stream = {"batch_size": 2, "seed": 3, "num_epochs": 2}
    for place in (0, 2, 10):
        index.save_state(spark, str(tmp_path / f"state{place}"), place // 2, **stream)
        index.save_state(spark, str(tmp_path / f"state{place}"), place, **stream)
        rest = index.training_stream(spark, path, start_batch=place, **stream)
        assert firsts(index.resumed_stream(spark, path, str(tmp_path / f"state{place}"))) == firsts(rest)


def test_config_files(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "config.json").write_text('{\n"a": 1}')
    (tmp_path / "m" / "notes.txt").write_text("no")
    for path in (tmp_path, tmp_path / "m" / "config.json"):
        assert [r.text for r in configs.read_documents(spark, str(path)).collect()] == ['{\n"a": 1}']


def test_records_of_message_rows(spark):
    rows = spark.createDataFrame([("s", i, f"m{i}") for i in (4, 0, 2, 1, 3)] + [("t", 0, None)], "session_id string, message_idx long, message string")
    got = {(r.session_id, r.block_idx): (r.message_start, r.message_end, r.messages) for r in dataset.message_blocks(rows, 2).collect()}
    assert got == {("s", 0): (0, 2, ["m0", "m1"]), ("s", 1): (2, 4, ["m2", "m3"]), ("s", 2): (4, 5, ["m4"]), ("t", 0): (0, 1, [None])}


def test_reshape_of_other_size(spark):
    bad = spark.range(1).select(mapping.reshaped(F.array(F.lit(2), F.lit(3)), F.array(F.lit(4), F.lit(-1))))
    with pytest.raises(Exception, match="reshape"):
        bad.collect()


def test_image_shapes_come_from_the_measure(spark, tmp_path):
    dataset.compile_jsonl(spark, write(tmp_path / "a.jsonl", [["xx", "y"], ["zzz", "x", "y"]]), str(tmp_path / "p"), messages_per_record=2)
    size = lambda n: F.struct((n * 2).cast("int").alias("height"), F.lit(8).alias("width"))

    def measure(m):
        n = F.length(index.content_text(m))
        return F.struct(F.lit(3).alias("length"), n.alias("num_images"), F.array_repeat(size(n), n).alias("image_sizes"))

    doc = index.build_chunk_index(spark, str(tmp_path / "p"), str(tmp_path / "i"), 6, measure)["token_stats"]
    assert list(doc["image_shapes"].items()) == [("2x8", 3), ("6x8", 3), ("4x8", 2)] or list(doc["image_shapes"].items()) == [("6x8", 3), ("2x8", 3), ("4x8", 2)]
    assert doc["per_message"]["num_images"]["sum"] == 8


def test_own_fields_come_before_meta(spark, built):
    path, _ = built([["a", "b"]], chunk_id=77, messages_seen=5, label={"x": 1})
    row = index.example_fields(index.examples(spark, path)).select(F.expr("example['chunk_id']::long").alias("c"), F.expr("variant_get(example['label'], '$.x', 'int')").alias("x"), F.expr("variant_get(example['messages'], '$[1].role', 'string')").alias("r"), F.map_keys("example").alias("k")).first()
    assert (row.c, row.x, row.r) == (0, 1, "assistant") and sorted(row.k) == ["chunk_id", "label", "messages", "messages_seen", "session_id"]


def test_index_of_tokens_by_the_command_line(spark, tmp_path, capsys):
    from tokenizers import Tokenizer, models, pre_tokenizers

    own = Tokenizer(models.WordLevel({"hello": 0, "<unk>": 1}, unk_token="<unk>"))
    own.pre_tokenizer = pre_tokenizers.Whitespace()
    own.save(str(tmp_path / "t.json"))
    from chatpack import cli

    cli.main(["compile", write(tmp_path / "a.jsonl", [["hello hello", "x"]]), str(tmp_path / "p")])
    capsys.readouterr()
    cli.main(["index", str(tmp_path / "p"), str(tmp_path / "i"), "--max-length", "50", "--tokenizer", str(tmp_path / "t.json"), "--profile", "model=small"])
    doc = json.loads(capsys.readouterr().out.splitlines()[-1])
    text = "<|im_start|>user\nhello hello<|im_end|>\n"
    assert doc["token_stats"]["per_message"]["length"]["max"] == len(own.encode(text).ids) and doc["profile_metadata"] == {"model": "small", "tokenizer": str(tmp_path / "t.json")}
    with pytest.raises(SystemExit):
        cli.main(["index", str(tmp_path / "p"), str(tmp_path / "j"), "--max-length", "50", "--profile", "none"])


def test_checkpoints_hold_all_of_a_run(spark, built, tmp_path):
    path, _ = built([list("abcdefghijkl")])
    state = str(tmp_path / "run")
    for step in range(1, 8):
        index.save_state(spark, state, step, step, rng=[step, 9], metrics={"loss": 1 / step}, every=2, batch_size=1, seed=4)
    assert index.saved_state(spark, state) == {"stream": {"start_batch": 6, "batch_size": 1, "seed": 4}, "step": 6, "rng": [6, 9], "metrics": {"loss": 1 / 6}}
    assert sorted(p.name for p in (tmp_path / "run").glob("batch=*")) == ["batch=4", "batch=6"]
    whole = firsts(index.training_stream(spark, path, 1, seed=4))
    assert sorted(whole) == list("acegik") and firsts(index.resumed_stream(spark, path, state)) == whole[6:]
    shutil.rmtree(tmp_path / "run/batch=6")
    assert firsts(index.resumed_stream(spark, path, state)) == whole[4:]
