import json
import re

import pytest
from pyspark.sql import functions as F

from chatpack.sources import dataset


def write_lines(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def session(n, **more):
    return json.dumps({"messages": [{"role": "user" if i % 2 == 0 else "assistant", "content": c} for i, c in enumerate(n)]} | more)


def test_blocks_and_shards(spark, tmp_path):
    source = write_lines(tmp_path / "train.jsonl", [session("abcde")])
    doc = dataset.compile_jsonl(spark, source, str(tmp_path / "out"), messages_per_record=2, records_per_shard=1)
    assert (doc["num_shards"], doc["num_records"], doc["num_sessions"]) == (3, 3, 1)
    rows = dataset.read(spark, str(tmp_path / "out"), dataset.PAYLOAD).orderBy("record_idx").collect()
    assert [(r["message_start"], r["message_end"]) for r in rows] == [(0, 2), (2, 4), (4, 5)]
    assert rows[0]["session_id"] == "train-000000001"


def test_line_numbers_count_blank_lines(spark, tmp_path):
    source = write_lines(tmp_path / "s.jsonl", [session("a"), "  ", session("b", session_id="mine", batch=[[1, 2]])])
    got = dataset.read_sessions(spark, source).orderBy("source_line")
    assert [r["session_id"] for r in got.collect()] == ["s-000000001", "s-000000003"]
    meta = got.select(F.to_json(F.col("session_meta")["batch"]).alias("b"), F.map_keys("session_meta").alias("k")).collect()[1]
    assert meta["b"] == "[[1,2]]" and meta["k"] == ["batch"]


def test_line_numbers_over_many_splits(spark, tmp_path):
    source = write_lines(tmp_path / "big.jsonl", [f"line {i}" for i in range(3000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = dataset.read_lines(spark, source)
        assert rows.rdd.getNumPartitions() > 3
        assert rows.where(F.concat(F.lit("line "), F.col("source_line") - 1) != F.col("value")).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_errors(spark, tmp_path):
    bad = write_lines(tmp_path / "bad.jsonl", ['{"messages": 3}'])
    with pytest.raises(Exception, match="no list of messages"):
        dataset.read_sessions(spark, bad).collect()
    with pytest.raises(ValueError, match="positive"):
        dataset.compile_jsonl(spark, bad, str(tmp_path / "x"), messages_per_record=0)
    with pytest.raises(ValueError, match="no compiled dataset"):
        dataset.read(spark, bad)
    source = write_lines(tmp_path / "ok.jsonl", [session("ab")])
    dataset.compile_jsonl(spark, source, str(tmp_path / "ok"))
    with pytest.raises(FileExistsError):
        dataset.compile_jsonl(spark, source, str(tmp_path / "ok"))
    with pytest.raises(ValueError, match="index dataset is needed"):
        dataset.read(spark, str(tmp_path / "ok"), dataset.INDEX)


def test_a_failed_write_leaves_the_dataset_of_before(spark, tmp_path):
    path = str(tmp_path / "d")
    rows = lambda n: spark.range(n).withColumnRenamed("id", "record_idx").withColumn("x", F.lit(n))
    assert dataset.write(rows(5), path, dataset.PAYLOAD, {}, 2)["num_shards"] == 3
    broken = rows(9).withColumn("x", F.when(F.col("record_idx") == 8, F.raise_error("lost").cast("int")).otherwise(1))
    with pytest.raises(Exception, match="lost"):
        dataset.write(broken, path, dataset.PAYLOAD, {}, 2, overwrite=True)
    with pytest.raises(ValueError, match="at least one"):
        dataset.write(rows(0), path, dataset.PAYLOAD, {}, 2, overwrite=True)
    before = dataset.read(spark, path)
    assert dataset.metadata(spark, path)["num_records"] == before.count() == 5
    for n in (7, 8):
        dataset.write(rows(n), path, dataset.PAYLOAD, {}, 2, overwrite=True)
        assert dataset.metadata(spark, path)["num_records"] == dataset.read(spark, path).count() == n
        if n == 7:
            assert before.count() == 5  # a reader of the version before goes on
    assert len(list((tmp_path / "d/metadata").glob("v=*"))) == 2


def test_records_at_read_their_shards_only(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "d")
    dataset.write(spark.range(1000).selectExpr("id as record_idx", "id * 2 as x"), path, dataset.PAYLOAD, {}, 100)
    wanted = spark.createDataFrame([(i, "w") for i in (5, 7, 410, 410, 999, 5000)], "record_idx long, tag string")
    got = dataset.records_at(spark, path, wanted)
    assert sorted((r.record_idx, r.x, r.tag) for r in got.collect()) == [(i, 2 * i, "w") for i in (5, 7, 410, 410, 999)]
    plan = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    assert re.search(r"PartitionFilters: \[.*shard", plan) and "In(record_idx" in plan
    monkeypatch.setattr(dataset, "ADDRESSES", 2)
    assert sorted(r.record_idx for r in dataset.records_at(spark, path, wanted).collect()) == [5, 7, 410, 410, 999]
