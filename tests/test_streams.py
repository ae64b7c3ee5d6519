import pytest

from chatpack.operators import permute
from chatpack.sources.batches import BatchReader, batch_stream
from chatpack.streaming.metrics import metrics_sink, read_metrics


def run(stream, folder, name="rows", sink="parquet"):
    query = stream.writeStream.format(sink).option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_a_stream_of_batches_goes_on_after_a_stop(spark, tmp_path):
    options = dict(records=103, batch_size=8, num_epochs=2, seed=3, dp_size=2)
    for until in (2, 5, 99):
        run(batch_stream(spark, **options, until=until), tmp_path)
        rows = spark.read.parquet(f"{tmp_path}/rows").collect()
        assert len(rows) == len({(r.dp_index, r.position) for r in rows}) == 2 * 8 * min(until, 12)
    records = spark.range(103).withColumnRenamed("id", "record_idx")
    whole = {(r.dp_index, r.position): r.record_idx for r in permute.epochs(records, 103, 2, 3, 2).collect()}
    assert {(r.dp_index, r.position): r.record_idx for r in rows} == {k: v for k, v in whole.items() if k[1] < 96}
    assert all((r.batch_id, r.slot, r.epoch) == (r.position // 8, r.position % 8, r.position // 51) for r in rows)


def test_batch_offsets():
    reader = BatchReader({"records": "20", "batch_size": "3", "shuffle": "false", "start_batch": "2"})
    assert reader.initialOffset() == {"batch": 2} and reader.latestOffset() == {"batch": 6}
    assert reader.partitions({"batch": 2}, {"batch": 2}) == []
    got = [x for p in reader.partitions({"batch": 2}, {"batch": 6}) for b in reader.read(p) for x in b.column("record_idx").to_pylist()]
    assert got == list(range(6, 18))
    with pytest.raises(ValueError):
        BatchReader({"records": "3", "batch_size": "1", "dp_size": "4"})


def test_metrics_of_a_replayed_stream_are_written_once(spark, tmp_path):
    rows = [(k % 4, float(k) if k % 5 else None, 1) for k in range(40)]
    schema = "step long, loss double, tokens long"
    for part in (rows[:25], rows[25:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for attempt in range(2):  # the second one starts without a checkpoint, so that all batches come again
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        metrics_sink(stream, f"{tmp_path}/out", f"{tmp_path}/state{attempt}", "step", ("loss",), ("tokens",)).awaitTermination()
        got = {r.step: (r.rows, r.loss, r.tokens) for r in read_metrics(spark, f"{tmp_path}/out", ("loss",), ("tokens",)).collect()}
        mean = lambda s: [x for k, x, _ in rows if k == s and x is not None]
        assert got == {s: (10, sum(mean(s)) / len(mean(s)), 10) for s in range(4)}
    assert {r.step for r in read_metrics(spark, f"{tmp_path}/out", ("loss",), every=2).collect()} == {0, 2}
