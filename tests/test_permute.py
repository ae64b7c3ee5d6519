import numpy as np
import pytest
from pyspark.sql import functions as F

from chatpack.operators import permute


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 99_991])
def test_permutation_and_back(n):
    x = np.arange(n)
    for seed, epoch, shard in ((0, 0, 0), (7, 1, 0), (7, 1, 3), (-5, 0, 0)):
        at = permute.place(x, n, seed, epoch, shard)
        assert (np.sort(at) == x).all() and (permute.record(at, n, seed, epoch, shard) == x).all()


def test_orders_are_mixed():
    n = 50_000
    a, b = permute.place(np.arange(n), n, 1), permute.place(np.arange(n), n, 1, 1)
    for order in (a, b, a[b]):
        # Neighbours move apart, and places do not follow record numbers.
        assert abs(np.corrcoef(np.arange(n), order)[0, 1]) < 0.02 and abs(np.corrcoef(order[1:], order[:-1])[0, 1]) < 0.02
        assert np.histogram(order[: n // 10], 10, (0, n))[0].std() < 60
    assert (a == b).sum() < 10


def test_numbers_beyond_32_bits():
    n = 10**13 + 7
    x = np.array([0, 1, 5, 2**33, n - 1])
    at = permute.place(x, n, 3)
    assert (permute.record(at, n, 3) == x).all() and ((at >= 0) & (at < n)).all() and at.max() > 2**33


def test_epochs_have_no_exchange_and_resume_directly(spark):
    records = spark.range(103).withColumnRenamed("id", "record_idx")
    stream = permute.epochs(records, 103, 2, 5, 4)
    assert "Exchange" not in stream._sc._jvm.PythonSQLUtils.explainString(stream._jdf.queryExecution(), "formatted")
    rows = {(r.dp_index, r.position): r.record_idx for r in stream.collect()}
    assert len(rows) == 200 and {k[1] for k in rows} == set(range(50))
    for shard in range(4):
        for epoch in (0, 1):
            assert sorted(rows[shard, epoch * 25 + k] for k in range(25)) == list(range(25 * shard, 25 * shard + 25))
    got = permute.batches(records, 103, 8, 2, 3, 5, 4).collect()
    assert {(r.dp_index, r.position): r.record_idx for r in got} == {k: v for k, v in rows.items() if 16 <= k[1] < 40}
    assert all(r.batch_id == r.position // 8 and r.slot == r.position % 8 for r in got) and len(got) == 96
    with pytest.raises(ValueError):
        permute.batches(records, 103, 0, 0, 1)
    with pytest.raises(ValueError):
        permute.addresses(spark, 3, 0, 1, dp_size=4)
    assert permute.epochs(records.where(F.col("record_idx") < 0), 103).count() == 0
