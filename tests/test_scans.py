import random

import pytest
from pyspark.sql import functions as F

from chatpack.operators import scans


def plain(rows):
    """rows (key, pos, x, y, s) in order to (sum x, sum y, first s, lag 2 of x, lead of s) of each."""
    out = []
    for i, (key, _, x, y, s) in enumerate(rows):
        start = i
        while start and rows[start - 1][0] == key:
            start -= 1
        own = rows[start : i + 1]
        out.append((sum(r[2] or 0 for r in own), sum(r[3] for r in own), own[0][4], own[-3][2] if len(own) > 2 else None,
                    rows[i + 1][4] if i + 1 < len(rows) and rows[i + 1][0] == key else None))
    return out


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_runs_over_many_partitions(spark, parts):
    rng = random.Random(parts)
    rows = []
    for key in [None, *range(12)]:
        # The key 5 has most rows and lies in many partitions.
        for pos in range(rng.choice([1, 2, 5]) if key != 5 else 300):
            rows.append((key, pos, rng.choice([None, -3, 0, 7]), rng.choice([0.5, 2.25]), rng.choice(["a", None, "b"])))
    expected = plain(rows)
    df = spark.createDataFrame(rows, "k long, pos long, x int, y double, s string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 6)
    try:
        got = scans.scan(df, ["k", "pos"], ["k"], {"sx": ("sum", "x"), "sy": ("sum", "y"), "fs": ("first", "s"), "l2": ("lag", "x", 2), "ns": ("lead", "s")}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = {(r.k, r.pos): (r.sx, r.sy, r.fs, r.l2, r.ns) for r in got}
    assert found == {(r[0], r[1]): x for r, x in zip(rows, expected)} and len(got) == len(rows)


def test_no_rows(spark):
    df = spark.createDataFrame([], "k string, pos int, x long")
    assert scans.scan(df, ["k", "pos"], ["k"], {"n": ("sum", "x"), "p": ("lag", "x", 1)}).dtypes == [("k", "string"), ("pos", "int"), ("x", "bigint"), ("n", "bigint"), ("p", "bigint")]
    assert scans.scan(df.withColumn("y", F.lit(1)), ["pos"], [], {"n": ("sum", "y")}).count() == 0
