"""Connected components over a table of links, and tables stored in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table below ``spark.checkpoint.dir`` and read again.

    Its lineage ends there, so lost executors cost no more than the step at hand, and
    the optimizer sees its size. Unlike a checkpoint it keeps no partitioning, which
    lets adaptive execution split the hot keys of later joins. The folder is scratch
    space, to be emptied after a run. A session without the setting (tests on
    one machine) gets a temporary folder.
    """
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tables-")
    path = f"{folder.rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); the component is its smallest node.

    Each round points every node at the smallest node it knows of, first from the larger
    neighbours and then from the smaller ones, until nothing changes; a component of
    diameter d takes about log d rounds. A round has only equi-joins and minimums with
    map-side sums, so a node with very many links does not meet in one task.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, state = stored(edges), None
    while True:
        edges = stored(_small_star(_large_star(edges)))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
    pairs = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.union(edges.select("v", "v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node go to its smallest neighbour (itself included)."""
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).toDF("x", "y")
    least = stored(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")))
    return (
        both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node, go to the smallest of them."""
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
