"""The driver tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatpack.functions import chatml
from chatpack.operators.scans import scan
from chatpack.operators.storage import folder

#: Characters of a chunk in the packing queries.
MAX_LENGTH = 4000
# Fixed values of the word-level ids in the encoding queries.
START, USER, ASSISTANT, SYSTEM, NEWLINE, END, FIRST_WORD = 1, 2, 3, 4, 5, 6, 10


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, kind: str) -> str:
    return folder(spark, kind)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, message_idx, role, text, length) of the conversations."""
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("message_idx"), "role", "text", chatml.char_length(F.col("role"), F.col("text")).alias("length"))


def turn_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, ids): word-level ids of each turn in ChatML."""
    role = F.when(F.col("role") == "assistant", ASSISTANT).when(F.col("role") == "system", SYSTEM).otherwise(USER)
    words = F.transform(F.split("text", " "), lambda w: F.length(w) + FIRST_WORD)
    own = F.concat(F.array(F.lit(START), role, F.lit(NEWLINE)), words, F.array(F.lit(END), F.lit(NEWLINE)))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", own.alias("ids"))


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, ids): the ids of each conversation in one array, for results that are one value for each conversation."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "ids")))
    return turn_ids(spark, sf_dir).groupBy("conv_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, pos, token) rows: a turn's tokens come after as many as the turns before it have."""
    turns = turn_ids(spark, sf_dir).withColumn("n", F.size("ids"))
    placed = scan(turns, ["conv_id", "turn"], ["conv_id"], {"until": ("sum", "n")})
    each = placed.select("conv_id", (F.col("until") - F.col("n")).alias("before"), F.posexplode("ids").alias("at", "token"))
    return each.select("conv_id", (F.col("before") + F.col("at")).alias("pos"), "token")
