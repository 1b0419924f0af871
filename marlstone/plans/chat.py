"""Sessions and messages over the conversations table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import chat
from marlstone.plans.base import query
from marlstone.session import shared_path, table
from marlstone.streaming import answers


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


@query("SELECT conv_id, turn, role, text FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) WHERE turn < last AND role IN ('user', 'assistant')")
def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.history(_messages(spark, sf_dir))


@query("SELECT conv_id, count(*) AS messages FROM conversations GROUP BY conv_id")
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.counts(_messages(spark, sf_dir))


@query("SELECT conv_id, CAST(sum(length(text) // 4) AS BIGINT) AS tokens, CAST(sum(length(text)) // 4 AS BIGINT) AS tokens_of_sum FROM conversations GROUP BY conv_id")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.token_estimates(_messages(spark, sf_dir))


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3")
def messages_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.oldest(_messages(spark, sf_dir), n=3)


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = chat.as_list(_messages(spark, sf_dir))
    return lists.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("transcript"))


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text, count(*) AS parts, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM conversations WHERE length(text) > 0 GROUP BY conv_id")
def delta_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.deltas(_messages(spark, sf_dir), "conv_id", "turn", "text")


@query(
    """SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn), '') AS text, count(*) FILTER (length(text) > 0) AS parts, CAST(sum(coalesce(length(text) // 4, 0)) AS BIGINT) AS tokens, 'closed' AS status
FROM conversations GROUP BY conv_id"""
)
def streamed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What conversations say, told as a stream of parts that come out of order, over several batches, and twice."""
    landing, out, state = (shared_path(spark) for _ in range(3))
    rows = _messages(spark, sf_dir)
    last = rows.groupBy("conv_id").agg(F.max("turn").alias("last"))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn"))
    parts = rows.join(last, "conv_id").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.col("text").alias("delta"), F.lit(None).cast("string").alias("error"), (F.col("turn") == F.col("last")).alias("done"), at.alias("at"))
    parts.unionByName(parts).repartition(3, F.xxhash64("session", "seq")).write.parquet(landing)
    stream = spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    answers.start(stream, state, lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)).awaitTermination()
    return answers.latest(spark.read.parquet(out)).withColumnRenamed("session", "conv_id")
