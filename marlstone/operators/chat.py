"""Sessions and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import tokens


def history(messages: DataFrame, session: str = "conv_id", order: str = "turn", role: str = "role") -> DataFrame:
    """What a model sees before it answers: all but a session's last message, of users and assistants only."""
    last = messages.groupBy(F.col(session).alias("__s")).agg(F.max(order).alias("__last"))
    met = messages.join(last, messages[session] == last["__s"]).where(F.col(order) < F.col("__last"))
    return met.where(F.col(role).isin("user", "assistant")).drop("__s", "__last")


def as_list(messages: DataFrame, session: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per session with its messages in order."""
    turns = F.array_sort(F.collect_list(F.struct(F.col(order).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))))
    return messages.groupBy(session).agg(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))


def oldest(messages: DataFrame, session: str = "conv_id", order: str = "turn", n: int = 100) -> DataFrame:
    """The first n messages of every session."""
    place = F.row_number().over(Window.partitionBy(session).orderBy(order))
    return messages.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")


def sessions_by_change(sessions: DataFrame, user: str | None = None) -> DataFrame:
    own = sessions.where(F.col("user_id") == user) if user else sessions
    return own.orderBy(F.desc("updated_at"), F.desc("id"))


def counts(messages: DataFrame, session: str = "conv_id") -> DataFrame:
    return messages.groupBy(session).agg(F.count("*").alias("messages"))


def token_estimates(messages: DataFrame, by: str = "conv_id", text: str = "text") -> DataFrame:
    """Tokens rounded down by message and summed, beside those of the summed length: short messages count 0 in the first."""
    return messages.groupBy(by).agg(F.coalesce(F.sum(tokens(F.col(text))), F.lit(0)).cast("bigint").alias("tokens"), F.floor(F.coalesce(F.sum(F.length(text)), F.lit(0)) / 4).cast("bigint").alias("tokens_of_sum"))


def deltas(parts: DataFrame, key: str, order: str, delta: str) -> DataFrame:
    """Streamed parts put together: the text, the number of parts that say something and their summed token estimates."""
    said = parts.where(F.length(delta) > 0)
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(delta).alias("d"))))
    return said.groupBy(key).agg(F.array_join(F.transform(pieces, lambda p: p["d"]), "").alias("text"), F.count("*").alias("parts"), F.sum(tokens(F.col(delta))).alias("tokens"))


def add_message(messages: DataFrame, sessions: DataFrame, session_id: int, role: str, content: str, at: str) -> tuple[DataFrame, DataFrame]:
    """Messages with one more, and sessions with that one's time of change moved on."""
    stamp = F.to_timestamp_ntz(F.lit(at))
    top = messages.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))
    row = top.select("id", F.lit(session_id).cast("bigint").alias("session_id"), F.lit(role).alias("role"), F.lit(content).alias("content"), stamp.alias("timestamp"), tokens(F.lit(content)).cast("int").alias("tokens"))
    touched = sessions.withColumn("updated_at", F.when(F.col("id") == session_id, stamp).otherwise(F.col("updated_at")))
    return messages.unionByName(row), touched
