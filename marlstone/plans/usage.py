"""Usage analytics over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import usage
from marlstone.plans.base import query
from marlstone.session import table

#: The log that the events stand for, in SQL; logs() is the same.
LOGS = """WITH logs AS (SELECT event_id AS id, event_type AS module, 'user_' || (user_id % 7) AS operation,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens,
  value AS latency, value / 1000 AS cost, ts AS timestamp FROM events) """
MEASURES = """count(id) AS total_calls, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS total_tokens, round(coalesce(avg(latency), 0), 3) AS avg_latency,
  round(coalesce(sum(cost), 0), 4) AS total_cost, count(*) FILTER (status = 'failed') AS failed_calls,
  CASE WHEN count(id) > 0 THEN round(count(*) FILTER (status = 'failed') / count(id) * 100, 2) ELSE 0.0 END AS error_rate"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("module"),
        F.concat(F.lit("user_"), (F.col("user_id") % 7).cast("string")).alias("operation"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens"),
        F.col("value").alias("latency"),
        (F.col("value") / 1000).alias("cost"),
        F.col("ts").alias("timestamp"),
        F.lit(None).cast("string").alias("error_msg"),
    )


@query(LOGS + f"SELECT {MEASURES} FROM logs")
def usage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.stats(logs(spark, sf_dir))


@query(LOGS + f"SELECT module, {MEASURES} FROM logs GROUP BY module")
def usage_stats_by_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.stats(logs(spark, sf_dir), ["module"])


@query(LOGS + f"SELECT {MEASURES} FROM logs WHERE timestamp BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00' AND module = 'view'")
def usage_stats_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = usage.in_range(logs(spark, sf_dir), start="2024-01-10 00:00:00", end="2024-01-12 12:00:00", module="view", status="")
    return usage.stats(picked)


@query(LOGS + f"SELECT {MEASURES} FROM logs WHERE timestamp > TIMESTAMP '2030-01-01'")
def usage_stats_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.stats(usage.in_range(logs(spark, sf_dir), start="2030-01-01 00:00:00"))


@query(LOGS + "SELECT strftime(timestamp, '%Y-%m-%d %H:00') AS hour, count(id) AS calls, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens FROM logs GROUP BY 1")
def usage_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.trend(logs(spark, sf_dir)).orderBy("hour")


@query(LOGS + "SELECT strftime(timestamp, '%Y-%m-%d %H:00') AS hour, count(id) AS calls, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens FROM logs WHERE timestamp >= TIMESTAMP '2024-01-28 06:00:00' AND module = 'click' GROUP BY 1")
def usage_trend_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.trend(usage.in_range(logs(spark, sf_dir), as_of="2024-01-29 06:00:00", hours=24, module="click")).orderBy("hour")


@query(LOGS + "SELECT module, count(id) AS calls FROM logs GROUP BY module")
def usage_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.distribution(logs(spark, sf_dir))


@query(LOGS + "SELECT module, count(id) AS calls, round(count(id) / sum(count(id)) OVER (), 6) AS share FROM logs GROUP BY module")
def usage_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.shares(usage.distribution(logs(spark, sf_dir)))


RECENT = "SELECT id, module, operation, status, tokens, latency, cost, timestamp, CAST(NULL AS VARCHAR) AS error_msg FROM logs"


@query(LOGS + RECENT + " ORDER BY timestamp DESC, id DESC LIMIT 50")
def recent_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.recent(logs(spark, sf_dir))


@query(LOGS + RECENT + " WHERE module = 'error' AND status = 'failed' ORDER BY timestamp DESC, id DESC LIMIT 50")
def recent_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.recent(logs(spark, sf_dir), module="error", status="failed")


@query(LOGS + "SELECT id, tokens, place, total FROM (SELECT id, tokens, row_number() OVER (ORDER BY tokens DESC NULLS LAST, id) AS place, count(*) OVER () AS total FROM logs) WHERE place BETWEEN 21 AND 30")
def logs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.page(logs(spark, sf_dir), "tokens", number=3).select("id", "tokens", F.col("place").cast("bigint").alias("place"), "total")


@query(LOGS + "SELECT module, CAST(coalesce(sum(tokens) FILTER (status <> 'failed'), 0) AS BIGINT) AS tokens_ok, CAST(coalesce(sum(tokens) FILTER (status = 'failed'), 0) AS BIGINT) AS tokens_failed FROM logs GROUP BY module")
def usage_two_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.by_operation(logs(spark, sf_dir))


@query(
    LOGS
    + """, days AS (SELECT strftime(timestamp, '%Y-%m-%d') AS day, count(id) AS calls FROM logs GROUP BY 1)
SELECT day, calls, round((calls - lag(calls) OVER (ORDER BY day)) / lag(calls) OVER (ORDER BY day) * 100, 2) AS change FROM days"""
)
def usage_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = logs(spark, sf_dir).groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("day")).agg(F.count("id").alias("calls"))
    return usage.change(days, "day", "calls")


@query(LOGS + "SELECT count(*) AS logs, max(id) AS last_id, count(*) FILTER (operation = 'generate_answer') AS answers FROM (SELECT id, operation FROM logs UNION ALL SELECT max(id) + 1, 'generate_answer' FROM logs)")
def log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = usage.append(logs(spark, sf_dir), module="rag", operation="generate_answer", status="success", tokens=12, latency=0.5, cost=0.0)
    return more.agg(F.count("*").alias("logs"), F.max("id").alias("last_id"), F.count_if(F.col("operation") == "generate_answer").alias("answers"))
