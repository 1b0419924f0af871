"""Usage analytics over a log of operations.

Logs have: id, module, operation, status, tokens, latency, cost, timestamp,
error_msg. "Now" is always a parameter. Ranges include both ends.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import hour_label

LOG_COLUMNS = ("id", "module", "operation", "status", "tokens", "latency", "cost", "timestamp", "error_msg")


def where_all(df: DataFrame, conditions: list[Column]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df


def in_range(logs: DataFrame, as_of: str | None = None, start: str | None = None, end: str | None = None, hours: int | None = None, **equal: str | None) -> DataFrame:
    """Logs from start to end, or of the hours before as_of; then equal to each value that isn't empty."""
    ts = F.col("timestamp")
    stamp = lambda x: F.to_timestamp_ntz(F.lit(x))
    conditions = []
    if start:
        conditions.append(ts >= stamp(start))
    elif as_of and hours is not None:
        conditions.append(ts >= stamp(as_of) - F.make_dt_interval(hours=F.lit(hours)))
    if end:
        conditions.append(ts <= stamp(end))
    conditions += [F.col(c) == v for c, v in equal.items() if v]
    return where_all(logs, conditions)


def measures(failed: str = "failed") -> list[Column]:
    """All figures of one selection, in one pass."""
    n, bad = F.count("id"), F.count_if(F.col("status") == failed)
    return [
        n.alias("total_calls"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("total_tokens"),
        F.round(F.coalesce(F.avg("latency"), F.lit(0.0)), 3).alias("avg_latency"),
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("total_cost"),
        bad.alias("failed_calls"),
        F.when(n > 0, F.round(bad / n * 100, 2)).otherwise(F.lit(0.0)).alias("error_rate"),
    ]


def stats(logs: DataFrame, by: list[str] | None = None) -> DataFrame:
    return logs.groupBy(*by).agg(*measures()) if by else logs.agg(*measures())


def trend(logs: DataFrame) -> DataFrame:
    """Calls and tokens by hour; hours without calls have no row."""
    return logs.groupBy(hour_label(F.col("timestamp")).alias("hour")).agg(F.count("id").alias("calls"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("tokens"))


def distribution(logs: DataFrame, by: str = "module") -> DataFrame:
    return logs.groupBy(by).agg(F.count("id").alias("calls"))


def shares(counts: DataFrame, value: str = "calls") -> DataFrame:
    """Each row's share of the total; the totals meet in one row, not in one window."""
    total = counts.agg(F.sum(value).alias("total"))
    return counts.join(F.broadcast(total)).withColumn("share", F.round(F.col(value) / F.col("total"), 6)).drop("total")


def recent(logs: DataFrame, n: int = 50, module: str | None = None, status: str | None = None) -> DataFrame:
    """The latest n of the logs that pass the filters; ties by id."""
    kept = in_range(logs, module=module, status=status)
    return kept.select(*LOG_COLUMNS).orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def page(logs: DataFrame, by: str, number: int, size: int = 10) -> DataFrame:
    """Page number (from 1) of the logs by falling values, with each row's place and the count of all."""
    first = (number - 1) * size
    top = logs.orderBy(F.desc_nulls_last(by), "id").limit(first + size)
    placed = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last(by), "id")))
    return placed.where(F.col("place") > first).join(F.broadcast(logs.agg(F.count("*").alias("total"))))


def by_operation(logs: DataFrame, module: str = "module") -> DataFrame:
    """Two measures a module: tokens of calls that ended well, and of those that failed."""
    ok = F.col("status") != "failed"
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("tokens"))), F.lit(0)).cast("bigint")
    return logs.groupBy(module).agg(total(ok).alias("tokens_ok"), total(~ok).alias("tokens_failed"))


def change(series: DataFrame, order: str, value: str) -> DataFrame:
    """Each period's change in percent from the one before, over an aggregated series."""
    before = F.lag(value).over(Window.orderBy(order))
    return series.withColumn("change", F.when(before != 0, F.round((F.col(value) - before) / before * 100, 2)))


def append(log: DataFrame, **entry) -> DataFrame:
    """The log with one more entry; its id is one past the greatest."""
    top = log.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))
    row = top.select("id", *(F.lit(v).alias(k) for k, v in entry.items()))
    return log.unionByName(row, allowMissingColumns=True)


def in_and_out(rows: DataFrame, module: str, amount: Column, inward: Column) -> DataFrame:
    """Tokens that went into a model and that came out of it, by module."""
    total = lambda c: F.coalesce(F.sum(F.when(c, amount)), F.lit(0)).cast("bigint")
    return rows.groupBy(module).agg(total(inward).alias("input"), total(~inward).alias("output"))


def in_order(series: DataFrame, by: str = "hour") -> DataFrame:
    """An aggregated series (a row an hour) with each row's place."""
    return series.withColumn("place", F.row_number().over(Window.orderBy(by)))
