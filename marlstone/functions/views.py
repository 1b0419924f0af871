"""Rows as the interface shows them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import first_of, iso, label, megabytes

#: Labels of a document's states, and of a log's modules.
STATES = {"indexed": "已索引", "processing": "处理中", "failed": "失败"}
MODULES = {"chat": "对话", "knowledge": "知识库", "rag": "检索", "review": "审查"}


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(w.capitalize() for w in rest)


def json_rows(rows: DataFrame, *columns: str, mark: str = "") -> DataFrame:
    """Each row as JSON with names in camel case and times in ISO form; nulls are left out of no row."""
    kinds = dict(rows.dtypes)
    value = lambda c: iso(F.col(c), mark) if kinds[c].startswith("timestamp") else F.col(c)
    return rows.select(F.to_json(F.struct(*(value(c).alias(camel(c)) for c in columns)), {"ignoreNullFields": "false"}).alias("json"))


def base_view(bases: DataFrame) -> DataFrame:
    """A knowledge base in a list: counts without nulls, dates without times, the creation's where nothing changed since."""
    day = lambda c: F.split(iso(c), "T")[0]
    return bases.select("id", "name", F.coalesce("documents", F.lit(0)).alias("documents"), day(F.col("created_at")).alias("created"), day(F.coalesce("changed_at", "created_at")).alias("updated"), F.lit("active").alias("status"))


def document_view(documents: DataFrame) -> DataFrame:
    """A document in a list: its size in MB, its upload time without a fraction, and the label of its state."""
    at = F.regexp_replace(F.replace(iso(F.col("upload_time")), F.lit("T"), F.lit(" ")), r"\.\d+$", "")
    return documents.select(F.col("id").cast("string").alias("id"), "name", megabytes(F.coalesce("file_size", F.lit(0))).alias("size"), at.alias("uploaded"), label(F.col("status"), STATES, "待处理").alias("state"))


def change_view(changes: DataFrame) -> DataFrame:
    """A change in a list: what it puts in place, and why."""
    say = lambda *cs: first_of(*(F.col(c) for c in cs if c in changes.columns))
    return changes.select("id", "type", "original", say("corrected", "improved", "suggestion").alias("proposed"), say("reason", "issue").alias("because"))


def chunk_lines(chunks: DataFrame, content: str = "content") -> DataFrame:
    """A chunk's lines, for a preview."""
    return chunks.withColumn("lines", F.split(content, "\n", -1))


def tables(spark, database: str | None = None) -> DataFrame:
    """Names of the catalog's tables (of a database)."""
    return spark.createDataFrame([(t.name,) for t in spark.catalog.listTables(database)], "name string")


def table_counts(spark, database: str):
    """Names of a database's tables with their numbers of rows."""
    return spark.createDataFrame([(t.name, spark.table(f"`{database}`.`{t.name}`").count()) for t in spark.catalog.listTables(database)], "name string, n bigint")
