"""Replies, configs, catalog tables and stored chunks, all made from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone import schemas
from marlstone.functions import chunking, text, views
from marlstone.operators import catalog
from marlstone.plans.base import query
from marlstone.plans.texts import BLANKS
from marlstone.session import shared_path, table
from marlstone.sources import sinks


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's reply on each document, in one of the seven forms that replies have."""
    docs = table(spark, sf_dir, "documents")
    change = lambda original, k: F.to_json(F.struct(original.alias("original"), (F.col("doc_id") + k).alias("id"), F.lit("not asked for").alias("more")))
    whole = F.concat(F.lit("["), change(F.col("text"), 0), F.lit(", "), change(F.col("lang"), 1), F.lit("]"))
    lone = F.concat(F.lit("First "), change(F.col("source"), 0), F.lit(" and {broken, then "), change(F.col("lang"), 1), F.lit("."))
    forms = [whole, F.concat(F.lit("```json\n"), whole, F.lit("\n```")), F.concat(F.lit("I found this: "), whole, F.lit(" and no more.")), lone, change(F.col("text"), 0), F.lit("nothing at all"), F.lit("[]")]
    form = F.lit(None).cast("string")
    for k, f in enumerate(forms):
        form = F.when(F.col("doc_id") % len(forms) == k, f).otherwise(form)
    return docs.select("doc_id", form.alias("reply"))


@query(
    """SELECT doc_id, text AS original, CAST(doc_id AS INTEGER) AS id FROM documents WHERE doc_id % 7 IN (0, 1, 2, 4)
UNION ALL SELECT doc_id, lang, CAST(doc_id + 1 AS INTEGER) FROM documents WHERE doc_id % 7 IN (0, 1, 2)
UNION ALL SELECT doc_id, source, CAST(doc_id AS INTEGER) FROM documents WHERE doc_id % 7 = 3"""
)
def reply_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes that replies name, whatever their form; of two lone objects the second is lost where a brace before it opens and never parses."""
    found = F.explode(text.json_records(F.col("reply"), "original string, id int"))
    return _replies(spark, sf_dir).select("doc_id", found.alias("c")).select("doc_id", "c.original", "c.id")


@query(f"SELECT doc_id, trim(text, {BLANKS}) AS body FROM documents")
def reply_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies without their code fence, of four kinds."""
    fence, end = F.lit("```"), F.lit("\n```")
    forms = {0: F.concat(F.lit("```json\n"), "text", end), 1: F.concat(F.lit("  "), "text", F.lit("\n")), 2: F.concat(fence, "text", fence), 3: F.concat(fence, F.lit("\n"), "text")}
    reply = F.col("text")
    for k, f in forms.items():
        reply = F.when(F.col("doc_id") % 4 == k, f).otherwise(reply)
    return table(spark, sf_dir, "documents").select("doc_id", text.unfence(reply).alias("body"))


CONFIGS_SQL = """c AS (SELECT doc_id AS id, 'u' || doc_id % 50 AS user_id, CASE WHEN toxic = 1 THEN 'mmr' ELSE 'similarity' END AS retrieval_method, CAST(doc_id % 9 + 1 AS INTEGER) AS retrieval_k, quality = 1 AND doc_id % 50 < 40 AS is_active,
  TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (doc_id % 100) AS updated_at FROM labels)"""


def _configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configs of fifty users, ten of whom have none that is active; many have several."""
    method = F.when(F.col("toxic") == 1, "mmr").otherwise("similarity")
    at = (F.timestamp_seconds(F.lit(1_704_067_200) + 3600 * (F.col("doc_id") % 100))).cast("timestamp_ntz")
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("u"), (F.col("doc_id") % 50).cast("string")).alias("user_id"), method.alias("retrieval_method"), (F.col("doc_id") % 9 + 1).cast("int").alias("retrieval_k"),
        F.lit(0.5).alias("similarity_threshold"), F.lit(0.7).alias("temperature"), F.lit(2000).alias("max_tokens"), ((F.col("quality") == 1) & (F.col("doc_id") % 50 < 40)).alias("is_active"), at.alias("updated_at"),
    )


@query(f"WITH {CONFIGS_SQL} SELECT retrieval_method, retrieval_k, 0.5::DOUBLE AS similarity_threshold, 0.7::DOUBLE AS temperature, 2000 AS max_tokens FROM c WHERE is_active ORDER BY updated_at DESC, id DESC LIMIT 1")
def latest_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.active_config(_configs(spark, sf_dir), schemas.RAG_DEFAULTS)


@query(
    f"""WITH {CONFIGS_SQL}, l AS (SELECT * FROM c WHERE is_active QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, id DESC) = 1)
SELECT u.user_id, coalesce(l.retrieval_method, 'similarity') AS retrieval_method, coalesce(l.retrieval_k, 4) AS retrieval_k, 0.5::DOUBLE AS similarity_threshold, 0.7::DOUBLE AS temperature, 2000 AS max_tokens
FROM (SELECT DISTINCT user_id FROM c) u LEFT JOIN l USING (user_id)"""
)
def user_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for every user: their latest active config, or the defaults."""
    configs = _configs(spark, sf_dir)
    return catalog.active_configs(configs, configs.select("user_id").distinct(), schemas.RAG_DEFAULTS)


@query(
    """SELECT * FROM (SELECT 'chunks' AS name, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'knowledge_bases', count(DISTINCT source) FROM documents UNION ALL SELECT 'messages', count(*) FROM conversations
UNION ALL SELECT 'monitor_logs', count(*) FROM events UNION ALL SELECT 'rag_configs', count(*) FROM labels UNION ALL SELECT 'review_tasks', CAST(0 AS BIGINT) UNION ALL SELECT 'sessions', count(DISTINCT conv_id) FROM conversations)"""
)
def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every table of a catalog that was made, filled and made again, which changes nothing."""
    database = "marlstone_" + shared_path(spark).rpartition("/")[2]
    read = lambda name: table(spark, sf_dir, name)
    docs, turns = read("documents"), read("conversations")
    filled = {
        "documents": docs.select(F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("n_chars").alias("file_size")),
        "knowledge_bases": docs.groupBy(F.col("source").alias("name")).agg(F.min("doc_id").alias("id")).where("name IS NOT NULL"),
        "messages": turns.select(F.col("conv_id").alias("session_id"), "role", F.col("text").alias("content")),
        "monitor_logs": read("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("module")),
        "rag_configs": _configs(spark, sf_dir),
        "sessions": turns.select(F.col("conv_id").alias("id")).distinct(),
    }
    spark.sql(f"CREATE DATABASE {database}")
    try:
        folder = shared_path(spark)
        sinks.create_tables(spark, folder, schemas.BY_NAME, database)
        for name, rows in filled.items():
            sinks.fill(rows, f"{database}.{name}")
        sinks.create_tables(spark, folder, schemas.BY_NAME, database)
        return views.table_counts(spark, database)
    finally:
        spark.sql(f"DROP DATABASE {database} CASCADE")


PIECES_SQL = "c AS (SELECT CAST(doc_id % 5 AS INTEGER) AS kb_id, doc_id, CAST(k AS INTEGER) AS chunk_no, substr(text, 1 + 400 * k, 500) AS content FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(0, (length(text) - 101) // 400))) AS k FROM documents WHERE length(text) > 0))"


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in overlapping chunks."""
    docs = table(spark, sf_dir, "documents").withColumn("kb_id", (F.col("doc_id") % 5).cast("int"))
    return docs.select("kb_id", "doc_id", F.posexplode(chunking.fixed(F.col("text"), 500, 100)).alias("chunk_no", "content"))


@query(f"WITH {PIECES_SQL} SELECT kb_id, doc_id, chunk_no, content FROM c WHERE kb_id = 2")
def stored_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of one base, read back from its partition."""
    path = shared_path(spark)
    sinks.append_chunks(_pieces(spark, sf_dir), path)
    return sinks.read_chunks(spark, path, kb_id=2).select("kb_id", "doc_id", "chunk_no", "content")


@query(f"WITH {PIECES_SQL} SELECT kb_id, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS chars FROM c WHERE kb_id <> 3 GROUP BY kb_id")
def dropped_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark)
    sinks.append_chunks(_pieces(spark, sf_dir), path)
    sinks.drop_collection(spark, path, 3)
    return sinks.read_chunks(spark, path).groupBy("kb_id").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"))
