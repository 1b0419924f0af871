"""Retrieval over the embeddings table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.models import RuleModel, complete
from marlstone.operators import retrieval
from marlstone.plans.base import query
from marlstone.session import table

D2 = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))"
EACH = f"""hits AS (SELECT a.vec_id AS query_id, b.vec_id, round({D2}, 6) AS distance2, row_number() OVER (PARTITION BY a.vec_id ORDER BY {D2}, b.vec_id) AS rank
  FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)"""


def _vector(rows: DataFrame, vec_id: int) -> list[float]:
    """One vector: a query that a user brings."""
    return rows.where(F.col("vec_id") == vec_id).first()["embedding"]


@query(f"SELECT b.vec_id, b.label, round({D2}, 6) AS distance2 FROM embeddings a, embeddings b WHERE a.vec_id = 7 AND b.label = 3 ORDER BY {D2}, b.vec_id LIMIT 6")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    hits = retrieval.top_k(rows.where("label = 3"), _vector(rows, 7), 6)
    return hits.select("vec_id", "label", F.round("distance2", 6).alias("distance2"))


@query(f"WITH {EACH} SELECT query_id, vec_id, distance2, CAST(rank AS INTEGER) AS rank FROM hits WHERE rank <= 5")
def knn_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    hits = retrieval.top_k_each(rows.where("vec_id % 20 = 0"), rows, 5)
    return hits.select("query_id", "vec_id", F.round("distance2", 6).alias("distance2"), "rank")


@query(
    f"""WITH h AS (SELECT b.vec_id, {D2} AS d FROM embeddings a, embeddings b WHERE a.vec_id = 7 ORDER BY d, b.vec_id LIMIT 5),
r AS (SELECT vec_id, d, row_number() OVER (ORDER BY d, vec_id) AS rank FROM h)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, round(0.95 - 0.05 * (rank - 1), 2)::DOUBLE AS similarity, round(1 - d / 2, 6) AS cosine FROM r WHERE 1 - d / 2 >= 0.1"""
)
def rag_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    hits = retrieval.ranked(retrieval.top_k(rows, _vector(rows, 7), 5), ["distance2", "vec_id"], threshold=0.1)
    return hits.select("vec_id", "rank", "similarity", F.round("cosine", 6).alias("cosine"))


def _cited(spark: SparkSession, sf_dir: str, k: int = 5, text: Column | str = "text") -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    hits = retrieval.top_k_each(rows.where("vec_id % 20 = 0"), rows, k)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source", (F.col(text) if isinstance(text, str) else text).alias("text"))
    return hits.join(docs, "vec_id")


@query(
    f"""WITH {EACH} SELECT query_id, string_agg('[文档' || rank || ': ' || source || ', 第0页]' || chr(10) || substr(text, 1, 400), chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS retrieved_count
FROM hits JOIN documents ON doc_id = vec_id WHERE rank <= 5 GROUP BY query_id"""
)
def rag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = retrieval.cited(F.col("rank"), F.col("source"), F.lit(None).cast("int"), F.col("text"))
    return retrieval.context(_cited(spark, sf_dir, 5, F.substring("text", 1, 400)), part, ["query_id"])


@query(
    f"""WITH {EACH} SELECT query_id, string_agg('【参考规程' || rank || '】' || chr(10) || substr(text, 1, 300), chr(10) || chr(10) ORDER BY rank) AS regulations,
string_agg('[' || rank || '] ' || source || ' 第0页:' || chr(10) || substr(text, 1, 200), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS listed
FROM hits JOIN documents ON doc_id = vec_id WHERE rank <= 3 GROUP BY query_id"""
)
def rag_context_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    # both forms take a text's beginning, in one pass over the hits
    hits = _cited(spark, sf_dir, 3, F.substring("text", 1, 300))
    regulations, listed = retrieval.regulation(F.col("rank"), F.col("text")), retrieval.listed(F.col("rank"), F.col("source"), F.lit(None).cast("int"), F.col("text"))
    forms = hits.select("query_id", "rank", regulations.alias("regulations"), listed.alias("listed"))
    return retrieval.contexts(forms, ["query_id"], {"regulations": retrieval.BLANK_LINE, "listed": retrieval.RULE})


@query()
def rag_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = retrieval.cited(F.col("rank"), F.col("source"), F.lit(None).cast("int"), F.col("text"))
    contexts = retrieval.context(_cited(spark, sf_dir), whole, ["query_id"]).withColumnRenamed("query_id", "doc_id")
    questions = table(spark, sf_dir, "documents").where("doc_id % 20 = 0").select("doc_id", F.col("text").alias("question"))
    return retrieval.answered(questions, contexts, "doc_id", "question")


@query()
def chat_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    return complete(users, "prompt", "reply", RuleModel)
