"""Flows of the product: chats over a knowledge base, comparisons with rules, tasks, lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text, views
from marlstone.models import complete
from marlstone.operators import catalog, chat, retrieval, review, usage
from marlstone.plans import usage as usage_plans
from marlstone.plans.base import query
from marlstone.plans.retrieval import D2
from marlstone.plans.review import CHANGES_SQL, PAIRS, REPLACE, _changes, _paragraphs
from marlstone.plans.texts import PARAGRAPHS
from marlstone.session import table


def _hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    hits = retrieval.top_k_each(rows.where("vec_id % 20 = 0"), rows, k)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source", "text")
    return hits.join(docs, "vec_id")


def hits_sql(k: int, where: str = "a.vec_id % 20 = 0") -> str:
    return f"""hits AS (SELECT query_id, rank, source, text FROM (SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {D2}, b.vec_id) AS rank
  FROM embeddings a, embeddings b WHERE {where}) JOIN documents ON doc_id = vec_id WHERE rank <= {k})"""


CITED = "'[文档' || rank || ': ' || source || ', 第0页]' || chr(10) || text"


def _whole(hits: DataFrame) -> DataFrame:
    return retrieval.context(hits, retrieval.cited(F.col("rank"), F.col("source"), F.lit(None).cast("int"), F.col("text")), ["query_id"])


@query(f"WITH {hits_sql(5)} SELECT query_id, string_agg({CITED}, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS retrieved_count FROM hits GROUP BY query_id")
def rag_context_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole passages, as an answer is generated from them."""
    return _whole(_hits(spark, sf_dir, 5))


@query(
    f"""WITH {hits_sql(6)}, c AS (SELECT query_id, string_agg({CITED}, chr(10) || chr(10) ORDER BY rank) AS context FROM hits GROUP BY query_id),
m AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
h AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM m WHERE turn < last AND role IN ('user', 'assistant') GROUP BY conv_id),
q AS (SELECT conv_id, text AS question FROM m WHERE turn = last)
SELECT conv_id, CASE WHEN conv_id % 40 = 0 THEN coalesce(context, '') || CASE WHEN history IS NULL THEN chr(10) || chr(10) ELSE chr(10) || chr(10) || history || chr(10) || chr(10) END || 'Question: ' || question END AS prompt,
  CASE WHEN conv_id % 40 > 0 THEN '错误：使用RAG模式时必须指定知识库ID' END AS message
FROM q LEFT JOIN h USING (conv_id) LEFT JOIN c ON query_id = conv_id"""
)
def retrieval_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the model is asked in chats over a base: six passages, the history, the last question; a message without a base."""
    messages = table(spark, sf_dir, "conversations")
    last = messages.groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"))
    sessions = last.withColumn("kb_id", F.when(F.col("conv_id") % 40 == 0, F.lit(1)))
    turns = chat.history(messages).select("conv_id", F.col("turn").alias("order"), "role", "text")
    contexts = _whole(_hits(spark, sf_dir, 6)).withColumnRenamed("query_id", "conv_id")
    return retrieval.chat_prompts(sessions, turns, contexts, "conv_id", "kb_id").select("conv_id", "prompt", "message")


@query(
    f"""WITH {hits_sql(5)}, c AS (SELECT query_id, string_agg({CITED}, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS retrieved_count FROM hits GROUP BY query_id),
q AS (SELECT doc_id, CAST(1 AS INTEGER) AS id, 'size of ' || lang AS question FROM documents WHERE doc_id % 20 = 0 AND doc_id % 3 <> 0
  UNION ALL SELECT doc_id, CAST(2 AS INTEGER), 'origin ' || source FROM documents WHERE doc_id % 20 = 0 AND doc_id % 3 <> 0
  UNION ALL SELECT doc_id, CAST(1 AS INTEGER), text FROM documents WHERE doc_id % 20 = 0 AND doc_id % 3 = 0)
SELECT doc_id, id, context || chr(10) || chr(10) || 'Question: ' || question AS prompt, coalesce(retrieved_count, 0) AS retrieved_count FROM q LEFT JOIN c ON query_id = doc_id"""
)
def agentic_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that a reply lists (the whole document where it is no JSON), each with five passages and ready for an answer."""
    docs = table(spark, sf_dir, "documents").where("doc_id % 20 = 0")
    one = lambda k, q: F.struct(F.lit(k).alias("id"), F.lit("t").alias("title"), q.alias("question"))
    listed = F.to_json(F.struct(F.array(one(1, F.concat(F.lit("size of "), "lang")), one(2, F.concat(F.lit("origin "), "source"))).alias("questions")))
    replies = docs.select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "no list").otherwise(listed).alias("reply"))
    questions = retrieval.questions_of(replies, "doc_id", "reply", "text")
    contexts = _whole(_hits(spark, sf_dir, 5)).withColumnRenamed("query_id", "doc_id")
    met = questions.join(contexts, "doc_id", "left")
    return met.select("doc_id", "id", F.concat("context", F.lit("\n\nQuestion: "), "question").alias("prompt"), F.coalesce("retrieved_count", F.lit(0)).alias("retrieved_count"))


class _Unsteady:
    """A client that fails on long prompts."""

    def complete(self, prompt: str) -> str:
        if len(prompt) > 200:
            raise ValueError(f"{len(prompt)} characters")
        return f"ok {prompt}"


@query("SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN 'Error: ' || length(text) || ' characters' ELSE 'ok ' || text END AS reply FROM conversations WHERE role = 'user'")
def chat_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A failed call says so in the reply; the others stand."""
    users = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    return complete(users, "text", "reply", _Unsteady, say_errors=True).drop("text")


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold which benchmark items, letter for letter."""
    return review.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


STATED = "(ersion|ISO|RFC) ([0-9]+(?:\\.[0-9]+)?)"


@query(
    f"""WITH s AS (SELECT DISTINCT doc_id, term, CAST(value AS DOUBLE) AS value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{STATED}', 1)) AS term, unnest(regexp_extract_all(text, '{STATED}', 2)) AS value FROM documents)),
m AS (SELECT doc_id, printf('%s %.2f', s.term, r.value) AS requirement, printf('%s %.2f', s.term, s.value) AS passage, printf('%.2f', s.value - r.value) AS mismatch
  FROM s JOIN (VALUES ('ersion', 1.5::DOUBLE), ('ersion', 2.0::DOUBLE)) r(term, value) ON s.term = r.term WHERE s.value <> r.value)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY requirement, passage) AS INTEGER) AS no, requirement, passage, mismatch, 'state ' || requirement AS suggestion FROM m"""
)
def rule_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered table of what documents state otherwise than two rules."""
    rules = spark.createDataFrame([("ersion", 1.5), ("ersion", 2.0)], "term string, value double")
    return review.compared(review.stated(table(spark, sf_dir, "documents"), "doc_id", "text", STATED), rules, "doc_id")


@query(f"WITH {PARAGRAPHS} SELECT doc_id, paragraph_index, original, improved, 'glossary' AS reason FROM p, (VALUES ('trash', 'refuse'), ('idiot', 'person')) t(original, improved) WHERE contains(content, original)")
def glossary_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.glossary(_paragraphs(spark, sf_dir), {"trash": "refuse", "idiot": "person"})


@query(
    f"""WITH {PARAGRAPHS}, v AS (SELECT doc_id, paragraph_index, CAST(unnest(regexp_extract_all(content, 'ersion ([0-9]+(?:\\.[0-9]+)?)', 1)) AS DOUBLE) AS value FROM p)
SELECT *, r AS relation FROM v, (VALUES ('<'), ('<='), ('>'), ('>=')) t(r) WHERE NOT CASE r WHEN '<' THEN value < 2.0 WHEN '<=' THEN value <= 2.0 WHEN '>' THEN value > 2.0 ELSE value >= 2.0 END""".replace("SELECT *, r AS relation", "SELECT doc_id, paragraph_index, value, r AS relation")
)
def limit_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers at a limit that may be reached, and at one that may not."""
    paras = _paragraphs(spark, sf_dir)
    out = None
    for relation in ("<", "<=", ">", ">="):
        part = review.relations(paras, r"ersion ([0-9]+(?:\.[0-9]+)?)", relation, 2.0).withColumn("relation", F.lit(relation))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    CHANGES_SQL
    + """ SELECT doc_id, text AS original_content, text AS revised_content, coalesce(total_changes, 0) AS total_changes, coalesce(typo_count, 0) AS typo_count, CAST(0 AS BIGINT) AS fluency_count,
coalesce(duplicate_count, 0) AS duplicate_count, coalesce(compliance_count, 0) AS compliance_count FROM documents LEFT JOIN (SELECT doc_id, count(*) AS total_changes,
count(*) FILTER (type = 'typo') AS typo_count, count(*) FILTER (type = 'duplicate') AS duplicate_count, count(*) FILTER (type = 'compliance') AS compliance_count FROM c GROUP BY doc_id) USING (doc_id)"""
)
def review_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.result(table(spark, sf_dir, "documents"), _changes(spark, sf_dir))


@query("SELECT count(*) FILTER (v = 0) AS serious, count(*) FILTER (v = 1) AS warnings, count(*) FILTER (v = 2) AS advice FROM (SELECT doc_id % 5 AS v FROM labels)")
def issue_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(v) for v in ("严重", "警告", "建议", "其他", "无")))
    return review.levels(table(spark, sf_dir, "labels").select(F.get(names, (F.col("doc_id") % 5).cast("int")).alias("level")))


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    status = F.when(k % 4 == 0, "completed").when(k % 4 == 1, "processing").when(k % 4 == 2, "failed").otherwise(F.lit(None).cast("string"))
    result = F.when(k % 8 == 0, F.concat(F.lit('{"typo_count": '), k.cast("string"), F.lit("}"))).when(k % 8 == 4, "")
    return table(spark, sf_dir, "labels").select(k.cast("string").alias("task_id"), status.alias("status"), (k % 101).cast("int").alias("progress"), result.alias("result"), F.when(k % 3 == 0, "broke").alias("error_msg"))


@query(
    """WITH t AS (SELECT doc_id AS k, CASE doc_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed' END AS status FROM labels)
SELECT CAST(k AS VARCHAR) AS task_id, status, CAST(k % 101 AS INTEGER) AS progress, CAST(CASE WHEN k % 8 = 0 THEN k END AS INTEGER) AS typo_count, CASE WHEN k % 4 = 2 AND k % 3 = 0 THEN 'broke' END AS error,
  CAST(CASE WHEN k % 101 >= 100 THEN 4 WHEN k % 101 >= 75 THEN 3 WHEN k % 101 >= 50 THEN 2 WHEN k % 101 >= 25 THEN 1 ELSE 0 END AS INTEGER) AS step,
  CASE WHEN status IS NULL THEN '404' WHEN status = 'processing' THEN 'already processing' ELSE 'started' END AS analysis,
  CASE WHEN status IS NULL THEN '404' WHEN status <> 'completed' THEN '400 not completed' WHEN k % 8 <> 0 THEN '400 no result' ELSE '200' END AS application FROM t"""
)
def task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tasks show, their step, and what requests on them get."""
    tasks = _tasks(spark, sf_dir)
    asked = tasks.select("task_id", review.step_of(F.col("progress")).alias("step"), review.analysis_state(F.col("status")).alias("analysis"), review.apply_state(F.col("status"), F.col("result")).alias("application"))
    shown = review.result_view(tasks, "typo_count INT").select("task_id", "status", "progress", F.col("result.typo_count").alias("typo_count"), "error")
    return shown.join(asked, "task_id")


@query("SELECT k AS doc_id, lang, CAST(CASE WHEN lang IS NULL THEN 404 ELSE 200 END AS INTEGER) AS code FROM (VALUES (CAST(0 AS BIGINT)), (5), (-1), (123456789)) t(k) LEFT JOIN documents d ON d.doc_id = k")
def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([(0,), (5,), (-1,), (123456789,), (5,)], "doc_id long")
    return catalog.lookup(table(spark, sf_dir, "documents").select("doc_id", "lang"), wanted, "doc_id")


@query("SELECT source, count(*) FILTER (doc_id % 7 = 0) AS deleted, count(*) FILTER (doc_id % 7 <> 0) AS kept FROM documents GROUP BY source")
def delete_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.deleted_counts(table(spark, sf_dir, "documents").select("source", "doc_id"), F.col("doc_id") % 7 == 0, "source")


@query(
    """SELECT source, count(doc_id) AS documents, CAST(coalesce(sum(n), 0) AS BIGINT) AS chunks FROM (VALUES ('src1'), ('src2'), ('no such base')) g(source)
LEFT JOIN (SELECT source, doc_id, len(string_split(text, chr(10))) AS n FROM documents) USING (source) GROUP BY source"""
)
def base_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    gone = spark.createDataFrame([("src1",), ("src2",), ("no such base",)], "source string")
    return catalog.base_deletion(docs.select("source", "doc_id"), chunks, gone, "source", "doc_id")


@query(
    """SELECT o_orderkey AS doc_id, o_custkey AS kb_id, c_name AS base, l_quantity AS quantity FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 300000 AND c_acctbal > 0"""
)
def chunks_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents, customers as bases, lines as chunks."""
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("kb_id"))
    bases = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("kb_id"), F.col("c_name").alias("base"))
    keyed = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_quantity").alias("quantity")).join(orders, "doc_id")
    return catalog.located_chunks(orders, bases, keyed)


@query(
    """SELECT o_orderkey AS id, o_orderdate AS upload_time, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS place FROM orders) WHERE place <= 50"""
)
def latest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.latest(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("upload_time")), "upload_time", "id", 50)


BASES_SQL = """b AS (SELECT c_custkey AS id, c_name AS name, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (c_custkey % 500) AS created_at FROM customer),
d AS (SELECT o_custkey AS kb_id, count(*) AS documents, CAST(sum(o_orderkey) AS BIGINT) AS bytes, max(o_orderdate) AS changed_at FROM orders WHERE o_totalprice > 250000 GROUP BY o_custkey)"""


@query(
    f"""WITH {BASES_SQL} SELECT id, name, coalesce(documents, 0) AS documents, strftime(created_at, '%Y-%m-%d') AS created, strftime(coalesce(changed_at, created_at), '%Y-%m-%d') AS updated, 'active' AS status
FROM b LEFT JOIN d ON kb_id = id"""
)
def base_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge bases as a list shows them, the latest first."""
    created = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, cast(c_custkey % 500 as int))")
    bases = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), created.alias("created_at"))
    docs = table(spark, sf_dir, "orders").where("o_totalprice > 250000").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("kb_id"), F.col("o_orderkey").alias("file_size"), F.lit(None).cast("timestamp_ntz").alias("indexed_time"), F.col("o_orderdate").alias("upload_time"))
    return views.base_view(catalog.kb_rollup(bases, docs))


@query(
    """WITH s AS (SELECT conv_id AS id, count(*) AS updated_at, 'u' || (conv_id % 3) AS user_id FROM conversations GROUP BY conv_id) SELECT id, user_id, updated_at FROM s WHERE user_id = 'u1'"""
)
def owner_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An owner's sessions, those of the latest change first."""
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("updated_at"))
    return chat.sessions_by_change(rows.withColumn("user_id", F.concat(F.lit("u"), (F.col("id") % 3).cast("string"))), "u1").select("id", "user_id", "updated_at")


@query(usage_plans.LOGS + ", h AS (SELECT strftime(timestamp, '%Y-%m-%d %H:00') AS hour, count(id) AS calls, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens FROM logs GROUP BY 1) SELECT *, CAST(row_number() OVER (ORDER BY hour) AS INTEGER) AS place FROM h")
def trend_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.in_order(usage.trend(usage_plans.logs(spark, sf_dir)))


@query(
    """SELECT 'm' || (conv_id % 4) AS module, CAST(coalesce(sum(length(text) // 4) FILTER (role <> 'assistant'), 0) AS BIGINT) AS input, CAST(coalesce(sum(length(text) // 4) FILTER (role = 'assistant'), 0) AS BIGINT) AS output
FROM conversations GROUP BY 1"""
)
def tokens_in_and_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("module", F.concat(F.lit("m"), (F.col("conv_id") % 4).cast("string")))
    return usage.in_and_out(rows, "module", text.tokens(F.col("text")), F.col("role") != "assistant")


@query(
    f"""SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, 0.9::DOUBLE AS similarity, CAST(CASE WHEN vec_id % 3 = 0 THEN rank ELSE vec_id % 7 END AS INTEGER) AS page
FROM (SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {D2}, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) WHERE rank <= 4"""
)
def scored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of one fixed score, and their pages: those that have none take their rank."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    hits = retrieval.fixed_score(retrieval.top_k_each(rows.where("vec_id % 20 = 0"), rows, 4))
    page = F.when(F.col("vec_id") % 3 != 0, F.col("vec_id") % 7)
    return hits.select("query_id", "vec_id", "rank", "similarity", retrieval.numbered_page(page, F.col("rank")).alias("page"))


HEX = "(strpos('0123456789abcdef', substr(h, 17, 1)) - 1)"


@query(f"SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || substr('89ab', CAST({HEX} % 4 + 1 AS BIGINT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents)")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.identifier(F.col("doc_id")).alias("id"))


@query("SELECT doc_id, replace(text, ' ', '') AS bare FROM documents")
def without_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.without_spaces(F.col("text")).alias("bare"))


@query(
    """SELECT doc_id, CAST(k // 51 AS INTEGER) AS page, CAST(800 - 15 * (k % 51) AS INTEGER) AS y, substr(l[k + 1], 1, 80) AS line FROM (SELECT doc_id, l, unnest(generate_series(0, len(l) - 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""
)
def printed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(text.printed(F.col("text"))).alias("p")).select("doc_id", "p.*")


@query("SELECT * FROM (VALUES (0, '[1]'), (1, '[1]'), (2, '{}'), (3, 'plain'), (4, '')) t(reply_id, body)")
def unfenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(["```json\n[1]\n```", " [1] ", "```\n{}```", "plain", "``````"])), "reply_id int, reply string")
    return rows.select("reply_id", text.unfence(F.col("reply")).alias("body"))


@query("SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, string_split(text, chr(10))[1] AS first_line FROM documents")
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.chunk_lines(table(spark, sf_dir, "documents"), "text")
    return lines.select("doc_id", F.size("lines").cast("bigint").alias("n_lines"), F.get("lines", F.lit(0)).alias("first_line"))


@query(CHANGES_SQL + " SELECT id, type, original, nullif(corrected, '') AS proposed, CAST(NULL AS VARCHAR) AS because, doc_id FROM c")
def change_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes as a list shows them."""
    changes = _changes(spark, sf_dir).withColumn("reason", F.lit(None).cast("string")).withColumn("type", F.struct("type", "doc_id"))
    return views.change_view(changes).select("id", F.col("type.type").alias("type"), "original", "proposed", "because", F.col("type.doc_id").alias("doc_id"))


@query(
    CHANGES_SQL
    + f""", n AS (SELECT doc_id, count(*) AS total_issues, count(*) FILTER (type = 'compliance') AS severe_issues, count(*) FILTER (type = 'typo') AS warning_issues, count(*) FILTER (type = 'duplicate') AS suggestion_issues FROM c GROUP BY doc_id),
r AS (SELECT doc_id, CAST(sum(n - 1) AS BIGINT) AS dependencies FROM (SELECT doc_id, original, count(DISTINCT paragraph_index) AS n FROM c GROUP BY doc_id, original) GROUP BY doc_id),
a AS (SELECT doc_id, {REPLACE.format("text", "stupid", "unwise", 6)} AS t1 FROM documents), b AS (SELECT doc_id, {REPLACE.format("t1", "worthless", "poor", 9)} AS revised_content FROM a)
SELECT doc_id, revised_content, substr(revised_content, 1, 500) AS summary, coalesce(total_issues, 0) AS total_issues, coalesce(severe_issues, 0) AS severe_issues, coalesce(warning_issues, 0) AS warning_issues,
  coalesce(suggestion_issues, 0) AS suggestion_issues, coalesce(dependencies, 0) AS dependencies, coalesce(severe_issues, 0) = 0 AS is_compliant FROM b LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id)"""
)
def final_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.final_report(table(spark, sf_dir, "documents"), _changes(spark, sf_dir), PAIRS)
