"""Text functions over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import chunking, text, views
from marlstone.operators.review import split_paragraphs
from marlstone.plans.base import query
from marlstone.session import table

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(12288)"
PARAGRAPHS = f"""paras AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {BLANKS})), lambda x: x <> '') AS p FROM documents),
p AS (SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS paragraph_index, unnest(p) AS content FROM paras)"""


@query(f"WITH {PARAGRAPHS} SELECT * FROM p")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_paragraphs(table(spark, sf_dir, "documents"))


@query(
    """SELECT doc_id, length(text) AS chars, length(text) // 4 AS tokens, CAST(len(string_split_regex(text, '[。！？]')) AS BIGINT) AS pieces,
CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM documents"""
)
def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("bigint").alias("chars"), text.tokens(t).alias("tokens"), text.sentence_pieces(t).alias("pieces"), text.preview(t).alias("preview"))


@query(
    """SELECT doc_id, CAST(k AS INTEGER) AS chunk_no, substr(text, CAST(k * 800 + 1 AS BIGINT), 1000) AS content
FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(0, CAST(ceil((length(text) - 1000) / 800) AS BIGINT)))) AS k FROM documents WHERE length(text) > 0)"""
)
def chunks_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.fixed(F.col("text"))).alias("chunk_no", "content"))


@query()
def chunks_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.recursive_chunks(table(spark, sf_dir, "documents"))


AGE = "datediff('second', ts, TIMESTAMP '2024-01-31 00:00:00') // 60"


@query(
    f"""SELECT event_id, CASE WHEN {AGE} < 1 THEN 'just now' WHEN {AGE} < 60 THEN ({AGE}) || ' minutes ago'
WHEN {AGE} < 1440 THEN ({AGE}) // 60 || ' hours ago' ELSE ({AGE}) // 1440 || ' days ago' END AS age
FROM (SELECT event_id, date_trunc('second', ts) + CASE WHEN ts > date_trunc('second', ts) THEN INTERVAL 1 SECOND ELSE INTERVAL 0 SECOND END AS ts FROM events)"""
)
def relative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.relative_time(F.col("ts"), F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00"))).alias("age"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ts, '%f') <> '000000' THEN '.' || strftime(ts, '%f') ELSE '' END || 'Z' AS iso FROM events")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.iso(F.col("ts"), "Z").alias("iso"))


@query("SELECT doc_id, CASE WHEN instr(text, 'the') > 0 THEN substr(text, 1, instr(text, 'the') - 1) || 'THE' || substr(text, instr(text, 'the') + 3) ELSE text END AS revised FROM documents")
def replaced_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.replace_first(F.col("text"), F.lit("the"), F.lit("THE")).alias("revised"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE 'other' END AS language, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END, ''), lang) AS shown, printf('%.1f%%', 100.0 * (doc_id % 8) / 8) AS similarity FROM documents")
def labels_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", text.label(F.col("lang"), {"en": "English", "fr": "French"}, "other").alias("language"), text.first_of(source, F.col("lang")).alias("shown"), text.percent((F.col("doc_id") % 8) / 8).alias("similarity"))


@query(
    """SELECT * FROM (VALUES (0, 'a', CAST(1 AS INTEGER)), (0, 'b', 2), (1, 'a', 1), (2, 'c', 3), (3, 'x', 1), (3, 'y', 2), (4, 'z', 9)) t(reply_id, original, id)"""
)
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = [
        '[{"original": "a", "id": 1}, {"original": "b", "id": 2}]',
        '```json\n[{"original": "a", "id": 1}]\n```',
        'I found this: [{"original": "c", "id": 3}] and no more.',
        'First {"original": "x", "id": 1} then {"original": "y", "id": 2}.',
        '{"original": "z", "id": 9}',
        "nothing",
        "[]",
        "{broken} {",
    ]
    rows = spark.createDataFrame(list(enumerate(replies)), "reply_id int, reply string")
    found = F.explode(text.json_records(F.col("reply"), "original string, id int"))
    return rows.select("reply_id", found.alias("c")).select("reply_id", "c.original", "c.id")


@query(
    """SELECT '{"eventId":' || event_id || ',"eventType":"' || event_type || '","userId":' || user_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S')
|| CASE WHEN strftime(ts, '%f') <> '000000' THEN '.' || strftime(ts, '%f') ELSE '' END || 'Z","errorMsg":null}' AS json FROM events"""
)
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("error_msg", F.lit(None).cast("string"))
    return views.json_rows(rows, "event_id", "event_type", "user_id", "ts", "error_msg", mark="Z")


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS name, printf('%.2f MB', o_totalprice * 100 / 1048576.0) AS size, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS uploaded,
CASE o_orderstatus WHEN 'F' THEN '已索引' WHEN 'O' THEN '处理中' ELSE '待处理' END AS state FROM orders"""
)
def document_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "indexed").when(F.col("o_orderstatus") == "O", "processing").otherwise("pending")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), (F.col("o_totalprice") * 100).alias("file_size"), F.col("o_orderdate").alias("upload_time"), status.alias("status"))
    return views.document_view(rows)
