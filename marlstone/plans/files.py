"""Files and stores: documents written as files, tables and streams, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone import schemas
from marlstone.functions import views
from marlstone.plans import usage
from marlstone.plans.base import query
from marlstone.plans.texts import BLANKS
from marlstone.session import shared_path, table
from marlstone.sources import files, sinks
from marlstone.streaming import usage as streams

#: Lines of a file that lands: a file is read whole, so its size must not grow with the corpus.
LINES = 20_000
NON_BLANK = f"array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x, {BLANKS}) <> ''), chr(10))"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files by their id: text, Word, and a type that nothing reads."""
    docs = table(spark, sf_dir, "documents")
    word = sinks.word_files(docs.where("doc_id % 3 = 1"), "doc_id", "text").select("doc_id", F.lit("docx").alias("kind"), "content")
    others = docs.where("doc_id % 3 <> 1").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "TXT").otherwise("xyz").alias("kind"), F.encode("text", "UTF-8").alias("content"))
    return word.unionByName(others).select(F.concat(F.lit("/kb/f"), F.col("doc_id").cast("string"), F.lit("."), "kind").alias("path"), "content")


@query(
    f"""SELECT 'f' || doc_id || '.' || k AS filename, lower(k) AS file_type, CAST(0 AS INTEGER) AS page, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN {NON_BLANK} END AS content,
CASE WHEN doc_id % 3 < 2 THEN 'indexed' ELSE 'failed' END AS status, CASE WHEN doc_id % 3 = 2 THEN 'Unsupported file format' END AS error
FROM (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN 'TXT' WHEN 1 THEN 'docx' ELSE 'xyz' END AS k FROM documents)"""
)
def file_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.load(_files(spark, sf_dir)).select("filename", "file_type", "page", "content", "status", "error")


@query(
    f"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'indexed' END AS status, CASE WHEN doc_id % 5 = 0 THEN '文档内容为空' END AS error,
CASE WHEN doc_id % 5 > 0 THEN {NON_BLANK} END AS content FROM documents"""
)
def review_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review takes no Word file without text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "  \n\t").otherwise(F.col("text")).alias("text"))
    word = sinks.word_files(docs, "doc_id", "text").select(F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), "content")
    return files.load(word, need_text=True).select(F.regexp_extract("path", r"^(\d+)", 1).cast("bigint").alias("doc_id"), "status", "error", "content")


@query(
    """SELECT doc_id, CAST(k AS INTEGER) AS page, array_to_string(l[20 * k + 1:20 * k + 20], chr(10)) AS content
FROM (SELECT doc_id, l, unnest(range(0, greatest(1, CAST(ceil(len(l) / 20) AS BIGINT)))) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""
)
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as PDF files of twenty lines a page, read page by page; a file is drawn where it is read, one at a time."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), F.col("text").alias("content"))

    def drawn(text):
        lines = text.split("\n")
        return files.pdf_pages(files.pdf_of(["\n".join(lines[k : k + 20]) for k in range(0, len(lines), 20)]))

    return files.load(docs, {"pdf": drawn}).select(F.regexp_extract("path", r"^(\d+)", 1).cast("bigint").alias("doc_id"), "page", "content")


@query("SELECT doc_id, text || chr(10) AS content FROM documents")
def word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word files read with their empty paragraphs kept."""
    word = sinks.word_files(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), "content")
    units = files.load(word, {"docx": lambda c: [files.docx_lines(c)]})
    return units.select(F.regexp_extract("path", r"^(\d+)", 1).cast("bigint").alias("doc_id"), "content")


@query("SELECT 'f' || doc_id AS filename, substr(text, 1, 300) || substr(text, 301, 300) || substr(text, 601) AS content FROM documents")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages put together in order, with nothing between."""
    cut = lambda k, *at: F.struct(F.lit(k).alias("page"), F.substr("text", *map(F.lit, at)).alias("content"))
    pages = F.explode(F.array(cut(2, 601), cut(0, 1, 300), cut(1, 301, 300))).alias("u")
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    units = table(spark, sf_dir, "documents").select(F.concat(F.lit("/kb/"), name).alias("path"), name.alias("filename"), pages).select("path", "filename", "u.*")
    return files.whole_text(units).select("filename", "content")


@query(
    """SELECT list_last(string_split(folder, '/')) AS directory, folder, count(*) AS files, CAST(sum(n) AS BIGINT) AS bytes
FROM (SELECT '/' || CASE WHEN page_id % 2 = 0 THEN 'a' ELSE 'b' END || '/x' || (page_id % 4) AS folder, length(url) AS n FROM pages) GROUP BY folder"""
)
def folder_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of one name below different ones are told apart."""
    folder = F.concat(F.lit("/"), F.when(F.col("page_id") % 2 == 0, "a").otherwise("b"), F.lit("/x"), (F.col("page_id") % 4).cast("string"))
    return files.directory_sizes(table(spark, sf_dir, "pages").select(F.concat(folder, F.lit("/f"), F.col("page_id").cast("string")).alias("path"), F.length("url").alias("length")))


@query(
    """WITH f AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'image/png' END AS media_type, page_id * 100000 AS length,
'f' || page_id || CASE page_id % 3 WHEN 0 THEN '.docx' WHEN 1 THEN '.DOCX' ELSE '.doc' END AS filename FROM pages)
SELECT page_id, filename FROM f WHERE media_type IN ('application/pdf', 'text/plain') AND length < 10 * 1024 * 1024 AND (filename LIKE '%.docx' OR filename LIKE '%.doc')"""
)
def upload_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    media = F.when(k % 4 == 0, "application/pdf").when(k % 4 == 1, "text/plain").when(k % 4 == 2, "image/png")
    name = F.concat(F.lit("f"), k.cast("string"), F.when(k % 3 == 0, ".docx").when(k % 3 == 1, ".DOCX").otherwise(".doc"))
    offered = table(spark, sf_dir, "pages").select("page_id", media.alias("media_type"), (k * 100_000).alias("length"), name.alias("filename"))
    return files.reviewable(files.uploadable(offered)).select("page_id", "filename")


@query("SELECT source, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars, true AS dated FROM (SELECT source, unnest(string_split(text, chr(10))) AS text FROM documents) GROUP BY source")
def landed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that land in a folder, read whole, with the time of each."""
    path = shared_path(spark)
    table(spark, sf_dir, "documents").select("source", F.explode(F.split("text", "\n", -1)).alias("value")).write.partitionBy("source").option("lineSep", "\n").option("maxRecordsPerFile", LINES).text(path)
    found = files.listing(spark, path).select(F.regexp_replace("path", r"^.*/source=([^/]*)/.*$", "$1.txt").alias("path"), "modificationTime", "content")
    units = files.load(found).select(F.regexp_replace("filename", r"\.txt$", "").alias("source"), "upload_time", F.explode(F.split(F.regexp_replace("content", "\n$", ""), "\n", -1)).alias("line"))
    return units.groupBy("source").agg(F.count("*").alias("lines"), F.sum(F.length("line")).cast("bigint").alias("chars"), F.bool_and(F.col("upload_time").cast("double") > 0).alias("dated"))


@query("SELECT doc_id, lang, n_chars FROM documents")
def report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark)
    sinks.report_csv(table(spark, sf_dir, "documents"), path, ["n_chars", "doc_id", "lang"])
    return spark.read.option("header", True).schema("n_chars bigint, doc_id bigint, lang string").csv(path)


@query("SELECT doc_id, text, source FROM documents")
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark)
    sinks.report_json(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), path)
    return spark.read.schema("doc_id bigint, text string, source string").json(path)


@query("SELECT value, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS value FROM documents) GROUP BY value")
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark)
    sinks.report_text(table(spark, sf_dir, "documents"), "text", path)
    return spark.read.option("lineSep", "\n").text(path).groupBy("value").agg(F.count("*").alias("n"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.posexplode(F.array(F.substring("text", 1, 40), F.substring("text", 41, 40), F.substring("text", 81, 40))).alias("chunk_no", "content")
    return table(spark, sf_dir, "documents").select((F.col("doc_id") % 5).cast("int").alias("kb_id"), "doc_id", cut)


CHUNKS_SQL = "c AS (SELECT CAST(doc_id % 5 AS INTEGER) AS kb_id, doc_id, CAST(k AS INTEGER) AS chunk_no, substr(text, 1 + 40 * k, 40) AS content FROM documents, (VALUES (CAST(0 AS BIGINT)), (1), (2)) t(k))"


@query(f"WITH {CHUNKS_SQL} SELECT kb_id, doc_id, chunk_no, content FROM c WHERE kb_id = 2 AND doc_id = 7 ORDER BY chunk_no LIMIT 2")
def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark)
    sinks.append_chunks(_chunks(spark, sf_dir), path)
    return sinks.read_chunks(spark, path, kb_id=2, doc_id=7, limit=2).select("kb_id", "doc_id", "chunk_no", "content")


@query(f"WITH {CHUNKS_SQL} SELECT kb_id, count(*) AS chunks FROM c WHERE kb_id <> 3 GROUP BY kb_id")
def dropped_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark)
    sinks.append_chunks(_chunks(spark, sf_dir), path)
    sinks.drop_collection(spark, path, 3)
    return sinks.read_chunks(spark, path).groupBy("kb_id").agg(F.count("*").alias("chunks"))


WORDS_SQL = """w AS (SELECT item_id, ('0x' || substr(md5(word), 1, 8))::BIGINT AS h FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM benchmark)),
b AS (SELECT item_id, h % 64 AS bucket, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS v FROM w GROUP BY ALL),
n AS (SELECT item_id, sqrt(sum(v * v)) AS norm FROM b GROUP BY item_id)"""


@query(f"WITH {WORDS_SQL} SELECT item_id, CAST(bucket AS INTEGER) AS bucket, round(v / norm, 4) AS weight FROM b JOIN n USING (item_id) WHERE v <> 0")
def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are written with their chunks."""
    path = shared_path(spark)
    chunks = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 3).cast("int").alias("kb_id"), "item_id", "text")
    sinks.append_chunks(chunks, path, embed="text")
    each = sinks.read_chunks(spark, path).select("item_id", F.posexplode("embedding").alias("bucket", "weight"))
    return each.where("weight <> 0").select("item_id", "bucket", F.round(F.col("weight").cast("double"), 4).alias("weight"))


@query("SELECT unnest(['documents', 'knowledge_bases', 'messages', 'monitor_logs', 'rag_configs', 'review_tasks', 'sessions', 'chunks']) AS name")
def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    database = "marlstone_" + shared_path(spark).rpartition("/")[2]
    spark.sql(f"CREATE DATABASE {database}")
    sinks.create_tables(spark, shared_path(spark), schemas.BY_NAME, database)
    sinks.create_tables(spark, shared_path(spark), schemas.BY_NAME, database)  # those that are there stay
    names = views.tables(spark, database)
    spark.sql(f"DROP DATABASE {database} CASCADE")
    return names


@query(usage.LOGS + "SELECT strftime(timestamp, '%Y-%m-%d %H:00') AS hour, count(id) AS calls, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens FROM logs GROUP BY 1")
def streamed_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly trend of a stream of log entries, once all have come."""
    landing, out, state = (shared_path(spark) for _ in range(3))
    entries = usage.logs(spark, sf_dir)
    entries.write.parquet(landing)
    stream = spark.readStream.schema(entries.schema).parquet(landing)
    running = streams.to_table(streams.trend(stream), state, lambda df, _: df.write.mode("overwrite").parquet(out), mode="complete")
    running.awaitTermination()
    return spark.read.parquet(out)


@query(usage.LOGS + "SELECT module, count(*) AS entries FROM logs GROUP BY module")
def streamed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that a stream delivers twice count once."""
    landing, out, state = (shared_path(spark) for _ in range(3))
    entries = usage.logs(spark, sf_dir)
    entries.unionByName(entries).write.parquet(landing)
    stream = spark.readStream.schema(entries.schema).parquet(landing)
    running = streams.to_table(streams.distinct_logs(stream, late="40 days"), state, lambda df, _: df.write.mode("append").parquet(out))
    running.awaitTermination()
    return spark.read.parquet(out).groupBy("module").agg(F.count("*").alias("entries"))
