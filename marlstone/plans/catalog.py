"""Catalog queries; sources stand for knowledge bases, customers and orders for parents and children."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import extension, megabytes, root, suffix
from marlstone.operators import catalog, usage
from marlstone.plans.base import query
from marlstone.session import table


@query("SELECT source, count(doc_id) AS documents, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS bytes, max(doc_id) AS last_doc FROM documents GROUP BY source")
def kb_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    bases = docs.select("source").distinct()
    aggregates = {"documents": F.count("doc_id"), "bytes": F.sum("n_chars"), "last_doc": F.max("doc_id")}
    return catalog.rollup(bases, docs.select("source", "doc_id", "n_chars"), "source", "source", aggregates, {"documents": F.lit(0), "bytes": F.lit(0)})


@query(
    """SELECT c_custkey, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS total, coalesce(max(o_orderdate), TIMESTAMP '1970-01-01') AS changed_at
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 300000 GROUP BY c_custkey"""
)
def kb_rollup_childless(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_totalprice > 300000")
    parents = table(spark, sf_dir, "customer").select("c_custkey")
    aggregates = {"orders": F.count("o_orderkey"), "total": F.round(F.sum("o_totalprice"), 2), "changed_at": F.max("o_orderdate")}
    defaults = {"orders": F.lit(0), "total": F.lit(0.0), "changed_at": F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))}
    return catalog.rollup(parents, orders, "c_custkey", "o_custkey", aggregates, defaults)


@query("SELECT CAST(coalesce(sum(documents), 0) AS BIGINT) AS documents, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes, max(last_doc) AS last_doc FROM (SELECT source, count(*) AS documents, sum(n_chars) AS bytes, max(doc_id) AS last_doc FROM documents GROUP BY source)")
def catalog_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.totals(kb_rollup(spark, sf_dir), "documents", "bytes", last="last_doc")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def orphans_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.orphans(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'ACTIVE' ELSE 'ORPHAN' END AS status FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def orphans_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.flagged(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT CAST(count(*) AS BIGINT) AS orphans, round(sum(n_chars) / 1024, 1) AS kilobytes FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = catalog.orphans(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels"), "doc_id")
    return gone.agg(F.count("*").alias("orphans"), F.round(F.sum("n_chars") / 1024, 1).alias("kilobytes"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def accepted_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.only(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    sessions = rows.select("conv_id").distinct()
    _, kept = catalog.delete(sessions, rows, rows.where("role = 'system'"), "conv_id", "conv_id")
    return kept


@query("SELECT conv_id, turn, role FROM conversations WHERE NOT (conv_id = 1 AND turn > 0)")
def delete_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.delete_where(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), (F.col("conv_id") == 1) & (F.col("turn") > 0))


@query(
    """WITH n(doc_id, quality, toxic) AS (VALUES (CAST(0 AS BIGINT), 0, CAST(NULL AS INTEGER)), (CAST(-7 AS BIGINT), 1, 1))
SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.quality, o.quality) AS quality, coalesce(n.toxic, o.toxic) AS toxic FROM labels o FULL JOIN n ON o.doc_id = n.doc_id"""
)
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = spark.createDataFrame([(0, 0, None), (-7, 1, 1)], "doc_id long, quality int, toxic int")
    return catalog.upsert(table(spark, sf_dir, "labels"), changes, "doc_id")


@query(
    """WITH f AS (SELECT page_id, 'p' || (page_id % 9) || CASE WHEN page_id % 2 = 0 THEN '.pdf' ELSE '.tar.gz' END AS name FROM pages),
n AS (SELECT page_id, name, row_number() OVER (PARTITION BY name ORDER BY page_id) - 1 AS k FROM f)
SELECT page_id, name, CASE WHEN k = 0 THEN name WHEN name LIKE '%.pdf' THEN regexp_replace(name, '\\.pdf$', '(' || k || ').pdf') ELSE regexp_replace(name, '\\.gz$', '(' || k || ').gz') END AS free_name FROM n"""
)
def file_dedup_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("p"), (F.col("page_id") % 9).cast("string"), F.when(F.col("page_id") % 2 == 0, ".pdf").otherwise(".tar.gz"))
    return catalog.deduplicated_names(table(spark, sf_dir, "pages").select("page_id", name.alias("name")), "name", ["page_id"])


@query(
    """WITH f AS (SELECT page_id, regexp_replace(url, '^https?://[^/]*/', '') AS name FROM pages)
SELECT page_id, lower(list_last(string_split(name, '.'))) AS extension FROM f"""
)
def file_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.regexp_replace("url", "^https?://[^/]*/", "")
    return table(spark, sf_dir, "pages").select("page_id", extension(name).alias("extension"))


@query("SELECT page_id, regexp_replace(url, '\\.[^.]*$', '') AS root, regexp_extract(url, '\\.[^.]*$') AS suffix FROM pages")
def file_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", root(F.col("url")).alias("root"), suffix(F.col("url")).alias("suffix"))


@query(
    """WITH n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS number, count(*) OVER (PARTITION BY source) AS total FROM documents)
SELECT source, doc_id, CAST(number AS INTEGER) AS number, total FROM n WHERE number <= 20"""
)
def doc_page_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.counted_page(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", ["doc_id"], 20)


@query("SELECT label, count(*) AS chunks FROM embeddings GROUP BY label")
def collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.collections(table(spark, sf_dir, "embeddings"), "label")


@query("SELECT label, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 3")
def collection_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.sample_rows(table(spark, sf_dir, "embeddings").select("label", "vec_id"), "label", ["vec_id"])


@query(
    """WITH new(source) AS (VALUES ('src0'), ('new base'), ('another')), old AS (SELECT row_number() OVER (ORDER BY source) AS id, source FROM (SELECT DISTINCT source FROM documents))
SELECT CAST(id AS BIGINT) AS id, source FROM old UNION ALL
SELECT CAST((SELECT max(id) FROM old) + row_number() OVER (ORDER BY source) AS BIGINT), source FROM new WHERE source NOT IN (SELECT source FROM old)"""
)
def insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    names = table(spark, sf_dir, "documents").select("source").distinct()
    bases = names.select(F.row_number().over(Window.orderBy("source")).cast("bigint").alias("id"), "source")
    new = spark.createDataFrame([("src0",), ("new base",), ("another",)], "source string")
    return catalog.insert_absent(bases, new, "source")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def segment_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("SELECT count(*) > 0 AND coalesce(bool_and(quality = 1), false) AS all_done FROM labels")
def all_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.all_done(table(spark, sf_dir, "labels"), F.col("quality") == 1)


@query("SELECT source, printf('%.2f MB', sum(n_chars) / 1048576.0) AS size, count(*) AS calls, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY source")
def kb_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("n"), F.count("*").alias("calls"))
    return usage.shares(sized).select("source", megabytes(F.col("n")).alias("size"), "calls", "share")


@query("SELECT 'similarity' AS retrieval_method, 4 AS retrieval_k, 0.5::DOUBLE AS similarity_threshold, 0.7::DOUBLE AS temperature, 2000 AS max_tokens")
def active_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.schemas import RAG_CONFIGS, RAG_DEFAULTS

    return catalog.active_config(spark.createDataFrame([], RAG_CONFIGS), RAG_DEFAULTS)
