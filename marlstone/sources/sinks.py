"""Writing tables, reports and revised documents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.models import embedding
from marlstone.schemas import BY_NAME
from marlstone.session import small_batches


def create_tables(spark: SparkSession, folder: str, schemas: dict[str, T.StructType] | None = None, database: str = "default") -> list[str]:
    """Catalog tables on Parquet below folder, where they aren't yet."""
    made = []
    for name, schema in (schemas or BY_NAME).items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({schema.toDDL()}) USING parquet LOCATION '{folder}/{name}'")
        made.append(name)
    return made


def fill(df: DataFrame, name: str) -> None:
    """Appends rows to a catalog table; columns that they lack are null, and any that the table lacks are an error."""
    schema = df.sparkSession.table(name).schema
    unknown = set(df.columns) - set(schema.names)
    if unknown:
        raise ValueError(f"{name} has no columns {sorted(unknown)}")
    whole = df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))
    whole.write.insertInto(name)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_chunks(chunks: DataFrame, path: str, embed: str | None = None) -> None:
    """Chunks by knowledge base, so that a search reads one base's files only; embed names a column of texts, whose vectors are written too.

    A base's rows are dealt to tasks by size, so that a large base is no single task.
    """
    if embed:
        chunks = chunks.withColumn("embedding", embedding(F.col(embed)))
    chunks.hint("rebalance", "kb_id").write.mode("append").partitionBy("kb_id").parquet(path)


def read_chunks(spark: SparkSession, path: str, kb_id: int | None = None, doc_id: int | None = None, limit: int | None = None, order: str = "chunk_no") -> DataFrame:
    """Chunks of a base (its partition alone is read) and of a document, the first ones if a limit is given."""
    out = spark.read.parquet(path)
    out = out if kb_id is None else out.where(F.col("kb_id") == kb_id)
    out = out if doc_id is None else out.where(F.col("doc_id") == doc_id)
    return out if limit is None else out.orderBy(order).limit(limit)


def drop_collection(spark: SparkSession, path: str, kb_id: int) -> bool:
    """Deletes a base's partition; whether there was one."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kb_id={kb_id}")
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def report_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A report with a fixed order of columns; a missing one is an error."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def report_json(df: DataFrame, path: str) -> None:
    """Lines of JSON, non-ASCII characters as they are."""
    df.write.mode("overwrite").json(path)


def report_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def word_files(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One Word file per document, as binary: key, content."""
    from marlstone.sources.files import docx_of

    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            made = pa.array((docx_of((t.as_py() or "").split("\n")) for t in batch[1]), pa.binary())
            yield pa.RecordBatch.from_arrays([batch[0], made], [key, "content"])

    return small_batches(docs.select(key, text)).mapInArrow(run, f"{key} {kind}, content binary")
