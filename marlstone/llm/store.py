"""Tables written to the shared folder, to cut lineage where executors may be lost."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where that is unset and all tasks run in this process, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.conf.get("spark.master", "") or "").startswith(("local[", "local ")) and spark.conf.get("spark.master", "") != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def for_texts(spark: SparkSession) -> SparkSession:
    """The session, set to move rows with long texts in small batches: 4096 texts of 100 KB would fill an executor."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "256")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return spark


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet in the shared folder and read again. Files go by drop(), or when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/marlstone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop(*frames: DataFrame) -> None:
    """Deletes what written() gave, once nothing that is still to run reads it."""
    for df in frames:
        if (spark := _written.pop(df._written_at, None)) is not None:
            _delete(spark, df._written_at)


@atexit.register
def _drop_all() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended before
            pass
