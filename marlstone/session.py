"""Session building and table loading."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_paths: list[tuple[SparkSession, str]] = []
#: Bytes of texts and files that a Python worker is handed at once.
BATCH_BYTES = 4 << 20
#: Tables a scale-factor folder holds.
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def build_session(app: str = "marlstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans rely on; a cluster's own master and sizes are left alone."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(app).master(master or os.environ.get("SPARK_MASTER", f"local[{cpus}]"))
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a folder, through Spark's reader so that any file system it knows will do."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, its rows dealt anew where it has fewer parts than there are cores, as files of one row group have; a large table stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def small_batches(df: DataFrame) -> DataFrame:
    """df, its session set to hand Python at most BATCH_BYTES at once, and one row at least: batches of whole texts or files would fill a worker.

    The setting stays, as results are evaluated later.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names; one of our own only where that is unset and all tasks run in this process.

    What is written there goes when the driver's Python ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.conf.get("spark.master", None) or "").startswith("local[") and spark.conf.get("spark.master", None) != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    _paths.append((spark, path))
    return path


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again, so that it is made once and no lineage grows."""
    spark, path = df.sparkSession, shared_path(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _drop() -> None:
    for spark, path in _paths:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may have ended before
            pass
