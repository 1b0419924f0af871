"""Model replies that are asked for once: a table of replies by the digest of what was asked, and calls through a bounded number of slots."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from marlstone.models import Limited, ModelClient, RuleModel
from marlstone.session import stored

SHAPE = "address string, reply string"


class Replies:
    """A folder of replies: address (SHA-256 of the model's name and the prompt) and reply, in Parquet files that are only added.

    slots: tasks that call at the same time, so that the whole cluster makes at
    most slots calls every pause seconds; batch: prompts whose replies are kept
    together, which is what a lost driver costs at most.
    """

    def __init__(self, spark: SparkSession, path: str, model: str = "rule", slots: int = 4, pause: float = 0.0, batch: int = 10_000):
        self.spark, self.path, self.model = spark, path, model
        self.slots, self.pause, self.batch = slots, pause, batch

    def known(self) -> DataFrame:
        """What has been answered, one row an address."""
        try:
            rows = self.spark.read.schema(SHAPE).parquet(self.path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SHAPE)
        # two runs at once may both have asked
        return rows.groupBy("address").agg(F.min("reply").alias("reply"))

    def _addressed(self, rows: DataFrame, prompt: str) -> DataFrame:
        return rows.withColumn("address", F.when(F.col(prompt).isNotNull(), F.sha2(F.concat(F.lit(self.model + "\n"), F.col(prompt)), 256)))

    def ask(self, rows: DataFrame, prompt: str, client: Callable[[], ModelClient] = RuleModel, tries: int = 1) -> DataFrame:
        """Asks what isn't known yet, each prompt once, and keeps every reply that comes. Returns the failures: address, error.

        A call that fails costs no other one its reply. Null prompts aren't asked.
        """
        asked = self._addressed(rows.select(F.col(prompt).alias("prompt")), "prompt").where("address IS NOT NULL")
        asked = asked.groupBy("address").agg(F.min("prompt").alias("prompt"))
        missing = stored(asked.join(self.known().select("address"), "address", "left_anti"))
        rounds = -(-missing.count() // self.batch)
        pause = self.pause

        def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = Limited(client(), pause, tries)

            def told(p: str) -> tuple[str | None, str | None]:
                try:
                    return model.complete(p), None
                except Exception as e:
                    return None, f"{type(e).__name__}: {e}"

            for batch in batches:
                answers = [told(p) for p in batch["prompt"]]
                yield pd.DataFrame({"address": batch["address"], "reply": [a for a, _ in answers], "error": [e for _, e in answers]})

        failed = None
        for k in range(rounds):
            some = missing.where(F.pmod(F.xxhash64("address"), F.lit(rounds)) == k).repartition(self.slots)
            got = stored(some.mapInPandas(call, SHAPE + ", error string"))  # asked once, whatever reads it
            got.where("error IS NULL").select("address", "reply").write.mode("append").parquet(self.path)
            lost = got.where("error IS NOT NULL").select("address", "error")
            failed = lost if failed is None else failed.unionByName(lost)
        return self.spark.createDataFrame([], "address string, error string") if failed is None else failed

    def complete(self, rows: DataFrame, prompt: str, reply: str = "reply", client: Callable[[], ModelClient] = RuleModel, tries: int = 1, say_errors: bool = False) -> DataFrame:
        """rows with the reply to each prompt, null where the prompt is. A failed call raises an error once all others are kept; with say_errors it is the reply."""
        failed = self.ask(rows, prompt, client, tries)
        n = 0 if say_errors else failed.count()
        if n:
            raise RuntimeError(f"{n} of the calls failed, {failed.first()['error']}; the others' replies are kept")
        told = self.known().unionByName(failed.select("address", F.concat(F.lit("Error: "), "error").alias("reply")))
        met = self._addressed(rows, prompt).join(told.withColumnRenamed("reply", "__reply"), "address", "left")
        return met.select(*rows.columns, F.col("__reply").alias(reply))
