"""Exact deduplication that no hot text can skew.

Three stages, each of which compares whole texts and not only their digests:

1. local: the map side of the first aggregation folds equal texts of one input
   partition into one row;
2. salted: rows of one digest meet in as many groups as there are salts. The
   salt is the input partition's number, so that a text costs a salted group
   no more rows than partitions hold it;
3. global: at most ``salts`` winners of a digest meet.

Only digests travel back to the rows. If two texts should ever share a digest,
the second stage sees it, and rows of that digest are then matched by text.

Null texts count as empty. Null ids never win against others; a group of null
ids alone keeps one row and a null keep_id. Of repeated rows (same id, same
text) exactly one stays. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.store import written
from marlstone.llm.text import lower_ascii


def _sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def winners(rows: DataFrame, salts: int, by_text: bool) -> DataFrame:
    """rows: id, text, digest. One row per digest: keep_id, group_size, texts (distinct ones); by_text: one per digest and text."""
    salted = (
        rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "salt", "text")
        .agg(F.max("id").alias("id"), F.count("*").alias("n"))
    )
    merged = salted.repartition("digest").groupBy("digest", "text").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))
    if by_text:
        return merged
    return merged.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count("*").alias("texts"))


class ExactDedup:
    """Groups of equal texts; of each, the row with the largest id stays.

    normalise maps the text column to what must be equal; digest maps that to
    binary. Other columns of the input pass through untouched, whatever their names.
    """

    def __init__(self, text: str = "text", key: str = "doc_id", salts: int = 32, normalise: Callable[[Column], Column] = lower_ascii, digest: Callable[[Column], Column] = _sha256):
        self.text, self.key, self.salts, self.normalise, self.digest = text, key, salts, normalise, digest

    def _rows(self, docs: DataFrame) -> DataFrame:
        text = self.normalise(F.coalesce(F.col(self.text), F.lit("")))
        return docs.select(F.col(self.key).alias("id"), text.alias("text")).withColumn("digest", self.digest(F.col("text")))

    def groups(self, docs: DataFrame) -> tuple[DataFrame, list[str]]:
        """The winners, and the columns that rows match them by: the digest alone unless texts share one."""
        rows = self._rows(docs)
        by_digest = written(winners(rows, self.salts, by_text=False))
        if by_digest.where("texts > 1").limit(1).count() == 0:
            return by_digest.drop("texts"), ["digest"]
        return winners(rows, self.salts, by_text=True), ["digest", "text"]

    def decide(self, docs: DataFrame) -> DataFrame:
        """One row per input row: id, keep_id, group_size, kept, digest."""
        best, by = self.groups(docs)
        rows = self._rows(docs).select("id", *by)
        rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy(*by, "id").orderBy(F.lit(0))))
        kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
        return rows.join(best, by).select("id", "keep_id", "group_size", kept.alias("kept"), "digest")

    def keep(self, docs: DataFrame) -> DataFrame:
        """The rows that stay, with the columns of docs."""
        best, by = self.groups(docs)
        text = self.normalise(F.coalesce(F.col(self.text), F.lit("")))
        rows = docs.select(F.struct("*").alias("row"), F.struct(F.col(self.key)).alias("who"), text.alias("text")).withColumn("digest", self.digest(F.col("text")))
        by = [*by, "who"]  # the window and the join share one exchange
        rows = rows.select("row", *by).withColumn("copy", F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(0))))
        best = best.withColumn("who", F.struct(F.col("keep_id").alias(self.key))).select(*by)
        return rows.where("copy = 1").join(best, by).select("row.*")
