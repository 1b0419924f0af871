"""Which paragraphs of a document hang together, and how far a change to some of them reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.keywords import terms_of
from marlstone.session import stored

STRONG, WEAK = "strong", "weak"


def edges(paras: DataFrame, key: str = "doc_id", most: int = 3, least: int = 4, strong: int = 2) -> DataFrame:
    """Dependencies between paragraphs of one document: key, source < target (paragraph indexes), type, impact.

    Two paragraphs depend on each other by every term of at least `least`
    characters that they share and that at most `most` paragraphs of the document
    have: such terms name what a text is about, and each gives a bounded number
    of edges. With `strong` such terms an edge is strong, else weak; impact lists
    them. Null contents have no terms; rows of one key are one document.
    """
    term = F.explode(F.array_distinct(F.filter(terms_of(F.col("content")), lambda t: F.length(t) >= least))).alias("term")
    held = paras.select(key, "paragraph_index", term).groupBy(key, "term").agg(F.array_sort(F.collect_set("paragraph_index")).alias("at"))
    few = held.where((F.size("at") > 1) & (F.size("at") <= most))
    pairs = F.flatten(F.transform("at", lambda a: F.transform(F.filter("at", lambda b: b > a), lambda b: F.struct(a.alias("source"), b.alias("target")))))
    each = few.select(key, "term", F.explode(pairs).alias("p")).select(key, "term", "p.*")
    found = each.groupBy(key, "source", "target").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("term")), ", ").alias("impact"))
    return found.select(key, "source", "target", F.when(F.col("n") >= strong, STRONG).otherwise(WEAK).alias("type"), "impact")


def reached(edges_: DataFrame, changed: DataFrame, key: str = "doc_id", hops: int = 3, only: str | None = None) -> DataFrame:
    """Paragraphs that a change reaches over at most `hops` dependencies, in either direction: key, paragraph_index, hops (0 for those that change).

    changed: key, paragraph_index; only: a type of edges. Each step joins the
    paragraphs that were new in the last one, and is written down.
    """
    own = edges_ if only is None else edges_.where(F.col("type") == only)
    both = stored(own.select(key, F.col("source").alias("paragraph_index"), F.col("target").alias("other")).unionByName(own.select(key, F.col("target").alias("paragraph_index"), F.col("source").alias("other"))))
    frontier = stored(changed.where(F.col("paragraph_index").isNotNull()).select(key, F.col("paragraph_index").cast("int")).distinct())
    seen = frontier.withColumn("hops", F.lit(0))
    for hop in range(1, hops + 1):
        near = frontier.join(both, [key, "paragraph_index"]).select(key, F.col("other").alias("paragraph_index")).distinct()
        frontier = stored(near.join(seen.select(key, "paragraph_index"), [key, "paragraph_index"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.withColumn("hops", F.lit(hop)))
    return seen
