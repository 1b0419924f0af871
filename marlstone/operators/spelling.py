"""Misspellings that a corpus tells by itself: rare words one slip away from words that are far more frequent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import stored

#: What each slip costs, in natural logs: letters are swapped, left out, doubled or added, or mistaken.
SLIPS = {"swapped": 0.0, "left out": 0.3, "added": 0.3, "mistaken": 0.7}


def words_of(text: Column, least: int) -> Column:
    """Words of at least so many letters, in lower case."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), 0), lambda w: F.length(w) >= least)


def frequencies(docs: DataFrame, text: str = "text", least: int = 5) -> DataFrame:
    """word, n: how often it stands in all texts."""
    return docs.select(F.explode(words_of(F.col(text), least)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _forms(words: DataFrame) -> DataFrame:
    """A word whole (place 0) and with each of its letters left out: word, n, form, place."""
    without = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.struct(F.concat(F.substr("word", F.lit(1), i - 1), F.substr("word", i + 1)).alias("form"), i.alias("place")))
    each = F.concat(F.array(F.struct(F.col("word").alias("form"), F.lit(0).alias("place"))), without)
    return words.select("word", "n", F.explode(each).alias("f")).select("word", "n", "f.form", "f.place")


def corrections(words: DataFrame, rare: int = 2, ratio: float = 100.0) -> DataFrame:
    """original, corrected, slip: for rare words (at most `rare` times) the frequent word that was most likely meant.

    words: word, n. Words that are one slip apart share a form with one letter
    left out, so forms are joined and no pairs of words are tried; forms of
    frequent words are few. Of the words that are at least `ratio` times as
    frequent, the one of highest log frequency less the slip's cost is meant, then
    the first in order. The two sets of words never meet, so no word corrects one
    that is itself corrected.
    """
    least = int(max(rare + 1, ratio))
    unsure = _forms(words.where(F.col("n") <= rare)).select(F.col("word").alias("original"), F.col("n").alias("m"), "form", F.col("place").alias("i"))
    known = _forms(words.where(F.col("n") >= least)).select(F.col("word").alias("corrected"), "n", "form", F.col("place").alias("j"))
    a, b, i, j = F.col("original"), F.col("corrected"), F.col("i"), F.col("j")
    at = lambda w, k: F.substr(w, k, F.lit(1))
    swapped = (F.abs(i - j) == 1) & (F.least(i, j) > 0) & (at(a, i) == at(b, j)) & (at(a, j) == at(b, i))
    slip = F.when(swapped, "swapped").when((i == 0) & (j > 0), "left out").when((i > 0) & (j == 0), "added").when((i == j) & (i > 0), "mistaken")
    met = unsure.join(known, "form").withColumn("slip", slip).where(F.col("slip").isNotNull() & (F.col("n") >= ratio * F.col("m")))
    cost = F.create_map(*(F.lit(x) for pair in SLIPS.items() for x in pair))[F.col("slip")]
    rank = F.row_number().over(Window.partitionBy("original").orderBy(F.round(F.log("n") - cost, 9).desc(), "corrected", "slip"))
    return met.withColumn("rank", rank).where("rank = 1").select("original", "corrected", "slip")


def findings(paras: DataFrame, found: DataFrame, key: str = "doc_id", least: int = 5) -> DataFrame:
    """Every misspelt word of every paragraph once: columns of paras but content, original, corrected, reason."""
    rest = [c for c in paras.columns if c != "content"]
    each = paras.select(*rest, F.explode(F.array_distinct(words_of(F.col("content"), least))).alias("original"))
    return each.join(found, "original").select(*rest, "original", "corrected", F.concat(F.lit("letters "), "slip").alias("reason"))


def learned(docs: DataFrame, paras: DataFrame, key: str = "doc_id", text: str = "text", least: int = 5, rare: int = 2, ratio: float = 100.0) -> DataFrame:
    """Findings in paras by the words of docs, or of a base of texts whose terms are the standard."""
    return findings(paras, stored(corrections(stored(frequencies(docs, text, least)), rare, ratio)), key, least)
