"""Rules of a table of texts held against what other texts state, in whatever units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import standards
from marlstone.plans.base import query
from marlstone.session import spread, table

#: What the rule of each brand asks of the size in millimetres, by the brand's number; and what a part's text states.
RULES_SQL = """r AS (SELECT DISTINCT p_brand AS brand, CAST(substr(p_brand, 7) AS INTEGER) AS n FROM part),
p AS (SELECT p_partkey, p_brand AS brand, p_size AS size, p_partkey % 4 = 3 AS up_to FROM part)"""


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule a brand, each relation in turn, limits in centimetres."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.substring("p_brand", 7, 9).cast("int").alias("n")).distinct()
    limit = F.format_string("%.1f cm", F.col("n") / 10)
    said = F.array(F.concat(F.lit("at most "), limit), F.concat(F.lit("less than "), limit), F.concat(F.lit("≥ "), limit), F.concat(F.lit("more than "), limit), F.format_string("%d to %d mm", "n", F.col("n") + 20))
    return brands.select("brand", F.concat(F.lit("Rule of the house. The "), "brand", F.lit(" size must be "), F.get(said, F.col("n") % 5), F.lit("; see the notes.")).alias("text"))


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each part's text states, in millimetres, centimetres or metres, exactly or as a bound."""
    size = F.col("p_size")
    forms = F.array(F.format_string("is %d mm", size), F.format_string("is %.1f cm", size / 10), F.format_string("is %.3f m", size / 1000), F.format_string("is up to %d mm", size))
    said = F.concat(F.col("p_name"), F.lit(". Its "), "p_brand", F.lit(" size "), F.get(forms, F.col("p_partkey") % 4), F.lit("."))
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")).select("p_partkey", said.alias("text"))


@query(
    f"""WITH {RULES_SQL}, m AS (SELECT p_partkey, p.brand, CASE n % 5 WHEN 2 THEN up_to OR size < n WHEN 3 THEN up_to OR size <= n WHEN 4 THEN up_to OR size < n ELSE false END AS low,
  CASE n % 5 WHEN 0 THEN size > n WHEN 1 THEN size >= n WHEN 4 THEN size > n + 20 ELSE false END AS high, n % 5 IN (2, 3) AS unbounded FROM p JOIN r ON r.brand = p.brand)
SELECT p_partkey, brand, CASE WHEN low AND high THEN 'both' WHEN low THEN 'low' ELSE 'high' END AS side FROM m WHERE low OR high"""
)
def standard_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = standards.stated(_rules(spark, sf_dir), "brand")
    found = standards.conflicts(standards.stated(_statements(spark, sf_dir), "p_partkey"), rules, "p_partkey", "brand")
    return found.select("p_partkey", "brand", "side")
