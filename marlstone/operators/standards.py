"""Quantities that texts state, as intervals with units, held against those that rules allow.

"at most 5 MPa", "less than 5 MPa" and "5 to 7 MPa" are intervals of pressure whose
ends are in or out; numbers are exact decimals in the unit that a quantity is kept
in, so 25 mm, 2.5 cm and 0.025 m are the same.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Units with what they measure and how many of the kept unit they are.
UNITS = {
    "mm": ("length", "1"), "cm": ("length", "10"), "m": ("length", "1000"), "km": ("length", "1000000"), "毫米": ("length", "1"), "厘米": ("length", "10"), "米": ("length", "1000"),
    "mg": ("mass", "0.001"), "g": ("mass", "1"), "kg": ("mass", "1000"), "t": ("mass", "1000000"),
    "s": ("time", "1"), "min": ("time", "60"), "h": ("time", "3600"), "d": ("time", "86400"), "hours": ("time", "3600"), "days": ("time", "86400"), "秒": ("time", "1"), "分钟": ("time", "60"), "小时": ("time", "3600"), "天": ("time", "86400"),
    "Pa": ("pressure", "1"), "kPa": ("pressure", "1000"), "MPa": ("pressure", "1000000"),
    "%": ("share", "1"), "‰": ("share", "0.1"), "℃": ("temperature", "1"), "°C": ("temperature", "1"),
}
# How texts say a relation.
RELATIONS = {
    "<=": ("<=", "≤", "at most", "no more than", "not more than", "up to", "小于或等于", "小于等于", "不大于", "不超过", "不得超过", "不高于"),
    ">=": (">=", "≥", "at least", "no less than", "not less than", "大于或等于", "大于等于", "不小于", "不低于", "不得低于"),
    "<": ("<", "less than", "below", "under", "小于", "低于"),
    ">": (">", "more than", "above", "over", "大于", "高于", "超过"),
}
LINKS = ("must be", "shall be", "should be", "has to be", "is", "are", "was", "of", "=", ":", "：", "应为", "必须", "应", "为")
ARTICLES = ("the", "a", "an", "this", "that", "its")


def _either(words) -> str:
    return "|".join("\\Q" + w + "\\E" for w in sorted(words, key=lambda w: (-len(w), w)))


_NUMBER = r"([0-9]{1,12}(?:\.[0-9]{1,9})?)"
_LATIN, _OTHER = (lambda ws: _either(w for w in ws if w[0].isascii() and w[0].isalpha())), (lambda ws: _either(w for w in ws if not (w[0].isascii() and w[0].isalpha())))
_SAID = [w for own in RELATIONS.values() for w in own]
#: Term (one to four words; a Latin one ends where its letters do), relation, number, second number, unit.
PATTERN = (
    r"(?i)(?<![\p{L}\p{N}#_-])(\p{L}[\p{L}\p{N}#_-]{0,60}?(?: [\p{L}\p{N}#_-]{1,60}?){0,3}?)(?!\p{IsLatin}|[#_-])(?: (?:" + _LATIN(LINKS) + r")(?!\p{L})| ?(?:" + _OTHER(LINKS) + r"))?"
    + "(?: ?(" + _OTHER(_SAID) + r"|(?<!\p{L})(?:" + _LATIN(_SAID) + r")(?!\p{L})))? ?" + _NUMBER + r"(?: ?(?:-|~|–|to|至) ?" + _NUMBER + r")? ?(?-i:(" + _either(UNITS) + r"))(?![\p{L}\p{N}])"
)


def _lookup(pairs: dict[str, str], c: Column) -> Column:
    return F.create_map(*(F.lit(x) for p in pairs.items() for x in p))[c]


def stated(rows: DataFrame, key: str, text: str = "text", words: int = 2) -> DataFrame:
    """Every quantity of every text: key, term (its last `words` words in lower case, articles left out), quantity, low, high, low_open, high_open, said.

    An open end of the line is a null low or high. Null texts state nothing. A
    range whose ends are the wrong way round is left out.
    """
    part = lambda k: F.regexp_extract("said", PATTERN, k)
    each = rows.select(F.col(key), F.explode(F.regexp_extract_all(F.col(text), F.lit(PATTERN), 0)).alias("said"))
    each = each.select(key, "said", *(part(k + 1).alias(n) for k, n in enumerate(("term", "relation", "first", "second", "unit"))))
    relation = _lookup({w: r for r, own in RELATIONS.items() for w in own}, F.lower("relation"))
    factor = _lookup({u: f for u, (_, f) in UNITS.items()}, F.col("unit")).cast("decimal(16,3)")
    number = lambda c: (F.expr(f"try_cast({c} AS decimal(21,9))") * factor).cast("decimal(38,9)")
    named = F.filter(F.split(F.lower("term"), " "), lambda w: ~w.isin(*ARTICLES))
    term = F.array_join(F.slice(named, F.greatest(F.lit(1), F.size(named) - (words - 1)), F.lit(words)), " ")
    each = each.select(key, term.alias("term"), _lookup({u: q for u, (q, _) in UNITS.items()}, F.col("unit")).alias("quantity"), relation.alias("r"), number("first").alias("x"), number("second").alias("y"), "said")
    low = F.when(F.col("y").isNotNull() | F.col("r").isNull() | F.col("r").isin(">", ">="), F.col("x"))
    high = F.when(F.col("y").isNotNull(), F.col("y")).when(F.col("r").isNull() | F.col("r").isin("<", "<="), F.col("x"))
    open_ = lambda r: F.coalesce((F.col("r") == r) & F.col("y").isNull(), F.lit(False))
    out = each.select(key, "term", "quantity", low.alias("low"), high.alias("high"), open_(">").alias("low_open"), open_("<").alias("high_open"), "said")
    return out.where((F.col("term") != "") & (F.col("low").isNull() | F.col("high").isNull() | (F.col("low") <= F.col("high"))))


def conflicts(statements: DataFrame, rules: DataFrame, key: str, rule: str) -> DataFrame:
    """Statements that go beyond what a rule of their term and quantity allows: key, rule, said, required, side (low, high or both).

    statements and rules: as stated() gives them. A statement's interval has to
    lie within the rule's; ends that are equal and out in the rule must be out in
    the statement. Rules meet statements by term and quantity alone, so the join
    grows with what is stated, and a hot term is split as any skewed join.
    """
    s, r = statements.alias("s"), rules.withColumnRenamed("said", "required").alias("r")
    met = s.join(r, (F.col("s.term") == F.col("r.term")) & (F.col("s.quantity") == F.col("r.quantity")))

    def beyond(end: str, over) -> Column:
        own, limit = F.col(f"s.{end}"), F.col(f"r.{end}")
        touches = (own == limit) & F.col(f"r.{end}_open") & ~F.col(f"s.{end}_open")
        return F.when(limit.isNull(), False).when(own.isNull(), True).otherwise(over(own, limit) | touches)

    low, high = beyond("low", lambda a, b: a < b), beyond("high", lambda a, b: a > b)
    side = F.when(low & high, "both").when(low, "low").when(high, "high")
    return met.select(F.col(f"s.{key}").alias(key), F.col(f"r.{rule}").alias(rule), "said", "required", side.alias("side")).where("side IS NOT NULL")


def kept_unit(value: str, unit: str) -> Decimal:
    """A number in the unit that its quantity is kept in."""
    return Decimal(value) * Decimal(UNITS[unit][1])
