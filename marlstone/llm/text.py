"""Column expressions for words, shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white space that separates words, as the contracts state it.
BLANKS = " \t\n\x0b\x0c\r"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(col: Column) -> Column:
    """A to Z in lower case; all else, and other scripts' capitals, unchanged."""
    return F.translate(col, UPPER, LOWER)


def words(col: Column) -> Column:
    """The words of a text as an array; null and blank texts give an empty one."""
    bare = F.btrim(F.coalesce(col, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t\\n\\x0B\\f\\r]+", -1))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]
