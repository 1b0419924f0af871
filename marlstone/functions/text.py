"""Scalar functions over text, time and sizes, all as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The white space of all scripts.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """White space of any script off both ends, as Python's str.strip() does; trim() would leave U+3000."""
    return F.btrim(c, F.lit(WHITE))


def paragraphs(c: Column) -> Column:
    """Non-blank lines, stripped."""
    return F.filter(F.transform(F.split(c, "\n", -1), strip), lambda x: x != "")


def non_blank_lines(c: Column) -> Column:
    """Lines with more than white space, kept as they are."""
    return F.filter(F.split(c, "\n", -1), lambda x: strip(x) != "")


def tokens(c: Column) -> Column:
    """A rough token count: a quarter of the characters, rounded down."""
    return F.floor(F.length(c) / 4).cast("bigint")


def sentence_pieces(c: Column) -> Column:
    """Parts between full-width sentence marks, a trailing empty one counted."""
    return F.size(F.split(c, "[。！？]", -1)).cast("bigint")


def prefix(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def preview(c: Column, n: int = 200) -> Column:
    return F.when(F.length(c) > n, F.concat(prefix(c, n), F.lit("..."))).otherwise(c)


def extension(name: Column) -> Column:
    """What follows the last dot, in lower case; the whole name without a dot."""
    return F.lower(F.element_at(F.split(name, r"\.", -1), -1))


def root(name: Column) -> Column:
    """The name without its last extension; a leading dot is no extension."""
    return F.when(name.rlike(r"^.+\.[^.]*$") & ~name.rlike(r"^\.+[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def suffix(name: Column) -> Column:
    """The last extension with its dot, or nothing."""
    return F.substr(name, F.length(root(name)) + 1)


def first_of(*cs: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cs))


def iso(ts: Column, mark: str = "") -> Column:
    """ISO text; microseconds only where they aren't zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit(mark))


def hour_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:00")


def fixed(c: Column, digits: int) -> Column:
    """A number with so many decimals (3 at most), rounded as C's printf does: by the double's exact value, ties to even.

    Java's formatter rounds the shortest decimal that names the double, ties up.
    """
    x = c.cast("double")
    size = F.abs(x)
    # the bits behind the point as two whole numbers of 52 and 40 bits; what has more is nearer to 0 than to any tie
    bits = (size - F.floor(size)) * float(1 << 52)
    more = F.floor((bits - F.floor(bits)) * float(1 << 40)) * 10**digits
    units = F.floor(bits) * 10**digits + F.shiftright(more, 40)
    kept, rest, left = F.shiftright(units, 52), units.bitwiseAND((1 << 52) - 1), more.bitwiseAND((1 << 40) - 1)
    above = (rest > 1 << 51) | ((rest == 1 << 51) & ((left > 0) | ((F.floor(size) * 10**digits + kept) % 2 == 1)))
    kept = kept + above.cast("bigint")
    whole = F.floor(size) + F.floor(kept / 10**digits)
    said = F.concat(F.when(x < 0, "-").otherwise(""), whole.cast("string"), *((F.lit("."), F.lpad((kept % 10**digits).cast("string"), digits, "0")) if digits else ()))
    # doubles from 2^53 have no decimals
    return F.when(size < float(1 << 53), said).when(size >= float(1 << 53), F.format_string(f"%.{digits}f", x))


def megabytes(n: Column) -> Column:
    return F.concat(fixed(n / 1048576.0, 2), F.lit(" MB"))


def kilobytes(n: Column) -> Column:
    return F.concat(fixed(n / 1024.0, 1), F.lit(" KB"))


def percent(share: Column, digits: int = 1) -> Column:
    return F.concat(fixed(share * 100, digits), F.lit("%"))


def relative_time(ts: Column, as_of: Column) -> Column:
    """'just now', minutes, hours or days before as_of, each rounded down."""
    minutes = F.timestamp_diff("MINUTE", ts, as_of)
    unit = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word} ago"))
    return (
        F.when(minutes < 1, "just now")
        .when(minutes < 60, unit(minutes, "minutes"))
        .when(minutes < 1440, unit(F.floor(minutes / 60), "hours"))
        .otherwise(unit(F.floor(minutes / 1440), "days"))
    )


def label(c: Column, names: dict[str, str], default: str) -> Column:
    """A value's label, or the default."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[c], F.lit(default))


def replace_first(c: Column, old: Column, new: Column) -> Column:
    """c with the first occurrence of old replaced, literally; unchanged without one or if old is empty."""
    at = F.position(old, c)
    return F.when((F.length(old) > 0) & (at > 0), F.concat(F.substr(c, F.lit(1), at - 1), new, F.substr(c, at + F.length(old)))).otherwise(c)


def unfence(c: Column) -> Column:
    """A model's reply without its code fence."""
    c = F.regexp_replace(strip(c), r"^```json", "")
    c = F.regexp_replace(c, r"^```", "")
    return strip(F.regexp_replace(c, r"```$", ""))


def json_records(reply: Column, ddl: str) -> Column:
    """Records of a model's reply: the whole text as JSON, else the widest [..] in it, else each {..} that parses, else none."""
    many = f"array<struct<{ddl}>>"
    parsed = lambda text: F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, many))
    single = F.filter(F.regexp_extract_all(reply, F.lit(r"\{[\s\S]*?\}"), 0), lambda x: F.try_parse_json(x).isNotNull())
    lone = F.transform(single, lambda x: F.from_json(x, f"struct<{ddl}>"))
    return F.coalesce(parsed(reply), parsed(F.regexp_extract(reply, r"\[[\s\S]*\]", 0)), lone)


def without_spaces(c: Column) -> Column:
    """Every ASCII space taken out; other white space stays."""
    return F.replace(c, F.lit(" "))


def identifier(c: Column) -> Column:
    """An id in the form of a random UUID, but the same for the same value."""
    h = F.md5(c.cast("string"))
    variant = F.element_at(F.array(*(F.lit(x) for x in "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def printed(c: Column, width: int = 80, top: int = 800, bottom: int = 50, step: int = 15) -> Column:
    """A text's lines as a printer sets them: page (from 0), y and the first width characters."""
    lines = (top - bottom) // step + 1
    return F.transform(F.split(c, "\n", -1), lambda x, k: F.struct(F.floor(k / lines).cast("int").alias("page"), (top - step * (k % lines)).cast("int").alias("y"), prefix(x, width).alias("line")))
