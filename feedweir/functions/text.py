"""Text expressions. All are Column expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming removes: Unicode white space and the byte order mark (fixed values).
EDGE = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim_unicode(c: Column) -> Column:
    return F.trim(c, F.lit(EDGE))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: characters beyond U+FFFF count twice."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def longer_than(c: Column, units: int) -> Column:
    """More than so many UTF-16 units; encodes only what could be too long."""
    return (2 * F.length(c) > units) & (utf16_length(c) > units)


def fully_matches(c: Column, pattern: str) -> Column:
    r"""The whole value matches. `$` would match before a final line feed as well, so the pattern ends in \z."""
    return c.rlike(rf"\A(?:{pattern})\z")


def csv_field(c: Column) -> Column:
    """A field as RFC 4180 writes it: quoted only if it has a comma, quote, CR or LF."""
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_line(fields: Column) -> Column:
    """An array of fields as one line; null fields are blank."""
    return F.array_join(F.transform(fields, lambda v: csv_field(F.coalesce(v, F.lit("")))), ",")


def slugify(c: Column) -> Column:
    """Lower-case letters and digits in runs joined by dashes, 48 characters at most; "merchant" if none are left."""
    dashed = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    cut = F.substring(F.regexp_replace(dashed, r"\A-+|-+\z", ""), 1, 48)
    return F.when(F.length(cut) > 0, cut).otherwise(F.lit("merchant"))


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def normalize_header(names: list[str]) -> list[str]:
    """Header names without a byte order mark, trimmed, in lower case."""
    return [n.strip(EDGE).lower() for n in names]
