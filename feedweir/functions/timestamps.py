"""Timestamps of feeds: ISO 8601 with some leniency, to a UTC instant in milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]*"
SHAPE = rf"\A\d{{4}}-\d{{2}}-\d{{2}}[Tt ]\d{{2}}:\d{{2}}(?::\d{{2}}(?:[.,]\d{{1,9}})?)?{_SPACE}(?:[Zz]|[+-]\d{{2}}:\d{{2}})?\z"


def with_millis(rows: DataFrame, source: str, target: str) -> DataFrame:
    """Add `target`: milliseconds since 1970 in UTC of the text in `source`, or null if it is no real instant.

    Fractions round half up to milliseconds; one that would carry into the next day is refused, as are leap
    seconds, years before 100, offsets beyond 14 hours (plus up to 59 minutes) and instants outside the years 0 to 9999.
    The shape is matched once; the parts then stand at fixed places.
    """
    text, t = F.col(source), "_ts_"
    at = lambda begin, n: F.substring(text, begin, n)
    number = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))
    second = at(17, 1) == ":"
    signed = at(-6, 1).isin("+", "-")
    nanos = F.rpad(F.regexp_extract(text, r"[.,](\d+)", 1), 9, "0").try_cast("long")
    parts = rows.withColumns(
        {
            f"{t}day": F.try_to_date(F.when(text.rlike(SHAPE), at(1, 10)), "yyyy-MM-dd"),
            f"{t}h": number(at(12, 2)), f"{t}m": number(at(15, 2)), f"{t}s": F.when(second, number(at(18, 2))).otherwise(0),
            f"{t}ms": F.when(second & at(20, 1).isin(".", ","), F.coalesce(F.floor((nanos + F.lit(500_000)) / F.lit(1_000_000)), F.lit(0)).cast("long")).otherwise(F.lit(0).cast("long")),
            f"{t}oh": F.when(signed, number(at(-5, 2))).otherwise(0), f"{t}om": F.when(signed, number(at(-2, 2))).otherwise(0), f"{t}sign": F.when(at(-6, 1) == "-", -1).otherwise(1),
        }
    )
    p = lambda c: F.col(t + c)
    timed = parts.withColumn(f"{t}in", ((p("h") * 60 + p("m")) * 60 + p("s")).cast("long") * 1000 + p("ms"))
    timed = timed.withColumn(target, F.unix_date(p("day")).cast("long") * 86_400_000 + p("in") - ((p("oh") * 60 + p("om")) * p("sign")).cast("long") * 60_000)
    known = (p("h") <= 23) & (p("m") <= 59) & (p("s") <= 59) & (p("oh") <= 14) & (p("om") <= 59) & (F.year(p("day")) >= 100) & (p("in") < 86_400_000)
    known = known & F.col(target).between(-62_167_219_200_000, 253_402_300_799_999)
    # the partition id changes nothing, but keeps the whole from being copied into filters (see validation.validate)
    return timed.withColumn(target, F.when(known & (F.spark_partition_id() >= 0), F.col(target))).drop(*[c for c in timed.columns if c.startswith(t)])


def iso_millis(millis: Column) -> Column:
    """An instant as text: 2025-03-01T10:00:00.000Z, whatever the session's time zone."""
    day = F.date_from_unix_date(F.floor(millis / F.lit(86_400_000)).cast("int"))
    rest = F.pmod(millis, F.lit(86_400_000))
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    clock = F.concat(two(F.floor(rest / 3_600_000)), F.lit(":"), two(F.floor(rest / 60_000) % 60), F.lit(":"), two(F.floor(rest / 1000) % 60), F.lit("."), F.lpad((rest % 1000).cast("string"), 3, "0"))
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), clock, F.lit("Z"))
