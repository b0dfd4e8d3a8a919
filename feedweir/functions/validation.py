"""The ordered chain of checks on a feed row.

The first check that fails decides. Trimmed and converted values are columns of their own, so the chain refers to
plain columns; it yields the number of the check, from which codes and messages are made for rejected rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweir import schema as S
from feedweir.functions.currency import is_active, minor_units
from feedweir.functions.text import csv_line, fully_matches, longer_than, trim_unicode
from feedweir.functions.timestamps import with_millis

#: Every code that a row can be rejected with (fixed values).
CODES = (
    "missing_column", "missing_sku", "sku_too_long", "name_too_long", "category_too_long", "invalid_currency", "unknown_currency", "invalid_price",
    "negative_price", "price_minor_units", "price_out_of_range", "negative_stock", "invalid_stock", "stock_out_of_range", "invalid_timestamp", "invalid_text", "unparseable_line",
)
_TRIMMED = ("sku", "currency", "price", "stock", "updated_at")


def _checks() -> list[tuple[str, str | None, Column, list[Column | str]]]:
    """(code, column, condition, parts of the message) in the order in which they count."""
    t = {c: F.col(f"_{c}") for c in _TRIMMED}
    missing = [("missing_column", c, F.col(c).isNull(), [f'Row is missing the "{c}" column (the row has fewer fields than the header)']) for c in S.REQUIRED]
    return missing + [
        ("missing_sku", "sku", t["sku"] == "", ["sku is empty; every row must identify a product"]),
        ("sku_too_long", "sku", longer_than(t["sku"], S.MAX_SKU), [f"sku exceeds {S.MAX_SKU} characters"]),
        ("name_too_long", "name", longer_than(F.col("name"), S.MAX_NAME), [f"name exceeds {S.MAX_NAME} characters"]),
        ("category_too_long", "category", longer_than(F.col("category"), S.MAX_CATEGORY), [f"category exceeds {S.MAX_CATEGORY} characters"]),
        ("invalid_currency", "currency", ~fully_matches(t["currency"], "[A-Za-z]{3}"), ['currency "', t["currency"], '" is not a 3-letter ISO-4217 code']),
        ("unknown_currency", "currency", ~is_active(F.col("_code")), ['"', F.col("_code"), '" is not an active ISO-4217 code']),
        ("invalid_price", "price", t["price"] == "", ["price is empty"]),
        ("negative_price", "price", t["price"].startswith("-"), ['price "', t["price"], '" is negative']),
        ("invalid_price", "price", ~fully_matches(t["price"], r"\d+(?:\.\d+)?"), ['price "', t["price"], '" is not a decimal number']),
        (
            "price_minor_units", "price", F.col("_decimals") > F.col("_units"),
            ['price "', t["price"], '" has ', F.col("_decimals").cast("string"), " decimal places; ", F.col("_code"), " allows at most ", F.col("_units").cast("string")],
        ),
        ("price_out_of_range", "price", F.col("_amount").isNull(), ['price "', t["price"], '" is too large']),
        ("negative_stock", "stock", t["stock"].startswith("-"), ['stock "', t["stock"], '" is negative']),
        ("invalid_stock", "stock", ~fully_matches(t["stock"], r"\d+"), ['stock "', t["stock"], '" is not a whole number of units']),
        ("stock_out_of_range", "stock", F.col("_count").isNull(), ['stock "', t["stock"], '" is too large']),
        ("invalid_timestamp", "updated_at", F.col("_millis").isNull(), ['updated_at "', F.col("updated_at"), '" is not an ISO-8601 timestamp']),
        ("invalid_text", None, F.concat("sku", "name", "category").contains("\x00"), ["the row holds a NUL character"]),
    ]


def prepare(rows: DataFrame) -> DataFrame:
    """Add the trimmed and converted values that the checks read."""
    trimmed = rows.withColumns({f"_{c}": trim_unicode(F.col(c)) for c in _TRIMMED})
    timed = with_millis(trimmed, "_updated_at", "_millis")
    return timed.withColumns(
        {
            "_code": F.upper("_currency"),
            "_units": minor_units(F.upper("_currency")),
            "_decimals": F.length(F.regexp_extract("_price", r"\A\d+\.(\d+)\z", 1)),
            "_amount": F.col("_price").try_cast(S.MONEY),
            "_count": F.col("_stock").try_cast("int"),
        }
    )


def validate(rows: DataFrame) -> DataFrame:
    """`rows` (seven string columns, null where a field is missing) with `failed`, the number of the first failing check or
    null, and normalised values that hold for valid rows: _sku, _amount decimal(20,4), _code, _count int, _millis long.

    `failed` mentions the partition id, which never changes its value: an expression that isn't deterministic is
    neither copied into later expressions nor pushed below the projections that it reads, so that no pattern is matched twice.
    """
    chain = F.coalesce(*[F.when(bad, F.lit(i)) for i, (_, _, bad, _) in enumerate(_checks(), 1)])
    return prepare(rows).withColumn("failed", F.when(F.spark_partition_id() >= 0, chain))


def _by_number(values: list[str | None]) -> Column:
    return F.when(F.col("failed").isNotNull(), F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), F.col("failed")))


def error_code() -> Column:
    """The code of a validated row; null if it is valid."""
    return _by_number([c[0] for c in _checks()])


def error_column() -> Column:
    return _by_number([c[1] for c in _checks()])


def error_message() -> Column:
    message = F.lit(None).cast("string")
    for i, (_, _, _, parts) in reversed(list(enumerate(_checks(), 1))):
        message = F.when(F.col("failed") == i, F.concat(*[F.lit(m) if isinstance(m, str) else m for m in parts])).otherwise(message)
    return message


def valid_rows(validated: DataFrame, *keep: str) -> DataFrame:
    """The typed rows of a feed: sku, name, category, price, currency, stock, updated_at, millis, and the `keep` columns."""
    return validated.where("failed is null").select(
        *keep, F.col("_sku").alias("sku"), "name", "category", F.col("_amount").alias("price"), F.col("_code").alias("currency"),
        F.col("_count").alias("stock"), F.timestamp_millis("_millis").alias("updated_at"), F.col("_millis").alias("millis"),
    )


def rejections(validated: DataFrame, *keep: str, raw_line: Column | None = None) -> DataFrame:
    """The `keep` columns, error_code, error_message, column_name and raw_line of the rejected rows."""
    raw = raw_line if raw_line is not None else csv_line(F.array(*S.REQUIRED))
    return validated.where("failed is not null").select(
        *keep, error_code().alias("error_code"), error_message().alias("error_message"), error_column().alias("column_name"), F.substring(raw, 1, S.MAX_RAW_LINE).alias("raw_line")
    )
