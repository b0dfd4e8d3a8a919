import pytest
from pyspark.sql import functions as F

from feedweir import schema as S
from feedweir.functions import currency, text, timestamps, validation

BASE = {"sku": "A-1001", "name": "Wireless Mouse, Pro", "category": "peripherals", "price": "24.99", "currency": "USD", "stock": "150", "updated_at": "2025-03-01T10:00:00Z"}

#: change to a good row -> code, or the normalised value that shows
CASES = [
    ({}, None), ({"price": "1234567890123.45"}, None), ({"currency": "JPY", "price": "36676"}, None), ({"price": "45"}, None), ({"currency": "KWD", "price": "12.345"}, None),
    ({"currency": "eur"}, None), ({"stock": "0"}, None), ({"name": "two\nlines"}, None), ({"name": ""}, None), ({"category": ""}, None), ({"sku": "  A-1 ", "currency": " usd\t"}, None),
    ({"updated_at": "2025-03-01T10:00:00+05:30"}, None), ({"updated_at": "2025-03-01T10:00:00-08:00"}, None), ({"stock": "007"}, None), ({"name": "n" * 512}, None), ({"sku": "s" * 128}, None),
    ({"price": "-24.99"}, "negative_price"), ({"price": "N/A"}, "invalid_price"), ({"price": "24.999"}, "price_minor_units"), ({"currency": "JPY", "price": "36676.50"}, "price_minor_units"),
    ({"stock": "-12"}, "negative_stock"), ({"stock": "42.5"}, "invalid_stock"), ({"sku": ""}, "missing_sku"), ({"sku": "   "}, "missing_sku"), ({"updated_at": "2025-13-45 99:99"}, "invalid_timestamp"),
    ({"currency": "DOLLARS"}, "invalid_currency"), ({"updated_at": None}, "missing_column"), ({"sku": None, "name": None}, "missing_column"), ({"currency": "XYZ"}, "unknown_currency"),
    ({"updated_at": "2025-02-31T00:00:00Z"}, "invalid_timestamp"), ({"updated_at": "2025-03-01T00:00:00+25:00"}, "invalid_timestamp"), ({"stock": "99999999999"}, "stock_out_of_range"),
    ({"stock": "2147483648"}, "stock_out_of_range"), ({"price": ""}, "invalid_price"), ({"price": "1e5"}, "invalid_price"), ({"price": "1."}, "invalid_price"), ({"price": ".5"}, "invalid_price"),
    ({"sku": "s" * 200}, "sku_too_long"), ({"name": "n" * 513}, "name_too_long"), ({"name": "\U0001f600" * 257}, "name_too_long"), ({"category": "c" * 129}, "category_too_long"),
    ({"price": "7" * 17}, "price_out_of_range"), ({"stock": ""}, "invalid_stock"), ({"name": "a\x00b"}, "invalid_text"), ({"price": "12\n3"}, "invalid_price"), ({"currency": "US"}, "invalid_currency"),
]


def frame(spark, changes):
    rows = [(i, *[(BASE | c)[k] for k in S.REQUIRED]) for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, "row_number long, " + ", ".join(f"{c} string" for c in S.REQUIRED))


def test_codes_of_all_cases(spark):
    checked = validation.validate(frame(spark, [c for c, _ in CASES])).select("row_number", validation.error_code().alias("code"))
    found = {r["row_number"]: r["code"] for r in checked.collect()}
    assert [found[i] for i in range(len(CASES))] == [code for _, code in CASES]


def test_normalised_values(spark):
    rows = validation.valid_rows(validation.validate(frame(spark, [{"sku": " A ", "currency": " eur", "price": "24.9", "updated_at": "2025-03-01T10:00:00+05:30"}])))
    r = rows.select("sku", "price", "currency", "stock", timestamps.iso_millis(F.col("millis")).alias("at"), F.col("updated_at").cast("string").alias("ts")).first()
    assert (r["sku"], str(r["price"]), r["currency"], r["stock"], r["at"], r["ts"]) == ("A", "24.9000", "EUR", 150, "2025-03-01T04:30:00.000Z", "2025-03-01 04:30:00")


def test_messages(spark):
    changes = [{"price": "24.999"}, {"currency": "xyz"}, {"updated_at": " x "}, {"stock": None}]
    rows = validation.rejections(validation.validate(frame(spark, changes)), "row_number").orderBy("row_number").collect()
    assert [r["error_message"] for r in rows] == [
        'price "24.999" has 3 decimal places; USD allows at most 2', '"XYZ" is not an active ISO-4217 code', 'updated_at " x " is not an ISO-8601 timestamp',
        'Row is missing the "stock" column (the row has fewer fields than the header)',
    ]
    assert [r["column_name"] for r in rows] == ["price", "currency", "updated_at", "stock"]
    assert rows[0]["raw_line"] == 'A-1001,"Wireless Mouse, Pro",peripherals,24.999,USD,150,2025-03-01T10:00:00Z'


@pytest.mark.parametrize(
    "given, instant",
    [
        ("2025-03-01 10:00:00", "2025-03-01T10:00:00.000Z"), ("2025-03-01T10:00:00.123Z", "2025-03-01T10:00:00.123Z"), ("2025-03-01t10:00:00z", "2025-03-01T10:00:00.000Z"), ("2025-03-01T10:00", "2025-03-01T10:00:00.000Z"),
        ("2025-03-01T10:00:59.9996Z", "2025-03-01T10:01:00.000Z"), ("2025-03-01T23:59:59.9996Z", None), ("2025-03-01T10:00:00,5 +01:00", "2025-03-01T09:00:00.500Z"), ("2025-03-01T10:00:00+14:59", "2025-02-28T19:01:00.000Z"),
        ("2025-03-01T10:00:00+15:00", None), ("2025-03-01T10:00:60Z", None), ("0099-01-01T00:00:00Z", None), ("0100-01-01T00:00:00Z", "0100-01-01T00:00:00.000Z"), ("2024-02-29T00:00:00Z", "2024-02-29T00:00:00.000Z"),
        ("2025-02-29T00:00:00Z", None), ("yesterday", None), ("", None), ("01/03/2025", None), ("2025-03-01T24:00:00Z", None), ("2025-13-01T00:00:00Z", None), ("2025-03-01", None), ("2025-03-01T10:00:00Z\n", None),
        ("9999-12-31T23:59:00-01:00", None), (None, None),
    ],
)
def test_timestamps(spark, given, instant):
    row = timestamps.with_millis(spark.createDataFrame([(given,)], "t string"), "t", "m").select(timestamps.iso_millis(F.col("m"))).first()
    assert row[0] == instant


def test_currencies(spark):
    assert len(currency.ACTIVE) == len(set(currency.ACTIVE)) == 167
    rows = spark.createDataFrame([(c,) for c in ("USD", "JPY", "KWD", "CLF", "XXX")], "c string").select("c", currency.is_active(F.col("c")), currency.minor_units(F.col("c"))).collect()
    assert [tuple(r) for r in rows] == [("USD", True, 2), ("JPY", True, 0), ("KWD", True, 3), ("CLF", True, 4), ("XXX", False, 2)]


def test_text(spark):
    rows = spark.createDataFrame([("a,b",), ('5" x',), ("p\nq",), ("plain",), (" Söhne & Co! ",), ("!!",)], "t string")
    assert [r[0] for r in rows.select(text.csv_field(F.col("t"))).collect()] == ['"a,b"', '"5"" x"', '"p\nq"', "plain", " Söhne & Co! ", "!!"]
    assert [r[0] for r in rows.select(text.slugify(F.col("t"))).collect()][-2:] == ["s-hne-co", "merchant"]
    assert text.normalize_header(["﻿SKU ", " Name"]) == ["sku", "name"]


def test_empty_feed(spark):
    checked = validation.validate(frame(spark, []))
    assert validation.valid_rows(checked).count() == 0 and validation.rejections(checked, "row_number").count() == 0
