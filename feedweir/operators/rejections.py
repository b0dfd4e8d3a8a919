"""The rejection log: appending, numbering and reporting."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedweir import schema as S
from feedweir.functions.text import csv_field
from feedweir.operators.merge import with_ordinals

PAGE_ROWS, JSON_ROWS = 2000, 1000
REPORT_COLUMNS = ("row_number", "line_number", "error_code", "column", "message", "raw_line")


def append_new(log: DataFrame, rows: DataFrame, keys: tuple[str, ...] = ("import_id", "row_number")) -> DataFrame:
    """The log and those rows whose key it doesn't have; of rows with one key the first by all columns."""
    order = Window.partitionBy(*keys).orderBy(*[F.col(c) for c in rows.columns if c not in keys])
    single = rows.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")
    return log.unionByName(single.join(log.select(*keys), list(keys), "left_anti"))


def number_unparseable(lines: DataFrame, least: int = 0, line: str = "line_number") -> DataFrame:
    """Rejections of unparseable lines: row numbers go down from `least` (0 or the least negative one logged) in the order of the
    lines, numbered by ranges: a file of broken quotes makes every line one."""
    cut = F.substring(F.col("parse_error"), 1, S.MAX_PARSER_MESSAGE)
    number = (F.lit(least) - F.col("ordinal")).cast("long")
    return with_ordinals(lines.select(line, "parse_error"), line).select(number.alias("row_number"), F.col(line).alias("line_number"), F.lit("unparseable_line").alias("error_code"), cut.alias("error_message"), F.lit(None).cast("string").alias("column_name"), F.lit("").alias("raw_line"))


def least_negative(log: DataFrame) -> DataFrame:
    return log.where("row_number < 0").agg(F.coalesce(F.min("row_number"), F.lit(0)).alias("least"))


def page(log: DataFrame, after: int | None = None, rows: int = PAGE_ROWS) -> DataFrame:
    """The next rows by row number: a keyset page."""
    found = log if after is None else log.where(F.col("row_number") > after)
    return found.orderBy("row_number").limit(rows)


def report_line() -> Column:
    """A rejection as a line of the report; row numbers of unparseable lines are blank."""
    number = F.when(F.col("row_number") < 0, F.lit("")).otherwise(F.col("row_number").cast("string"))
    fields = [number, F.col("line_number").cast("string"), F.col("error_code"), F.col("column_name"), F.col("error_message"), F.col("raw_line")]
    return F.concat_ws(",", *[csv_field(F.coalesce(f, F.lit(""))) for f in fields])


def report_lines(log: DataFrame) -> DataFrame:
    """The whole report without its header, sorted by row number: one distributed sort."""
    return log.orderBy("row_number").select(report_line().alias("line"))


def stream_report(log: DataFrame) -> Iterator[str]:
    """The report as one stream of text; partitions come to the driver one after the other."""
    yield ",".join(REPORT_COLUMNS) + "\n"
    for row in report_lines(log).toLocalIterator():
        yield row["line"] + "\n"


def write_report(log: DataFrame, path: str) -> None:
    """The report as CSV part files with headers."""
    number = F.when(F.col("row_number") < 0, F.lit(None)).otherwise(F.col("row_number"))
    named = log.orderBy("row_number").select(number.alias("row_number"), "line_number", "error_code", F.col("column_name").alias("column"), F.col("error_message").alias("message"), "raw_line")
    named.write.csv(path, header=True, escape='"', nullValue="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def json_report(log: DataFrame, rows: int = JSON_ROWS) -> dict:
    """The first rejections, how many there are, and whether the list is cut."""
    total = log.count()
    first = log.orderBy("row_number").limit(rows).collect()
    items = [{"rowNumber": r["row_number"], "lineNumber": r["line_number"], "code": r["error_code"], "column": r["column_name"], "message": r["error_message"], "rawLine": r["raw_line"]} for r in first]
    return {"totalRejected": total, "rejections": items, "truncated": total > len(items)}


def parse_report(text: str) -> list[list[str]]:
    return list(csv.reader(io.StringIO(text)))


def from_arrays(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows from parallel array columns (the table function of batched inserts)."""
    others = [c for c in rows.columns if c not in names]
    return rows.select(*others, F.explode(F.arrays_zip(*names)).alias("_z")).select(*others, *[F.col("_z")[n].alias(n) for n in names])
