"""The feed as dirty files, one for each merchant, in SQL that Spark and DuckDB read alike.

Some records are short or long, follow a blank line, hold a line end in quotes or a carriage return outside them, by a modulus of the row's
key. The header is in another order, in mixed case, with blanks and a byte order mark.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweir.plans.feed import FEED_SQL, feed
from feedweir.sources import delimited
from feedweir.sources.scratch import new_folder

ORDER = ("name", "sku", "price", "currency", "category", "stock", "updated_at")
HEADER = "\ufeffName, SKU ,price,Currency,category,STOCK,updated_at"


def _field(c: str) -> str:
    text = f"coalesce({c}, '')"
    return f"""case when {text} like '%,%' or {text} like '%"%' or {text} like concat('%', chr(10), '%') then concat('"', replace({text}, '"', '""'), '"') else {text} end"""


#: merchant_id, row_id, blank (lines before), breaks (line ends inside), broken, n_fields, line of every row of `feed`.
LINES_SQL = f"""
named as (select *, case when row_id % 19 = 0 then concat(name, chr(10), 'second line') else name end as long_name, row_id % 23 = 0 as broken from feed),
fields as (
  select *, case when row_id % 17 = 0 then 1 else 0 end as blank, case when row_id % 19 = 0 and not broken then 1 else 0 end as breaks,
    case when row_id % 11 = 0 then 6 when row_id % 13 = 0 then 8 else 7 end as n_fields,
    concat({", ',', ".join(_field("long_name" if c == "name" else c) for c in ORDER[:-1])}) as six, {_field("updated_at")} as seventh from named),
lines as (
  select merchant_id, row_id, blank, breaks, broken, n_fields, sku, price, updated_at, long_name,
    case when broken then concat('broken', chr(13), 'record ', cast(row_id as string)) when n_fields = 6 then six when n_fields = 7 then concat(six, ',', seventh) else concat(six, ',', seventh, ',surplus') end as line from fields)
"""

#: DuckDB: the records with the positions that a reader must find.
PLACED_SQL = f"""
feed as ({FEED_SQL}), {LINES_SQL},
placed as (
  select *, cast(case when broken then null else count(*) filter (not broken) over o end as bigint) as row_number, cast(1 + sum(1 + blank + breaks) over o as bigint) as line_number,
    cast({len(HEADER.encode()) + 2} + sum(strlen(line) + 2 + 2 * blank) over o as bigint) as byte_end
  from lines window o as (partition by merchant_id order by row_id rows between unbounded preceding and current row))
"""


def write_files(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    """(merchant, path) of the files: each merchant's lines are sorted and written by one task."""
    lines = spark.sql(f"with {LINES_SQL} select merchant_id, row_id, concat(case when blank = 1 then concat(chr(13), chr(10)) else '' end, line) as value from lines".replace("from feed)", "from {feed})"), feed=feed(spark, sf_dir))
    headers = lines.select("merchant_id").distinct().select("merchant_id", F.lit(-1).cast("long").alias("row_id"), F.lit(HEADER).alias("value"))
    where = new_folder(spark, "feed-files")
    rows = lines.unionByName(headers).repartition("merchant_id").sortWithinPartitions("merchant_id", "row_id")
    rows.select("merchant_id", "value").write.partitionBy("merchant_id").option("lineSep", "\r\n").text(where)
    found = spark.read.text(where).inputFiles()
    return sorted((unquote(f).split("merchant_id=")[1].split("/")[0], f) for f in found)


def read_files(spark: SparkSession, sf_dir: str, split_bytes: int = 1 << 20) -> tuple[DataFrame, list[str]]:
    """The records of all files (merchant_id and the source's columns), read in splits, and the header."""
    parts, header = [], None
    for merchant, path in write_files(spark, sf_dir):
        header = delimited.read_header(path)[0]
        delimited.check_header(header)
        parts.append(delimited.read_records(spark, path, splitBytes=split_bytes).withColumn("merchant_id", F.lit(merchant)))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows, header
