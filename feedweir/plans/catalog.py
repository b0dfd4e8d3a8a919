"""The registered queries over the order, event and document tables, each with its SQL twin for DuckDB."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweir.functions import currency, text, timestamps, validation
from feedweir.operators import merge, reads, rejections
from feedweir.plans.feed import FEED_SQL, VALIDATED_SQL, feed
from feedweir.plans.files import HEADER, ORDER, PLACED_SQL, read_files, write_files
from feedweir.schema import REQUIRED
from feedweir.sources import delimited
from feedweir.sources.scratch import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _checked(spark: SparkSession, d: str, merchant_id: str | None = None) -> DataFrame:
    """Checked rows, of one merchant if it is named: filters don't pass the checks, so this one stands before them."""
    return validation.validate(reads.scoped(feed(spark, d), merchant_id))


def _valid(spark: SparkSession, d: str, merchant_id: str | None = None) -> DataFrame:
    """Valid rows with `millis` for updated_at, so that no time zone matters."""
    return validation.valid_rows(_checked(spark, d, merchant_id), "row_id", "merchant_id").drop("updated_at")


def _at(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")


def _at_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%g')"


# validation


@query(f"with {VALIDATED_SQL} select coalesce(code, 'ok') as code, cast(count(*) as bigint) as n from validated group by 1")
def validate_feed_codes(spark, d):
    return _checked(spark, d).groupBy(F.coalesce(validation.error_code(), F.lit("ok")).alias("code")).agg(F.count("*").alias("n"))


def _raw() -> Column:
    return text.csv_line(F.array(*REQUIRED))


def _q(c: str) -> str:
    return f"""case when regexp_matches(coalesce({c}, ''), '[",\r\n]') then '"' || replace({c}, '"', '""') || '"' else coalesce({c}, '') end"""


_LINE = " || ',' || ".join(_q(c) for c in REQUIRED)


@query(f"with {VALIDATED_SQL} select row_id, code as error_code, message as error_message, col as column_name, substring({_LINE}, 1, 2000) as raw_line from validated where failed is not null")
def validate_feed_rejects(spark, d):
    return validation.rejections(_checked(spark, d), "row_id")


_ISO = "strftime(make_timestamp(millis * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


@query(f"with {VALIDATED_SQL} select row_id, sku, name, category, cast(price as varchar) as price, currency, stock, {_ISO} as updated_at from valid")
def normalize_feed(spark, d):
    return _valid(spark, d).select("row_id", "sku", "name", "category", F.col("price").cast("string").alias("price"), "currency", "stock", timestamps.iso_millis(F.col("millis")).alias("updated_at"))


_UNITS = ", ".join(f"('{c}', {0 if c in currency.NO_DECIMALS else 3 if c in currency.THREE_DECIMALS else 4 if c in currency.FOUR_DECIMALS else 2})" for c in currency.ACTIVE)


@query(f"with {VALIDATED_SQL} select upper(t_currency) as code, u.units, cast(count(*) as bigint) as n from validated join (values {_UNITS}) as u(code, units) on u.code = upper(t_currency) group by 1, 2")
def currency_minor_units(spark, d):
    code = F.upper(text.trim_unicode(F.col("currency")))
    return feed(spark, d).where(currency.is_active(code)).groupBy(code.alias("code"), currency.minor_units(code).alias("units")).agg(F.count("*").alias("n"))


@query(f"with {VALIDATED_SQL} select case when code in ('invalid_price', 'negative_price', 'price_minor_units', 'price_out_of_range') then code else 'ok' end as verdict, coalesce(decimals, 0) as decimals, cast(count(*) as bigint) as n from validated group by 1, 2")
def price_scale_check(spark, d):
    code = validation.error_code()
    verdict = F.when(code.isin("invalid_price", "negative_price", "price_minor_units", "price_out_of_range"), code).otherwise("ok")
    return _checked(spark, d).groupBy(verdict.alias("verdict"), F.coalesce(F.col("_decimals").cast("long"), F.lit(0)).alias("decimals")).agg(F.count("*").alias("n"))


@query(f"with {VALIDATED_SQL} select merchant_id, code, cast(count(*) as bigint) as n from validated where col = 'stock' group by 1, 2")
def stock_check(spark, d):
    rows = _checked(spark, d).select("merchant_id", validation.error_code().alias("code"), validation.error_column().alias("col"))
    return rows.where("col = 'stock'").groupBy("merchant_id", "code").agg(F.count("*").alias("n"))


@query(f"with {VALIDATED_SQL} select row_id, millis from validated where updated_at is not null")
def timestamp_parse_utc(spark, d):
    rows = feed(spark, d).where("updated_at is not null").withColumn("trimmed", text.trim_unicode(F.col("updated_at")))
    return timestamps.with_millis(rows, "trimmed", "millis").select("row_id", "millis")


@query(f"with {VALIDATED_SQL} select updated_at, {_ISO} as instant, cast(count(*) as bigint) as n from validated where regexp_matches(updated_at, '[+-]\\d\\d:\\d\\d\\z') and millis is not null group by 1, 2")
def timestamp_offset_normalize(spark, d):
    rows = feed(spark, d).where(F.col("updated_at").rlike(r"[+-]\d\d:\d\d\z")).withColumn("trimmed", text.trim_unicode(F.col("updated_at")))
    return timestamps.with_millis(rows, "trimmed", "millis").where("millis is not null").groupBy("updated_at", timestamps.iso_millis(F.col("millis")).alias("instant")).agg(F.count("*").alias("n"))


# text


@query(f"with feed as ({FEED_SQL}) select row_id, {_q('name')} as quoted from feed")
def rfc4180_quote(spark, d):
    return feed(spark, d).select("row_id", text.csv_field(F.col("name")).alias("quoted"))


@query(f"with feed as ({FEED_SQL}) select row_id, {_LINE} as line from feed")
def reconstruct_line(spark, d):
    return feed(spark, d).select("row_id", _raw().alias("line"))


_SLUG = "case when {0} = '' then 'merchant' else {0} end".format("substring(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '\\A-+|-+\\z', '', 'g'), 1, 48)")


@query(f"with n as (select s_name as name from supplier union all select n_name from nation union all select '  ' || c_mktsegment || ' & Söhne!' from customer) select name, {_SLUG} as slug, cast(count(*) as bigint) as n from n group by 1, 2")
def slugify_names(spark, d):
    names = _t(spark, d, "supplier").select(F.col("s_name").alias("name")).union(_t(spark, d, "nation").select("n_name")).union(_t(spark, d, "customer").select(F.concat(F.lit("  "), "c_mktsegment", F.lit(" & Söhne!"))))
    return names.groupBy("name", text.slugify(F.col("name")).alias("slug")).agg(F.count("*").alias("n"))


_HEADERS = "list_filter(['sku', 'name', 'category', 'price', 'currency', 'stock', 'updated_at'], lambda c, i: i <> n_nationkey % 9 and i <> n_regionkey + 1)"


@query(f"select n_nationkey, array_to_string(list_filter(['sku', 'name', 'category', 'price', 'currency', 'stock', 'updated_at'], lambda c: not list_contains({_HEADERS}, c)), ',') as missing from nation")
def header_missing_columns(spark, d):
    every = F.array(*map(F.lit, REQUIRED))
    header = F.filter(every, lambda c, i: (i + 1 != F.col("n_nationkey") % 9) & (i + 1 != F.col("n_regionkey") + 1))
    return _t(spark, d, "nation").select("n_nationkey", F.array_join(F.array_except(every, header), ",").alias("missing"))


# files: the feed is written as dirty files, and read back through the source


@query(f"with {PLACED_SQL} select merchant_id, row_number, line_number, byte_end, n_fields, sku, long_name as name, price from placed where not broken")
def csv_scan(spark, d):
    rows, header = read_files(spark, d)
    by_name = delimited.by_name(rows.where("parse_error is null"), header, "merchant_id", "n_fields")
    return by_name.select("merchant_id", "row_number", "line_number", "byte_end", "n_fields", "sku", "name", "price")


@query(f"with {PLACED_SQL} select merchant_id, row_number, line_number, n_fields from placed where not broken and n_fields < 7")
def short_row_detect(spark, d):
    rows, header = read_files(spark, d)
    return rows.where("parse_error is null").where(delimited.is_short(header)).select("merchant_id", "row_number", "line_number", "n_fields")


@query(f"with {PLACED_SQL} select merchant_id, row_number, n_fields, updated_at from placed where not broken and n_fields > 7")
def csv_long_rows(spark, d):
    rows, header = read_files(spark, d)
    return delimited.by_name(rows.where(F.col("n_fields") > len(header)), header, "merchant_id", "n_fields").select("merchant_id", "row_number", "n_fields", F.nullif("updated_at", F.lit("")).alias("updated_at"))


@query(f"with {PLACED_SQL} select merchant_id, -row_number() over (partition by merchant_id order by line_number) as row_number, line_number, 'unparseable_line' as error_code from placed where broken")
def csv_unparseable(spark, d):
    parts = []
    for merchant, path in write_files(spark, d):
        lines = delimited.read_records(spark, path, splitBytes=1 << 20).where("parse_error is not null")
        parts.append(rejections.number_unparseable(lines).select(F.lit(merchant).alias("merchant_id"), "row_number", "line_number", "error_code"))
    return functools.reduce(DataFrame.unionByName, parts)


@query(f"with {PLACED_SQL} select merchant_id, cast(max(line_number) - 1 as bigint) as lines, cast(sum(blank) as bigint) as blank_lines, cast(count(*) as bigint) as records from placed group by 1")
def csv_blank_lines(spark, d):
    """Lines that are neither a record's first nor inside one are blank."""
    rows, header = read_files(spark, d)
    inside = F.when(F.col("parse_error").isNull(), F.aggregate("fields", F.lit(0).cast("long"), lambda n, f: n + F.length(f) - F.length(F.replace(f, F.lit("\n"), F.lit(""))))).otherwise(0)
    counted = rows.groupBy("merchant_id").agg((F.max("line_number") - 1).alias("lines"), F.count("*").alias("records"), F.sum(inside).alias("inside"))
    return counted.select("merchant_id", "lines", (F.col("lines") - F.col("records") - F.col("inside")).alias("blank_lines"), "records")


@query(f"with {PLACED_SQL}, half as (select merchant_id, max(byte_end) as upto from placed where row_number <= 400 group by 1) select merchant_id, row_number, line_number, byte_end from placed join half using (merchant_id) where not broken and byte_end > upto")
def csv_resume(spark, d):
    """Read on after the 400th record, from its position alone."""
    parts = []
    for merchant, path in write_files(spark, d):
        rows = delimited.read_records(spark, path)
        at = rows.where("row_number <= 400").agg(F.max(F.struct("byte_end", "row_number", "line_number")).alias("s")).select("s.*").first()
        rest = delimited.read_records(spark, path, startByte=at["byte_end"], startRow=at["row_number"], startLine=at["line_number"], splitBytes=1 << 20)
        parts.append(rest.where("parse_error is null").select(F.lit(merchant).alias("merchant_id"), "row_number", "line_number", "byte_end"))
    return functools.reduce(DataFrame.unionByName, parts)


@query(f"with {PLACED_SQL} select distinct merchant_id, '{','.join(ORDER)}' as header, {len(HEADER.encode()) + 2} as data_begins from placed")
def csv_header(spark, d):
    found = [(merchant, *delimited.read_header(path)[:2]) for merchant, path in write_files(spark, d)]
    return spark.createDataFrame([(m, ",".join(h), at) for m, h, at in found], "merchant_id string, header string, data_begins int")


@query("select doc_id, cast(length(text) + length(regexp_replace(text, '[\\x{0000}-\\x{FFFF}]', '', 'g')) as int) as units, length(text) as chars from documents")
def utf16_lengths(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.utf16_length(F.col("text")).alias("units"), F.length("text").cast("long").alias("chars"))


@query("select sha256(text) as sha, cast(count(*) as bigint) as n, min(doc_id) as first_doc from documents group by 1")
def sha_dedup_documents(spark, d):
    return _t(spark, d, "documents").groupBy(text.sha256_hex(F.col("text")).alias("sha")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


# latest wins and merge


@query(f"select user_id, event_type, event_id, {_at_sql('ts')} as at, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id) = 1")
def latest_wins_events(spark, d):
    return merge.latest_wins(_t(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", _at("ts").alias("at"), "value")


@query(f"with {VALIDATED_SQL} select merchant_id, sku, row_id, cast(price as varchar) as price, stock, millis from valid qualify row_number() over (partition by merchant_id, sku order by millis desc, row_id) = 1")
def latest_wins_feed(spark, d):
    rows = merge.latest_wins(_valid(spark, d), ["merchant_id", "sku"], "millis", "row_id")
    return rows.select("merchant_id", "sku", "row_id", F.col("price").cast("string").alias("price"), "stock", "millis")


_HALF = "select user_id, event_type, ts, value from events where event_id % 2 = {} qualify row_number() over (partition by user_id, event_type order by ts desc, event_id) = 1"


def _merge_sql(stored: int, incoming: int) -> str:
    return f"""o as ({_HALF.format(stored)}), n as ({_HALF.format(incoming)}),
merged as (select coalesce(o.user_id, n.user_id) as user_id, coalesce(o.event_type, n.event_type) as event_type,
  n.user_id is not null and (o.user_id is null or n.ts > o.ts) as applied, o.ts as o_ts, n.ts as n_ts, o.value as o_value, n.value as n_value
  from o full join n on o.user_id = n.user_id and o.event_type = n.event_type)"""


def _halves(spark, d, stored: int, incoming: int) -> tuple[DataFrame, DataFrame]:
    half = lambda r: merge.latest_wins(_t(spark, d, "events").where(F.col("event_id") % 2 == r), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "ts", "value")
    return half(stored), half(incoming)


def _merged(spark, d, stored: int, incoming: int) -> DataFrame:
    return merge.merge_fresh(*_halves(spark, d, stored, incoming), ["user_id", "event_type"], ("ts", "value"), "ts")


_CHOSEN = f"select user_id, event_type, {_at_sql('case when applied then n_ts else o_ts end')} as at, case when applied then n_value else o_value end as value, applied from merged"


@query(f"with {_merge_sql(0, 1)} {_CHOSEN}")
def upsert_freshness_insert_update(spark, d):
    return _merged(spark, d, 0, 1).select("user_id", "event_type", _at("ts").alias("at"), "value", "applied")


@query(f"with {_merge_sql(1, 0)} {_CHOSEN}")
def upsert_stale_noop(spark, d):
    return _merged(spark, d, 1, 0).select("user_id", "event_type", _at("ts").alias("at"), "value", "applied")


@query(f"with {_merge_sql(0, 1)} select (select cast(count(*) as bigint) from n) as candidates, (select cast(count(*) as bigint) from merged where applied) as applied")
def merge_counts(spark, d):
    _, incoming = _halves(spark, d, 0, 1)
    return merge.merge_counts(_merged(spark, d, 0, 1), incoming)


def _tally_sql(batch: str, by: str = "", valid: str = "valid") -> str:
    part = f"{by}, " if by else ""
    return f"""ordered as (select *, row_number() over (order by row_id) as o from {valid}),
best as (select {part}sku, {batch} as b, max(millis) as m, count(*) as n from ordered group by all),
seen as (select *, max(m) over (partition by {part}sku order by b rows between unbounded preceding and 1 preceding) as prev from best),
tally as (select {part}cast(sum(n) as bigint) as valid, cast(count(*) filter (prev is null or m > prev) as bigint) as applied from seen {"group by " + by if by else ""})
"""


@query(f"with {VALIDATED_SQL}, {_tally_sql('0', 'merchant_id')} select merchant_id, valid, applied, valid - applied as superseded from tally")
def tally_by_merchant(spark, d):
    return merge.batch_tally(_valid(spark, d), None, by=["merchant_id"], newest="millis")


@query(f"with {VALIDATED_SQL}, {_tally_sql('0')} select valid, applied, valid - applied as superseded from tally")
def tally_single_batch(spark, d):
    return merge.batch_tally(_valid(spark, d), None, newest="millis")


@query(f"with {VALIDATED_SQL}, {_tally_sql('floor((o - 1) / 500)')} select valid, applied, valid - applied as superseded from tally")
def tally_batched(spark, d):
    return merge.batch_tally(merge.with_ordinals(_valid(spark, d).select("row_id", "sku", "millis"), "row_id"), 500, newest="millis")


@query(f"""with {VALIDATED_SQL}, {_tally_sql('0', 'merchant_id')} select v.merchant_id, cast(count(*) as bigint) as rows_read, any_value(t.applied) as applied, any_value(t.valid - t.applied) as superseded,
cast(count(*) filter (failed is not null) as bigint) as rejected, cast(count(*) as bigint) = any_value(t.valid) + cast(count(*) filter (failed is not null) as bigint) as balances
from validated v join tally t on t.merchant_id = v.merchant_id group by 1""")
def tally_invariant(spark, d):
    rows = written(_checked(spark, d).select("merchant_id", "failed", F.col("_sku").alias("sku"), F.col("_millis").alias("millis")), "checked")
    checked = rows.groupBy("merchant_id").agg(F.count("*").alias("rows_read"), F.count_if(F.col("failed").isNotNull()).alias("rejected"))
    both = checked.join(merge.batch_tally(rows.where("failed is null"), None, by=["merchant_id"], newest="millis"), "merchant_id")
    return both.select("merchant_id", "rows_read", "applied", "superseded", "rejected", (F.col("rows_read") == F.col("applied") + F.col("superseded") + F.col("rejected")).alias("balances"))


@query(f"with {VALIDATED_SQL}, stored as (select cast(price as decimal(20,4)) - 500 as price, stock - 3 as stock, row_id from valid) select cast(count(*) as bigint) as n, cast(min(row_id) as bigint) as first_row from stored where price < 0 or stock < 0")
def constraint_violations(spark, d):
    stored = _valid(spark, d).select((F.col("price") - 500).cast("decimal(20,4)").alias("price"), (F.col("stock") - 3).alias("stock"), "row_id")
    return merge.constraint_violations(stored).agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))


# submissions


@query("select doc_id, source, first_value(doc_id) over (partition by source, sha256(text) order by doc_id) as import_id, doc_id <> first_value(doc_id) over (partition by source, sha256(text) order by doc_id) as deduplicated from documents")
def idempotent_submit(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source", text.sha256_hex(F.col("text")).alias("sha"))
    return reads.first_submissions(docs, "source", "sha", "doc_id").select("doc_id", "source", "import_id", "deduplicated")


@query("select source, cast(count(distinct sha256(text)) as bigint) as imports, cast(count(*) as bigint) as submissions from documents group by 1")
def cross_tenant_submit(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source", text.sha256_hex(F.col("text")).alias("sha"))
    first = reads.first_submissions(docs, "source", "sha", "doc_id")
    return first.groupBy("source").agg(F.count_if(~F.col("deduplicated")).alias("imports"), F.count("*").alias("submissions"))


# the rejection log

_LOG_SQL = f"{VALIDATED_SQL}, log as (select merchant_id as import_id, row_id as row_number, code as error_code, message as error_message, col as column_name, substring({_LINE}, 1, 2000) as raw_line from validated where failed is not null)"


def _log(spark, d) -> DataFrame:
    rows = _checked(spark, d).withColumns({"row_number": F.col("row_id"), "line_number": F.col("row_id") + 1, "import_id": F.col("merchant_id")})
    return validation.rejections(rows, "import_id", "row_number", "line_number")


@query(f"with {_LOG_SQL} select import_id, row_number, error_code from log where row_number % 3 < 2 union all select import_id, row_number, error_code from log l where row_number % 3 > 0 and not exists (select 1 from log k where k.row_number % 3 < 2 and k.import_id = l.import_id and k.row_number = l.row_number)")
def reject_anti_append(spark, d):
    log = _log(spark, d)
    return rejections.append_new(log.where("row_number % 3 < 2"), log.where("row_number % 3 > 0")).select("import_id", "row_number", "error_code")


@query(f"with {_LOG_SQL} select row_number, error_code, column_name from log where row_number > (select min(row_number) + 1000000 from log) order by row_number limit 2000")
def rejection_report_page(spark, d):
    log = _log(spark, d)
    after = log.agg(F.min("row_number")).first()[0]
    return rejections.page(log, None if after is None else after + 1_000_000).select("row_number", "error_code", "column_name")


@query(f"with {_LOG_SQL} select row_number, error_code, column_name from log order by row_number limit 2000")
def rejection_report_first(spark, d):
    return rejections.page(_log(spark, d)).select("row_number", "error_code", "column_name")


@query(f"with {_LOG_SQL} select row_number, error_code, error_message, (select cast(count(*) as bigint) from log) as total_rejected, (select count(*) > 1000 from log) as truncated from log order by row_number limit 1000")
def rejection_report_json_cap(spark, d):
    log = _log(spark, d)
    total = log.agg(F.count("*").alias("total_rejected")).withColumn("truncated", F.col("total_rejected") > rejections.JSON_ROWS)
    return rejections.page(log, rows=rejections.JSON_ROWS).select("row_number", "error_code", "error_message").crossJoin(F.broadcast(total))  # one row on the right


_REPORT = " || ',' || ".join(["cast(row_number as varchar)", "cast(row_number + 1 as varchar)", *map(_q, ("error_code", "column_name", "error_message", "raw_line"))])


@query(f"with {_LOG_SQL} select {_REPORT} as line from log")
def rejection_report_csv_line(spark, d):
    return rejections.report_lines(_log(spark, d))


_BROKEN = "select doc_id as line_number, substring('broken: ' || text, 1, 500) as parse_error, source from documents"


@query(f"with b as ({_BROKEN}) select cast(-3 - row_number() over (order by line_number) as bigint) as row_number, line_number, 'unparseable_line' as error_code, parse_error as error_message from b")
def unparseable_sequence(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("line_number"), F.concat(F.lit("broken: "), "text").alias("parse_error"))
    return rejections.number_unparseable(docs, -3).select("row_number", "line_number", "error_code", "error_message")


@query("select (select coalesce(min(l), 0) from (select 50 - l_suppkey as l from lineitem) where l < 0) as least, (select coalesce(min(l), 0) from (select l_suppkey as l from lineitem) where l < 0) as none")
def least_negative_row(spark, d):
    lines = _t(spark, d, "lineitem")
    some = rejections.least_negative(lines.select((50 - F.col("l_suppkey")).alias("row_number")))
    none = rejections.least_negative(lines.select(F.col("l_suppkey").alias("row_number"))).withColumnRenamed("least", "none")
    return some.crossJoin(none)  # one row each


@query("select event_id, unnest([event_type, 'x' || event_type]) as code, unnest([value, -value]) as value from events")
def unnest_arrays(spark, d):
    rows = _t(spark, d, "events").select("event_id", F.array("event_type", F.concat(F.lit("x"), "event_type")).alias("code"), F.array(F.col("value"), -F.col("value")).alias("value"))
    return rejections.from_arrays(rows, ["code", "value"])


# imports, products, accounts

_IMPORTS_SQL = """imports as (select cast(o_orderkey as varchar) as id, 'M' || (o_custkey % 10) as merchant_id, o_orderdate as created_at,
  case o_orderkey % 5 when 0 then 'queued' when 1 then 'processing' when 2 then 'completed' when 3 then 'failed' else 'cancelled' end as status, o_orderkey % 7 = 0 as cancel_requested,
  case when o_orderkey % 3 = 0 then null else o_orderdate + interval 30 day end as lease_expires_at, cast(floor(o_totalprice) as bigint) as size_bytes, cast(floor(o_totalprice * (o_custkey % 13) / 9) as bigint) as bytes_processed from orders)"""


def _imports(spark, d) -> DataFrame:
    key = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("queued", "processing", "completed", "failed", "cancelled"))), (key % 5 + 1).cast("int"))
    return _t(spark, d, "orders").select(
        key.cast("string").alias("id"), F.concat(F.lit("M"), (F.col("o_custkey") % 10).cast("string")).alias("merchant_id"), F.col("o_orderdate").alias("created_at"), status.alias("status"),
        (key % 7 == 0).alias("cancel_requested"), F.when(key % 3 != 0, F.expr("o_orderdate + interval 30 days")).alias("lease_expires_at"),
        F.floor("o_totalprice").cast("long").alias("size_bytes"), F.floor(F.col("o_totalprice") * (F.col("o_custkey") % 13) / 9).cast("long").alias("bytes_processed"),
    )


_LISTED = f"select id, merchant_id, status, {_at_sql('created_at')} as at from imports"


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("id", "merchant_id", "status", _at("created_at").alias("at"))


@query(f"with {_IMPORTS_SQL} {_LISTED} order by created_at desc, id desc limit 20")
def list_imports_newest(spark, d):
    return _shown(reads.list_imports(_imports(spark, d)))


@query(f"with {_IMPORTS_SQL} {_LISTED} where merchant_id = 'M3' and status = 'failed' order by created_at desc, id desc limit 100")
def list_imports_by_status(spark, d):
    return _shown(reads.list_imports(_imports(spark, d), "M3", "failed", 100))


@query(f"with {_IMPORTS_SQL} {_LISTED} where created_at < (select max(created_at) - interval 400 day from imports) order by created_at desc, id desc limit 50")
def list_imports_before(spark, d):
    imports = _imports(spark, d)
    at = imports.agg(F.max("created_at") - F.expr("interval 400 days")).first()[0]
    return _shown(reads.list_imports(imports, limit=50, before=(at, None)))


_PRODUCTS = f"products as (select * from valid qualify row_number() over (partition by merchant_id, sku order by millis desc, row_id) = 1)"


def _products(spark, d, merchant_id: str | None = None) -> DataFrame:
    rows = merge.latest_wins(_valid(spark, d, merchant_id), ["merchant_id", "sku"], "millis", "row_id")
    return rows.withColumn("updated_at", F.timestamp_millis("millis")).withColumn("ingested_at", F.col("updated_at")).withColumn("last_import_id", F.lit("I"))


@query(f"with {VALIDATED_SQL}, {_PRODUCTS} select merchant_id as \"merchantId\", sku, name, cast(price as varchar) as price, currency, stock from products order by sku, merchant_id limit 50")
def products_by_sku(spark, d):
    return reads.products(_products(spark, d)).select("merchantId", "sku", "name", "price", "currency", "stock")


@query(f"with {VALIDATED_SQL}, {_PRODUCTS} select merchant_id as \"merchantId\", sku, cast(price as varchar) as price from products where merchant_id = 'M4' order by sku limit 200")
def products_scoped(spark, d):
    return reads.products(_products(spark, d, "M4"), "M4", limit=200).select("merchantId", "sku", "price")


@query(f"with {VALIDATED_SQL}, {_PRODUCTS} select merchant_id as \"merchantId\", sku, cast(price as varchar) as price from products where sku = 'SKU-77' order by sku, merchant_id limit 50")
def product_lookup(spark, d):
    return reads.products(_products(spark, d), sku="SKU-77").select("merchantId", "sku", "price")


_NOW = "timestamp '1995-06-01 00:00:00'"
_CLAIMABLE = f"not cancel_requested and (status = 'queued' or status = 'processing' and (lease_expires_at is null or lease_expires_at < {_NOW}))"


def _now() -> Column:
    return F.expr("timestamp_ntz '1995-06-01 00:00:00'")


@query(f"with {_IMPORTS_SQL} {_LISTED} where {_CLAIMABLE} order by created_at, id limit 1")
def claim_next(spark, d):
    return _shown(reads.claim_next(_imports(spark, d), _now()))


@query(f"with {_IMPORTS_SQL} {_LISTED} where {_CLAIMABLE}")
def lease_expired_null(spark, d):
    return _shown(_imports(spark, d).where(reads.claimable(_now())))


@query(f"with {_IMPORTS_SQL} select status, case when status = 'queued' then 'cancelled' else status end as after, cast(count(*) as bigint) as n from imports group by 1, 2")
def cancel_transition(spark, d):
    return _imports(spark, d).groupBy("status", reads.after_cancel(F.col("status")).alias("after")).agg(F.count("*").alias("n"))


@query(f"with {_IMPORTS_SQL} select id, case when size_bytes > 0 then least(1.0, cast((bytes_processed * 20000 + size_bytes) // (2 * size_bytes) as double) / 10000.0) else 0.0 end as fraction from imports")
def progress_fraction(spark, d):
    return _imports(spark, d).select("id", reads.progress().alias("fraction"))


@query(f"with {_IMPORTS_SQL} select merchant_id, cast(count(*) as bigint) as n from imports where merchant_id = 'M7' group by 1")
def tenant_scope(spark, d):
    return reads.scoped(_imports(spark, d), "M7").groupBy("merchant_id").agg(F.count("*").alias("n"))


_USERS_SQL = """users as (select cast(c_custkey as varchar) as id, case when c_custkey % 2 = 0 then lower(c_name) else c_name end || '@Example.com' as email,
  case when c_custkey % 4 = 0 then 'platform_staff' else 'merchant_user' end as role, case when c_custkey % 4 = 0 and c_custkey % 16 <> 0 then null when c_custkey % 27 = 0 then null else cast(c_nationkey + 3 as varchar) end as merchant_id from customer),
merchants as (select cast(n_nationkey as varchar) as id, n_name as name from nation)"""


def _users(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    staff = k % 4 == 0
    return _t(spark, d, "customer").select(
        k.cast("string").alias("id"), F.concat(F.when(k % 2 == 0, F.lower("c_name")).otherwise(F.col("c_name")), F.lit("@Example.com")).alias("email"), F.lit("h").alias("password_hash"),
        F.when(staff, "platform_staff").otherwise("merchant_user").alias("role"), F.when(staff & (k % 16 != 0), None).when(k % 27 == 0, None).otherwise((F.col("c_nationkey") + 3).cast("string")).alias("merchant_id"),
    )


def _merchants(spark, d) -> DataFrame:
    return _t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), text.slugify(F.col("n_name")).alias("slug"))


@query(f"with {_USERS_SQL} select users.id, users.role, users.merchant_id, merchants.name as merchant_name from users left join merchants on merchants.id = users.merchant_id")
def user_merchant_left_join(spark, d):
    return reads.user_with_merchant(_users(spark, d), _merchants(spark, d)).select("id", "role", "merchant_id", "merchant_name")


@query(f"with {_USERS_SQL} select id, email from users where lower(email) = lower('CUSTOMER#000000042@example.COM') or lower(email) = (select lower(email) from users where id = '17')")
def email_case_insensitive(spark, d):
    users = _users(spark, d)
    mail = users.where("id = '17'").first()["email"].swapcase()
    return reads.by_email(users, mail).unionByName(reads.by_email(users, "CUSTOMER#000000042@example.COM")).select("id", "email")


@query(f"with {_USERS_SQL} select cast(count(*) as bigint) as n, min(id) as first_id from users where (role = 'merchant_user') <> (merchant_id is not null)")
def role_violations(spark, d):
    return reads.role_violations(_users(spark, d)).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


_TOKENS = f"tokens as (select event_id as id, cast(user_id as varchar) as user_id, sha256('token' || (event_id % 50)) as token_hash, ts as expires_at, case when event_id % 3 = 0 then ts end as revoked_at from events)"


@query(f"with {_USERS_SQL}, {_TOKENS} select cast(tokens.id as varchar) as token_id, users.id as user_id, users.role, users.merchant_id from tokens join users on users.id = tokens.user_id where token_hash = sha256('token7') and revoked_at is null and expires_at > timestamp '2024-01-15 00:00:00'")
def token_consume_join(spark, d):
    key = F.col("event_id")
    tokens = _t(spark, d, "events").select(
        key.cast("string").alias("id"), F.col("user_id").cast("string").alias("user_id"), F.unhex(F.sha2(F.concat(F.lit("token"), (key % 50).cast("string")), 256)).alias("token_hash"),
        F.col("ts").alias("expires_at"), F.when(key % 3 == 0, F.col("ts")).alias("revoked_at"),
    )
    return reads.usable_tokens(tokens, _users(spark, d), hashlib.sha256(b"token7").digest(), F.expr("timestamp_ntz '2024-01-15 00:00:00'")).select("token_id", "user_id", "role", "merchant_id")


@query(f"with {_IMPORTS_SQL} select merchant_id, cast(count(*) as bigint) as n from imports where merchant_id not in ('M1', 'M5') group by 1")
def cascade_delete(spark, d):
    imports = _imports(spark, d)
    gone = imports.where(F.col("merchant_id").isin("M1", "M5")).select(F.col("merchant_id").alias("id")).distinct()
    return reads.cascade(imports, gone, "merchant_id").groupBy("merchant_id").agg(F.count("*").alias("n"))
