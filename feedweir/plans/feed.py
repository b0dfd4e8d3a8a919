"""A feed derived from the order tables, in SQL that Spark and DuckDB read alike.

Every damage that a feed can have is put in by a modulus of the keys, so each rejection code occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedweir.functions.currency import ACTIVE, FOUR_DECIMALS, NO_DECIMALS, THREE_DECIMALS
from feedweir.sources.scratch import dealt, tuned

#: Text columns of the feed, row_id (unique) and merchant_id.
FEED_SQL = r"""
with base as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_shipdate,
    ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey as row_id,
    cast(round(l_extendedprice * 100) as bigint) as cents, cast(l_quantity as bigint) as quantity,
    (l_orderkey * 7 + l_linenumber * 3 + l_partkey) % 40 as k, l_orderkey % 7 as c, l_linenumber % 6 as f from lineitem),
text as (
  select *, concat('M', cast(l_suppkey % 10 as string)) as merchant_id,
    case c when 0 then 'USD' when 1 then 'EUR' when 2 then 'GBP' when 3 then 'JPY' when 4 then 'KWD' when 5 then ' eur ' else 'inr' end as good_currency,
    cast(cast(floor(cents / 100) as bigint) as string) as units, lpad(cast(cents % 100 as string), 2, '0') as hundredths,
    concat(lpad(cast(year(l_shipdate) as string), 4, '0'), '-', lpad(cast(month(l_shipdate) as string), 2, '0'), '-', lpad(cast(day(l_shipdate) as string), 2, '0')) as day from base),
priced as (select *, case when c = 3 then units else concat(units, '.', hundredths) end as good_price from text)
select row_id, merchant_id,
  case k when 1 then '  ' when 2 then repeat('x', 129) when 15 then concat(' SKU-', cast(l_partkey as string), ' ') else concat('SKU-', cast(l_partkey as string)) end as sku,
  case k when 3 then repeat('n', 513) when 4 then concat('Part "', cast(l_partkey as string), '", boxed') else concat('Part ', cast(l_partkey as string)) end as name,
  case k when 5 then repeat('c', 129) else concat(l_returnflag, l_linestatus) end as category,
  case k when 6 then '' when 7 then concat('-', good_price) when 8 then 'N/A' when 9 then concat(good_price, case when c = 3 then '.50' else '99' end) when 10 then repeat('7', 17) else good_price end as price,
  case k when 11 then 'DOLLARS' when 12 then 'XYZ' else good_currency end as currency,
  case k when 13 then concat('-', cast(quantity as string)) when 14 then concat(cast(quantity as string), '.5') when 16 then '99999999999' when 17 then '' when 18 then concat('00', cast(quantity as string)) else cast(quantity as string) end as stock,
  case k when 19 then '2025-13-45 99:99' when 20 then '2025-02-31T00:00:00Z' when 21 then concat(day, 'T23:59:59.9996Z') when 22 then concat(day, 'T10:00:60Z') when 23 then concat(day, 'T10:00:00+15:00') when 24 then null when 25 then concat(day, 'T10:00:00+14:59')
    else concat(day, case f when 0 then 'T10:00:00Z' when 1 then ' 10:00:59.9996' when 2 then 't23:15:30.5z' when 3 then 'T00:10+05:30' when 4 then 'T22:00:00,123456789 -08:00' else ' 07:08:09' end) end as updated_at
from priced
"""


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = dealt(tuned(spark).read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey", "l_linenumber")
    return spark.sql(FEED_SQL.replace("from lineitem", "from {lineitem}"), lineitem=lines)


def _quoted(codes: list[str]) -> str:
    return ", ".join(f"'{c}'" for c in codes)


_EDGE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
SHAPE = r"\A(\d{4})-(\d{2})-(\d{2})[Tt ](\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?" + _EDGE + r"*(?:[Zz]|([+-])(\d{2}):\d{2})?\z"


def _part(i: int) -> str:
    return f"regexp_extract(t_updated_at, '{SHAPE}', {i})"


def _trimmed(c: str) -> str:
    return f"regexp_replace({c}, '\\A{_EDGE}+|{_EDGE}+\\z', '', 'g') as t_{c}"


#: DuckDB: the feed with trimmed columns (t_), millis (null if updated_at is no instant), units and code, message, column of the first failing check.
VALIDATED_SQL = f"""
feed as ({FEED_SQL}),
trimmed as (select *, {", ".join(map(_trimmed, ("sku", "currency", "price", "stock", "updated_at")))} from feed),
parts as (
  select *, try_cast({_part(1)} as int) as y, try_cast({_part(2)} as int) as mo, try_cast({_part(3)} as int) as d, try_cast({_part(4)} as int) as h, try_cast({_part(5)} as int) as mi,
    coalesce(try_cast({_part(6)} as int), 0) as s, cast(floor((cast(rpad({_part(7)}, 9, '0') as bigint) + 500000) / 1000000) as bigint) as ms, {_part(8)} as sign,
    coalesce(try_cast({_part(9)} as int), 0) as oh, coalesce(try_cast(regexp_extract(t_updated_at, '[+-]\\d\\d:(\\d\\d)\\z', 1) as int), 0) as om,
    try_cast({_part(1)} || '-' || {_part(2)} || '-' || {_part(3)} as date) as day from trimmed),
timed as (
  select *, case when y >= 100 and mo between 1 and 12 and day is not null and h <= 23 and mi <= 59 and s <= 59 and oh <= 14 and om <= 59 and ((h * 60 + mi) * 60 + s) * 1000 + ms < 86400000
    then cast(date_diff('day', date '1970-01-01', day) as bigint) * 86400000 + ((h * 60 + mi) * 60 + s) * 1000 + ms - (oh * 60 + om) * 60000 * case when sign = '-' then -1 else 1 end end as millis,
    case when upper(t_currency) in ({_quoted(NO_DECIMALS)}) then 0 when upper(t_currency) in ({_quoted(THREE_DECIMALS)}) then 3 when upper(t_currency) in ({_quoted(FOUR_DECIMALS)}) then 4 else 2 end as units,
    length(regexp_extract(t_price, '\\A\\d+\\.(\\d+)\\z', 1)) as decimals from parts),
coded as (
  select *, case
    {" ".join(f"when {c} is null then 'missing_column:{c}'" for c in ("sku", "name", "category", "price", "currency", "stock", "updated_at"))}
    when t_sku = '' then 'missing_sku:sku' when length(t_sku) > 128 then 'sku_too_long:sku' when length(name) > 512 then 'name_too_long:name' when length(category) > 128 then 'category_too_long:category'
    when not regexp_matches(t_currency, '\\A[A-Za-z]{{3}}\\z') then 'invalid_currency:currency' when upper(t_currency) not in ({_quoted(ACTIVE)}) then 'unknown_currency:currency'
    when t_price = '' then 'invalid_price:price' when starts_with(t_price, '-') then 'negative_price:price' when not regexp_matches(t_price, '\\A\\d+(\\.\\d+)?\\z') then 'invalid_price:price'
    when decimals > units then 'price_minor_units:price' when try_cast(t_price as decimal(20, 4)) is null then 'price_out_of_range:price'
    when starts_with(t_stock, '-') then 'negative_stock:stock' when not regexp_matches(t_stock, '\\A\\d+\\z') then 'invalid_stock:stock' when try_cast(t_stock as int) is null then 'stock_out_of_range:stock'
    when millis is null then 'invalid_timestamp:updated_at' end as failed from timed),
validated as (
  select *, split_part(failed, ':', 1) as code, split_part(failed, ':', 2) as col, case split_part(failed, ':', 1)
    when 'missing_column' then 'Row is missing the "' || split_part(failed, ':', 2) || '" column (the row has fewer fields than the header)'
    when 'missing_sku' then 'sku is empty; every row must identify a product' when 'sku_too_long' then 'sku exceeds 128 characters'
    when 'name_too_long' then 'name exceeds 512 characters' when 'category_too_long' then 'category exceeds 128 characters'
    when 'invalid_currency' then 'currency "' || t_currency || '" is not a 3-letter ISO-4217 code' when 'unknown_currency' then '"' || upper(t_currency) || '" is not an active ISO-4217 code'
    when 'negative_price' then 'price "' || t_price || '" is negative' when 'invalid_price' then case when t_price = '' then 'price is empty' else 'price "' || t_price || '" is not a decimal number' end
    when 'price_minor_units' then 'price "' || t_price || '" has ' || decimals || ' decimal places; ' || upper(t_currency) || ' allows at most ' || units
    when 'price_out_of_range' then 'price "' || t_price || '" is too large' when 'negative_stock' then 'stock "' || t_stock || '" is negative'
    when 'invalid_stock' then 'stock "' || t_stock || '" is not a whole number of units' when 'stock_out_of_range' then 'stock "' || t_stock || '" is too large'
    when 'invalid_timestamp' then 'updated_at "' || updated_at || '" is not an ISO-8601 timestamp' end as message from coded),
valid as (
  select row_id, merchant_id, t_sku as sku, name, category, try_cast(t_price as decimal(20, 4)) as price, upper(t_currency) as currency, try_cast(t_stock as int) as stock, millis from validated where failed is null)
"""
