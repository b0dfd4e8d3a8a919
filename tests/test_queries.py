"""Every registered query over the order tables equals its SQL twin on the smallest data."""

import os

import duckdb
import pytest

from feedweir.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v if isinstance(v, int | str | type(None)) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["validate_feed_codes", "validate_feed_rejects", "normalize_feed", "tally_batched", "upsert_freshness_insert_update", "idempotent_submit", "list_imports_before", "token_consume_join", "tally_invariant", "unparseable_sequence", "unnest_arrays", "csv_scan", "short_row_detect", "csv_long_rows", "csv_unparseable", "csv_blank_lines", "csv_resume", "csv_header"])
def test_equals_sql(spark, duck, name):
    frame, found = catalog.QUERIES[name](spark, DATA), duck.sql(catalog.ORACLES[name])
    assert sorted(frame.columns) == sorted(found.columns)
    ours = sorted(repr(tuple(plain(r[c]) for c in sorted(frame.columns))) for r in map(lambda r: r.asDict(), frame.collect()))
    at = [found.columns.index(c) for c in sorted(found.columns)]
    assert ours == sorted(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())


def test_every_query_has_sql():
    assert catalog.QUERIES.keys() == catalog.ORACLES.keys() and len(catalog.QUERIES) >= 45
