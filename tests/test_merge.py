import random

from pyspark.sql import functions as F

from feedweir.operators import merge, reads, rejections


def sequential(rows, batch, stored):
    """Merge batch after batch, one row at a time."""
    state, applied = dict(stored), 0
    for at in range(0, len(rows), batch):
        best = {}
        for i, (sku, t) in rows[at : at + batch]:
            if sku not in best or t > best[sku][0]:
                best[sku] = (t, i)
        for sku, (t, _) in best.items():
            if sku not in state or t > state[sku]:
                state[sku], applied = t, applied + 1
    return applied, state


def test_batched_tally_equals_a_sequential_run(spark):
    draw = random.Random(7)
    for batch in (3, 10, 64):
        rows = [(i, (f"s{draw.randrange(12)}", draw.randrange(30))) for i in range(1, 120)]
        stored = {f"s{k}": draw.randrange(20) for k in range(4)}
        applied, state = sequential(rows, batch, stored)
        valid = merge.with_ordinals(spark.createDataFrame([(i, s, t) for i, (s, t) in rows], "row_number long, sku string, updated_at long"), parts=5)
        old = spark.createDataFrame(list(stored.items()), "sku string, updated_at long")
        tally = merge.batch_tally(valid, batch, old).first()
        assert (tally["valid"], tally["applied"], tally["superseded"]) == (len(rows), applied, len(rows) - applied)
        merged = merge.merge_fresh(old, merge.latest_wins(valid, ["sku"]), ["sku"], ("updated_at",))
        assert {r["sku"]: r["updated_at"] for r in merged.collect()} == state


def test_ties_and_stale_rows(spark):
    rows = spark.createDataFrame([(1, "a", "first", 5), (2, "a", "second", 5), (3, "b", "x", 1)], "row_number long, sku string, name string, updated_at long")
    best = merge.latest_wins(rows, ["sku"])
    assert {r["sku"]: r["name"] for r in best.collect()} == {"a": "first", "b": "x"}
    stored = spark.createDataFrame([("a", "kept", 5, "old"), ("b", "older", 0, "old")], "sku string, name string, updated_at long, last string")
    merged = {r["sku"]: r for r in merge.merge_fresh(stored, best, ["sku"], ("name", "updated_at"), stamp={"last": F.lit("new")}).collect()}
    assert (merged["a"]["name"], merged["a"]["last"], merged["a"]["applied"]) == ("kept", "old", False)
    assert (merged["b"]["name"], merged["b"]["last"], merged["b"]["applied"]) == ("x", "new", True)


def test_empty_tally(spark):
    none = spark.createDataFrame([], "row_number long, sku string, updated_at long")
    assert tuple(merge.batch_tally(merge.with_ordinals(none), 10).first()) == (0, 0, 0)


def test_merge_shuffles_each_side_once(spark):
    a = spark.range(1000).select(F.col("id").cast("string").alias("sku"), F.lit("m").alias("merchant_id"), F.lit(1).alias("updated_at"))
    plan = merge.merge_fresh(a, merge.latest_wins(a.withColumn("row_number", F.lit(1)), ["merchant_id", "sku"]), ["merchant_id", "sku"], ("updated_at",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "WindowGroupLimit" in plan


def test_reports(spark):
    log = spark.createDataFrame([("i", n, n + 1, "c", "m, x", "col", 'r"w') for n in (5, -1, 2)], "import_id string, row_number long, line_number long, error_code string, error_message string, column_name string, raw_line string")
    assert "".join(rejections.stream_report(log)) == 'row_number,line_number,error_code,column,message,raw_line\n,0,c,col,"m, x","r""w"\n2,3,c,col,"m, x","r""w"\n5,6,c,col,"m, x","r""w"\n'
    assert [r["row_number"] for r in rejections.page(log, after=-1, rows=1).collect()] == [2]
    report = rejections.json_report(log, rows=2)
    assert (report["totalRejected"], len(report["rejections"]), report["truncated"]) == (3, 2, True)
    again = rejections.append_new(log, log.limit(1).unionByName(log.limit(1).withColumn("row_number", F.lit(9).cast("long"))))
    assert again.count() == 4
    lines = rejections.number_unparseable(spark.createDataFrame([(7, "x" * 600), (3, "y")], "line_number long, parse_error string"), -2)
    assert [(r["row_number"], r["line_number"], len(r["error_message"])) for r in lines.orderBy(F.desc("row_number")).collect()] == [(-3, 3, 1), (-4, 7, 500)]


def test_keyset_pages_keep_ties(spark):
    at = spark.sql("select timestamp '2025-01-01 00:00:00' as t").first()["t"]
    imports = spark.createDataFrame([(str(i), "m", "queued", at) for i in range(5)], "id string, merchant_id string, status string, created_at timestamp")
    first = reads.list_imports(imports, limit=2).collect()
    second = reads.list_imports(imports, limit=2, before=(at, first[-1]["id"])).collect()
    assert [r["id"] for r in [*first, *second]] == ["4", "3", "2", "1"]
    assert reads.list_imports(imports, before=(at, None)).count() == 0
