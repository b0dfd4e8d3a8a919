from feedweir.control.config import Config
from feedweir.control.jobs import Imports
from feedweir.control.store import Store
from feedweir.schema import REQUIRED
from feedweir.streaming import ingest


def test_folder_of_files(spark, tmp_path):
    home = tmp_path / "landing" / "m1"
    home.mkdir(parents=True)
    (home / "a.csv").write_text(",".join(REQUIRED) + "\nA,n,c,1,USD,1,2025-03-01T00:00:00Z\n")
    imports = Imports(Store(spark, str(tmp_path / "s")), Config(), str(tmp_path / "up"))
    for _ in range(2):  # the second run finds nothing new
        ingest.watch_folder(spark, str(tmp_path / "landing"), imports, str(tmp_path / "cp")).awaitTermination()
    records = imports.store.records("imports")
    assert [r["status"] for r in records.values()] == ["completed"] and imports.store.table("products", "m1").count() == 1


def test_fresh_rows_of_a_stream(spark, tmp_path):
    columns = "row_number long, sku string, updated_at timestamp"
    source = tmp_path / "in"
    rows = spark.sql("select * from values (1L, 'a', timestamp '2025-01-01'), (2L, 'a', timestamp '2025-01-03'), (3L, 'a', timestamp '2025-01-02'), (4L, 'b', timestamp '2025-01-01') t(row_number, sku, updated_at)")
    rows.coalesce(1).write.parquet(str(source))
    stream = ingest.fresh_rows(spark.readStream.schema(columns).parquet(str(source)), ["sku"], columns)
    query = stream.writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["row_number"] for r in spark.table("fresh").collect()) == [1, 2, 4]
