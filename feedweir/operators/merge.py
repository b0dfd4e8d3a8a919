"""Latest-wins, the freshness-guarded merge, and the accounting of both.

The functions are pure: stored and incoming tables in, new table and tally out. The merge shuffles once, on
(merchant, sku), so one large merchant spreads over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedweir.sources.scratch import written

ATTRIBUTES = ("name", "category", "price", "currency", "stock", "updated_at")


def latest_wins(rows: DataFrame, keys: list[str], newest: str = "updated_at", tie: str = "row_number") -> DataFrame:
    """One row per key: the newest; of equally new ones that with the least `tie`."""
    order = Window.partitionBy(*keys).orderBy(F.col(newest).desc(), F.col(tie).asc())
    return rows.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def merge_fresh(stored: DataFrame, incoming: DataFrame, keys: list[str], attributes: tuple[str, ...] = ATTRIBUTES, newest: str = "updated_at", stamp: dict | None = None) -> DataFrame:
    """Insert or update: an incoming row (one per key) replaces the stored one only if it is strictly newer.

    The result has the columns of `stored`, and `applied` (true where the incoming row was taken). `stamp` gives
    expressions that a taken row gets besides its attributes, such as the time of ingestion.
    """
    stamp = stamp or {}
    old = stored.select(*[F.col(c).alias(f"o_{c}") for c in stored.columns], F.lit(True).alias("o_there"))
    new = incoming.select(*[F.col(c).alias(f"n_{c}") for c in [*keys, *attributes]], F.lit(True).alias("n_there"))
    on = [F.col(f"o_{k}") == F.col(f"n_{k}") for k in keys]
    taken = F.col("n_there").isNotNull() & (F.col("o_there").isNull() | (F.col(f"n_{newest}") > F.col(f"o_{newest}")))
    both = old.join(new, on, "full_outer").withColumn("applied", F.coalesce(taken, F.lit(False)))

    def choose(c: str):
        if c in keys:
            return F.coalesce(f"o_{c}", f"n_{c}")
        if c in attributes:
            return F.when(F.col("applied"), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}"))
        return F.when(F.col("applied"), stamp[c]).otherwise(F.col(f"o_{c}")) if c in stamp else F.col(f"o_{c}")

    return both.select(*[choose(c).alias(c) for c in stored.columns], "applied")


def merge_counts(merged: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: candidates (rows after latest-wins), applied."""
    return candidates.agg(F.count("*").alias("candidates")).crossJoin(merged.agg(F.count_if("applied").alias("applied")))


def with_ordinals(valid: DataFrame, row_number: str = "row_number", parts: int | None = None, rows_per_range: int = 500_000) -> DataFrame:
    """Add `ordinal`, the 1-based position among valid rows, without gathering them in one task.

    The rows are written once. Quantiles of the row numbers cut them into ranges (`parts`, or as many as have about `rows_per_range`
    rows); the ranges' counts are added up (one row a range), and rows are numbered inside their range. Rows of one number stand in one range.
    """
    rows = written(valid, "valid-rows")
    ranges = parts or -(-rows.count() // rows_per_range)
    bounds = sorted(set(rows.approxQuantile(row_number, [i / ranges for i in range(1, ranges)], 0.1 / ranges))) if ranges > 1 else []
    part = F.lit(0) if not bounds else F.size(F.filter(F.array(*[F.lit(int(b)) for b in bounds]), lambda b: b < F.col(row_number)))
    cut = rows.withColumn("_part", part)
    counts = cut.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    base = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(row_number))
    return cut.join(F.broadcast(base), "_part").withColumn("ordinal", F.col("_base") + within).drop("_part", "_base")


def batch_tally(valid: DataFrame, batch_rows: int | None, stored: DataFrame | None = None, by: list[str] | None = None, key: str = "sku", newest: str = "updated_at", ordinal: str = "ordinal") -> DataFrame:
    """valid, applied, superseded as a sequence of merges of `batch_rows` valid rows each would count them.

    In every batch the newest row of a key is the candidate; it is applied if nothing stored or in an earlier batch is
    as new. None means a single batch. `by` are further key columns, and the columns to tally by.
    """
    by = by or []
    number = F.lit(0).cast("long") if batch_rows is None else F.floor((F.col(ordinal) - 1) / F.lit(batch_rows)).cast("long")
    best = valid.withColumn("_batch", number).groupBy(*by, key, "_batch").agg(F.max(newest).alias("_m"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*by, key).orderBy("_batch").rowsBetween(Window.unboundedPreceding, -1)
    seen = best.withColumn("_seen", F.max("_m").over(earlier))
    if stored is not None:
        seen = seen.join(stored.select(*by, key, F.col(newest).alias("_stored")), [*by, key], "left").withColumn("_seen", F.greatest("_seen", "_stored"))
    applied = F.count_if(F.col("_seen").isNull() | (F.col("_m") > F.col("_seen")))
    tally = seen.groupBy(*by) if by else seen
    counted = tally.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("valid"), applied.alias("applied"))
    return counted.withColumn("superseded", F.col("valid") - F.col("applied"))


def balances(read: int, unparseable: int, applied: int, superseded: int, rejected: int) -> bool:
    """Every row read and every unparseable line is applied, superseded or rejected."""
    return read + unparseable == applied + superseded + rejected


def constraint_violations(products: DataFrame) -> DataFrame:
    """Stored rows that no import should have let through."""
    return products.where((F.col("price") < 0) | (F.col("stock") < 0))
