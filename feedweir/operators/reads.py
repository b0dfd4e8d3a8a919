"""Tenant-scoped reads over imports, products and accounts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweir import schema as S


def scoped(table: DataFrame, merchant_id: str | None) -> DataFrame:
    """The rows of one merchant; None (staff) sees all."""
    return table if merchant_id is None else table.where(F.col("merchant_id") == merchant_id)


def progress() -> Column:
    """Share of the bytes processed, at most 1, to four places (half up, in whole numbers); 0 for an empty file."""
    share = F.expr("(bytes_processed * 20000 + size_bytes) div (2 * size_bytes)") / F.lit(10000.0)
    return F.when(F.col("size_bytes") > 0, F.least(F.lit(1.0), share)).otherwise(F.lit(0.0))


def list_imports(imports: DataFrame, merchant_id: str | None = None, status: str | None = None, limit: int = 20, before: tuple[datetime, str | None] | None = None) -> DataFrame:
    """Newest first, 1 to 100 rows. `before` is the (created_at, id) of the last row seen; without an id, only
    strictly older rows follow."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    if status is not None and status not in S.STATUSES:
        raise ValueError(f"no such status: {status}")
    found = scoped(imports, merchant_id)
    if status is not None:
        found = found.where(F.col("status") == status)
    if before is not None:
        at, last = before
        older = F.col("created_at") < F.lit(at)
        found = found.where(older if last is None else older | ((F.col("created_at") == F.lit(at)) & (F.col("id") < last)))
    return found.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def present_import(imports: DataFrame) -> DataFrame:
    """An import as the API shows it."""
    return imports.select(
        "id", F.col("merchant_id").alias("merchantId"), F.col("original_filename").alias("filename"), "status", F.col("size_bytes").alias("sizeBytes"),
        F.col("cancel_requested").alias("cancelRequested"), "attempts",
        F.struct(progress().alias("fraction"), F.col("bytes_processed").alias("bytesProcessed"), F.col("rows_read").alias("rowsRead")).alias("progress"),
        F.struct(F.col("rows_applied").alias("rowsApplied"), F.col("rows_superseded").alias("rowsSuperseded"), F.col("rows_rejected").alias("rowsRejected"), F.col("rows_unparseable").alias("rowsUnparseable")).alias("result"),
        "error", F.col("created_at").alias("createdAt"), F.col("started_at").alias("startedAt"), F.col("finished_at").alias("finishedAt"),
    )


def products(table: DataFrame, merchant_id: str | None = None, sku: str | None = None, limit: int = 50) -> DataFrame:
    """Products by sku, 1 to 200 rows; prices as text with four places."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be 1 to 200")
    found = scoped(table, merchant_id)
    if sku is not None:
        found = found.where(F.col("sku") == sku)
    return found.orderBy("sku", "merchant_id").limit(limit).select(
        F.col("merchant_id").alias("merchantId"), "sku", "name", "category", F.col("price").cast("string").alias("price"), "currency", "stock",
        F.col("updated_at").alias("updatedAt"), F.col("ingested_at").alias("ingestedAt"), F.col("last_import_id").alias("lastImportId"),
    )


def claimable(now: Column) -> Column:
    """A queued import, or one in progress whose lease is absent or past, that nobody asked to cancel."""
    free = F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") < now)
    return ~F.col("cancel_requested") & ((F.col("status") == "queued") | ((F.col("status") == "processing") & free))


def claim_next(imports: DataFrame, now: Column) -> DataFrame:
    return imports.where(claimable(now)).orderBy("created_at", "id").limit(1)


def after_cancel(status: Column) -> Column:
    """A queued import is cancelled at once; one in progress goes on to its next batch."""
    return F.when(status == "queued", F.lit("cancelled")).otherwise(status)


def user_with_merchant(users: DataFrame, merchants: DataFrame) -> DataFrame:
    named = merchants.select(F.col("id").alias("merchant_id"), F.col("name").alias("merchant_name"), F.col("slug").alias("merchant_slug"))
    return users.drop("password_hash").join(named, "merchant_id", "left")


def by_email(users: DataFrame, email: str) -> DataFrame:
    return users.where(F.lower("email") == email.lower())


def usable_tokens(tokens: DataFrame, users: DataFrame, token_hash: bytes, now: Column) -> DataFrame:
    """The owner of a refresh token that is neither revoked nor expired."""
    live = tokens.where((F.col("token_hash") == F.lit(token_hash)) & F.col("revoked_at").isNull() & (F.col("expires_at") > now))
    owner = users.select(F.col("id").alias("user_id"), "role", "merchant_id")
    return live.select(F.col("id").alias("token_id"), "user_id").join(owner, "user_id")


def cascade(children: DataFrame, gone: DataFrame, child_key: str, parent_key: str = "id") -> DataFrame:
    """Children whose parent isn't among the deleted ones."""
    return children.join(gone.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def first_submissions(submissions: DataFrame, tenant: str, digest: str, arrival: str, salts: int = 16) -> DataFrame:
    """Per tenant and content the first to arrive; every submission gets its id and whether it is a repeat.

    Minima are pre-aggregated; only contents that came more than once are joined back, each spread over `salts` tasks, so a file that
    is sent again and again is no single task's work."""
    repeats = submissions.groupBy(tenant, digest).agg(F.min(arrival).alias("_first"), F.count("*").alias("_times")).where("_times > 1")
    right = repeats.select(F.col(tenant).alias("_t"), F.col(digest).alias("_d"), "_first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    salt = F.pmod(F.xxhash64(arrival), F.lit(salts)).cast("int")
    same = submissions[tenant].eqNullSafe(F.col("_t")) & submissions[digest].eqNullSafe(F.col("_d")) & (salt == F.col("_salt"))
    both = submissions.join(right, same, "left").withColumn("import_id", F.coalesce("_first", arrival))
    return both.withColumn("deduplicated", F.col(arrival) != F.col("import_id")).drop("_t", "_d", "_first", "_salt")


def role_violations(users: DataFrame) -> DataFrame:
    """Users whose role and merchant contradict each other: only merchant users have a merchant."""
    return users.where((F.col("role") == "merchant_user") != F.col("merchant_id").isNotNull())
