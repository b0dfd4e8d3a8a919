"""Tables, limits and enumerations of the catalog."""

from __future__ import annotations

from pyspark.sql import types as T

#: Columns every feed must declare, in the order in which absences are reported (fixed values).
REQUIRED = ("sku", "name", "category", "price", "currency", "stock", "updated_at")
MAX_SKU, MAX_NAME, MAX_CATEGORY = 128, 512, 128
MAX_RAW_LINE, MAX_PARSER_MESSAGE = 2000, 500
MAX_INT = 2_147_483_647

ROLES = ("merchant_user", "platform_staff")
STATUSES = ("queued", "processing", "completed", "failed", "cancelled")
FINISHED = ("completed", "failed", "cancelled")

MONEY = T.DecimalType(20, 4)

TABLES = {
    "merchants": "id string, name string, slug string, created_at timestamp",
    "users": "id string, email string, password_hash string, role string, merchant_id string, created_at timestamp",
    "refresh_tokens": "id string, user_id string, token_hash binary, expires_at timestamp, revoked_at timestamp, created_at timestamp",
    "products": "merchant_id string, sku string, name string, category string, price decimal(20,4), currency string, stock int, updated_at timestamp, ingested_at timestamp, last_import_id string",
    "imports": (
        "id string, merchant_id string, uploaded_by string, original_filename string, content_sha256 string, size_bytes long, storage_path string, status string, "
        "cancel_requested boolean, header_columns array<string>, bytes_processed long, rows_read long, rows_applied long, rows_superseded long, rows_rejected long, "
        "rows_unparseable long, locked_by string, lease_expires_at timestamp, attempts int, error string, created_at timestamp, started_at timestamp, finished_at timestamp"
    ),
    "import_rejections": "import_id string, row_number long, line_number long, error_code string, error_message string, column_name string, raw_line string",
}
