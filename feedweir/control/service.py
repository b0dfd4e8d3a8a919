"""The functions behind each endpoint, for any web front end: they take a caller and return plain values or DataFrames."""

from __future__ import annotations

import time
from collections.abc import Iterator
from datetime import datetime
from typing import BinaryIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweir.control.errors import ApiError
from feedweir.control.identity import Caller, check_row, merchant_for_read, merchant_for_write
from feedweir.control.jobs import Imports
from feedweir.operators import reads, rejections


class Service:
    def __init__(self, imports: Imports):
        self.imports, self.store, self._began = imports, imports.store, time.monotonic()

    def health(self) -> dict:
        self.store.spark.range(1).count()
        return {"status": "ok", "uptimeSeconds": round(time.monotonic() - self._began)}

    def submit(self, caller: Caller, files: list[tuple[str, BinaryIO]], merchant_id: str | None = None) -> list[dict]:
        merchant = merchant_for_write(caller, merchant_id)
        if merchant not in self.store.records("merchants"):
            raise ApiError(404, "not_found", "no such merchant")
        return [{"id": r["id"], "status": r["status"], "filename": r["original_filename"], "deduplicated": again} for r, again in self.imports.submit_files(merchant, caller.user_id, files)]

    def list_imports(self, caller: Caller, merchant_id: str | None = None, status: str | None = None, limit: int = 20, before: tuple[datetime, str | None] | None = None) -> DataFrame:
        scope = merchant_for_read(caller, merchant_id)
        try:
            return reads.present_import(reads.list_imports(self.store.control("imports"), scope, status, limit, before))
        except ValueError as e:
            raise ApiError(400, "validation_failed", str(e)) from e

    def _own(self, caller: Caller, import_id: str) -> dict:
        record = self.imports.get(import_id)
        if record is None:
            raise ApiError(404, "not_found", "not found")
        check_row(caller, record["merchant_id"])
        return record

    def get_import(self, caller: Caller, import_id: str) -> dict:
        self._own(caller, import_id)
        found = reads.present_import(self.store.control("imports").where(F.col("id") == import_id))
        return found.first().asDict(recursive=True)

    def rejections_json(self, caller: Caller, import_id: str) -> dict:
        self._own(caller, import_id)
        return rejections.json_report(self.store.table("import_rejections", import_id))

    def rejections_csv(self, caller: Caller, import_id: str) -> Iterator[str]:
        self._own(caller, import_id)
        return rejections.stream_report(self.store.table("import_rejections", import_id))

    def cancel(self, caller: Caller, import_id: str) -> dict:
        self._own(caller, import_id)
        changed = self.imports.request_cancel(import_id)
        if changed is None:
            raise ApiError(409, "conflict", "the import has ended")
        return {"id": import_id, "status": changed["status"], "cancelRequested": True}

    def products(self, caller: Caller, merchant_id: str | None = None, sku: str | None = None, limit: int = 50) -> DataFrame:
        scope = merchant_for_read(caller, merchant_id)
        try:
            return reads.products(self.store.table("products", scope), scope, sku, limit)
        except ValueError as e:
            raise ApiError(400, "validation_failed", str(e)) from e
