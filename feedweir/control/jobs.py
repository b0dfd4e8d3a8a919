"""Imports: submitting, claiming, running, resuming, cancelling and retrying.

A run goes through its file in windows of bytes. Each window ends where a batch of `batch_rows` valid rows ends (or with the file),
so the tally is that of merging batch by batch, whatever the window; catalog, rejections and counters of a window
appear in one commit, and a crash loses the open window at most.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from typing import BinaryIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweir.control.config import Config
from feedweir.control.errors import ApiError
from feedweir.control.store import Conflict, Store, now_text
from feedweir.functions import validation
from feedweir.operators import merge, rejections
from feedweir.schema import FINISHED, TABLES
from feedweir.sources import delimited, uploads
from feedweir.sources.scratch import tuned

Clock = Callable[[], datetime]


@dataclass(frozen=True)
class Outcome:
    kind: str  # completed, cancelled or paused
    record: dict


class Imports:
    def __init__(self, store: Store, config: Config, folder: str, clock: Clock = lambda: datetime.now(timezone.utc), worker: str | None = None):
        self.store, self.config, self.folder, self.clock = store, config, folder, clock
        self.worker = worker or f"worker-{uuid.uuid4().hex[:8]}"

    # submitting

    def submit(self, merchant_id: str, user_id: str, filename: str, source: BinaryIO) -> tuple[dict, bool]:
        """Store an upload and queue it; the same bytes of the same merchant are one import: (record, deduplicated)."""
        try:
            upload = uploads.store_upload(source, self.folder, merchant_id, self.config.max_upload_bytes)
        except uploads.TooLarge as e:
            raise ApiError(413, "payload_too_large", str(e)) from e
        except uploads.EmptyUpload as e:
            raise ApiError(400, "bad_request", str(e)) from e
        while True:
            for r in self.store.records("imports").values():
                if (r["merchant_id"], r["content_sha256"]) == (merchant_id, upload.sha256):
                    return r, True
            record = {f.split()[0]: None for f in TABLES["imports"].split(", ")} | {
                "id": str(uuid.uuid4()), "merchant_id": merchant_id, "uploaded_by": user_id, "original_filename": filename, "content_sha256": upload.sha256, "size_bytes": upload.size,
                "storage_path": upload.path, "status": "queued", "cancel_requested": False, "bytes_processed": 0, "rows_read": 0, "rows_applied": 0, "rows_superseded": 0, "rows_rejected": 0,
                "rows_unparseable": 0, "attempts": 0, "created_at": now_text(self.clock()),
            }
            if self._put(record, expect=self.store.version()):
                return record, False

    def submit_files(self, merchant_id: str, user_id: str, files: list[tuple[str, BinaryIO]]) -> list[tuple[dict, bool]]:
        """Each file is an import of its own; those before one that fails stay."""
        if not files:
            raise ApiError(400, "bad_request", "no files were sent")
        if len(files) > self.config.max_files:
            raise ApiError(413, "payload_too_large", f"at most {self.config.max_files} files")
        return [self.submit(merchant_id, user_id, name, source) for name, source in files]

    # state

    def _put(self, record: dict, expect: int | None = None, **folders) -> bool:
        try:
            self.store.commit({"imports": {record["id"]: record}}, expect=expect, **folders)
        except Conflict:
            return False
        return True

    def get(self, import_id: str) -> dict | None:
        return self.store.records("imports").get(import_id)

    def _change(self, import_id: str, change: Callable[[dict], dict | None]) -> dict | None:
        """Apply a change to the newest record until no other commit comes between; None leaves it."""
        while True:
            expect, record = self.store.version(), self.get(import_id)
            new = change(record) if record else None
            if new is None:
                return None
            if self._put(new, expect):
                return new

    def request_cancel(self, import_id: str) -> dict | None:
        """Queued: cancelled at once. Processing: flagged for the next batch. Finished or unknown: None."""

        def change(r: dict) -> dict | None:
            if r["status"] in FINISHED:
                return None
            done = r["status"] == "queued"
            return r | {"cancel_requested": True} | ({"status": "cancelled", "finished_at": now_text(self.clock())} if done else {})

        return self._change(import_id, change)

    def _free(self, r: dict) -> bool:
        return r["lease_expires_at"] is None or datetime.fromisoformat(r["lease_expires_at"]) < self.clock()

    def sweep_cancelled(self) -> list[str]:
        """Imports whose cancellation nobody is left to notice, because their worker died: cancelled now."""
        found = [r["id"] for r in self.store.records("imports").values() if r["status"] == "processing" and r["cancel_requested"] and self._free(r)]
        return [i for i in found if self._change(i, lambda r: r | self._ended("cancelled", None) if r["status"] == "processing" and self._free(r) else None)]

    def _ended(self, status: str, error: str | None) -> dict:
        return {"status": status, "error": error, "locked_by": None, "lease_expires_at": None, "finished_at": now_text(self.clock())}

    def claim(self) -> dict | None:
        """The oldest import that is queued, or in progress without a live lease, and not to be cancelled."""
        while True:
            expect = self.store.version()
            able = [r for r in self.store.records("imports").values() if not r["cancel_requested"] and (r["status"] == "queued" or r["status"] == "processing" and self._free(r))]
            if not able:
                return None
            r = min(able, key=lambda x: (x["created_at"], x["id"]))
            taken = r | self._lease() | {"status": "processing", "attempts": r["attempts"] + 1, "started_at": r["started_at"] or now_text(self.clock())}
            if self._put(taken, expect):
                return taken

    def _lease(self) -> dict:
        return {"locked_by": self.worker, "lease_expires_at": now_text(self.clock() + timedelta(seconds=self.config.lease_seconds))}

    def finish(self, import_id: str, status: str, error: str | None = None) -> dict | None:
        return self._change(import_id, lambda r: r | self._ended(status, error))

    def release(self, import_id: str, error: str) -> dict | None:
        """Give an import back; it stays in progress and can be claimed at once."""
        return self._change(import_id, lambda r: r | {"locked_by": None, "lease_expires_at": None, "error": error} if r["status"] == "processing" else None)

    # running

    def run(self, job: dict, should_stop: Callable[[], bool] = lambda: False, on_window: Callable[[dict], None] | None = None) -> Outcome:
        spark, path = tuned(self.store.spark), job["storage_path"]
        header, byte, line = delimited.read_header(path)
        delimited.check_header(header)
        record = job
        if record["bytes_processed"]:
            header, byte, line = record["header_columns"], record["bytes_processed"], record["lines_read"]
        window = self.config.window_bytes
        while True:
            current = self.get(job["id"])
            if current["locked_by"] != self.worker:
                raise Conflict("another worker holds this import")
            if current["cancel_requested"]:
                return Outcome("cancelled", current)
            if should_stop():
                return Outcome("paused", current)
            if byte >= record["size_bytes"]:
                return Outcome("completed", current)
            split = min(self.config.split_bytes, max(1 << 20, min(window, record["size_bytes"] - byte) // (2 * spark.sparkContext.defaultParallelism)))  # work for all cores
            rows = delimited.read_records(spark, path, startByte=byte, startRow=record["rows_read"], startLine=line, maxBytes=window, splitBytes=split).persist()
            try:
                step = self._window(record, header, rows, window)
            finally:
                rows.unpersist()
            if step is None:
                window *= 2
                continue
            record, line = step
            byte = record["bytes_processed"]
            if on_window:
                on_window(record)

    def _window(self, record: dict, header: list[str], rows: DataFrame, window: int) -> tuple[dict, int] | None:
        """Merge and commit one window; None if it holds no whole batch and the file goes on."""
        last = rows.agg(F.max("byte_end"), F.max("line_number")).first()
        end, line = last[0] or record["size_bytes"], last[1] or record.get("lines_read") or 1
        at_end = end >= record["size_bytes"] or end - record["bytes_processed"] < window
        checked = validation.validate(delimited.by_name(rows.where("parse_error is null"), header)).persist()
        try:
            valid = merge.with_ordinals(validation.valid_rows(checked, "row_number", "byte_end", "line_number").drop("millis"))
            if not at_end:
                n = valid.count() // self.config.batch_rows * self.config.batch_rows
                if not n:
                    return None
                end, line = valid.where(F.col("ordinal") == n).select("byte_end", "line_number").first()
            inside = F.col("byte_end") <= end
            return self._merge_window(record, header, end if not at_end else record["size_bytes"], line, checked.where(inside), valid.where(inside), rows.where(inside & F.col("parse_error").isNotNull()))
        finally:
            checked.unpersist()

    def _merge_window(self, record: dict, header: list[str], end: int, line: int, checked: DataFrame, valid: DataFrame, broken: DataFrame) -> tuple[dict, int]:
        merchant, now = record["merchant_id"], self.clock()
        before = self.store.folders("products").get(merchant, [])
        stored = self.store.resolved(before)
        incoming = valid.withColumn("merchant_id", F.lit(merchant))
        tally = merge.batch_tally(incoming, self.config.batch_rows, stored, ["merchant_id"]).agg(F.sum("applied"), F.sum("superseded")).first()
        merged = merge.merge_fresh(stored, merge.latest_wins(incoming, ["merchant_id", "sku"]), ["merchant_id", "sku"], stamp={"ingested_at": F.lit(now), "last_import_id": F.lit(record["id"])})
        after = self.store.layered(before, merged.where("applied").drop("applied"))
        log = self.store.table("import_rejections", record["id"])
        unparseable = rejections.number_unparseable(broken, rejections.least_negative(log).first()[0])
        refused = validation.rejections(checked, "row_number", "line_number", raw_line=F.col("raw_line")).unionByName(unparseable).withColumn("import_id", F.lit(record["id"]))
        counts = checked.agg(F.count("*"), F.count_if(F.col("failed").isNotNull())).first()
        n_broken = broken.count()
        append = {}
        if counts[1] or n_broken:
            known = log.select("import_id", "row_number")
            fresh = refused.join(known, ["import_id", "row_number"], "left_anti").select(*[f.split()[0] for f in TABLES["import_rejections"].split(", ")])
            append = {"import_rejections": {record["id"]: [self.store.write_folder("import_rejections", fresh)]}}
        while True:
            expect, newest = self.store.version(), self.get(record["id"])
            if newest["locked_by"] != self.worker or newest["bytes_processed"] != record["bytes_processed"]:
                raise Conflict("another worker went on with this import")
            new = newest | self._lease() | {
                "bytes_processed": end, "lines_read": line, "header_columns": newest["header_columns"] or header, "rows_read": newest["rows_read"] + counts[0],
                "rows_applied": newest["rows_applied"] + (tally[0] or 0), "rows_superseded": newest["rows_superseded"] + (tally[1] or 0),
                "rows_rejected": newest["rows_rejected"] + counts[1] + n_broken, "rows_unparseable": newest["rows_unparseable"] + n_broken,
            }
            if self.store.folders("products").get(merchant, []) != before:
                raise Conflict("another import of the merchant came between")
            if self._put(new, expect, replace={"products": {merchant: after}}, append=append):
                return new, line

    def process_next(self, should_stop: Callable[[], bool] = lambda: False, on_window: Callable[[dict], None] | None = None) -> bool:
        """Claim one import and run it to an end, a pause or a failure; False if there was none."""
        self.sweep_cancelled()
        job = self.claim()
        if job is None:
            return False
        if not os.path.exists(job["storage_path"]):
            self.finish(job["id"], "failed", "Uploaded file is no longer on disk")
            return True
        try:
            outcome = self.run(job, should_stop, on_window)
        except delimited.UnusableFile as e:
            self.finish(job["id"], "failed", str(e))
        except Conflict as e:  # nothing is wrong with the file: its turn comes again
            self._change(job["id"], lambda r: r | {"locked_by": None, "lease_expires_at": None, "error": str(e), "attempts": r["attempts"] - 1} if r["status"] == "processing" and r["locked_by"] == self.worker else None)
        except Exception as e:
            if job["attempts"] >= self.config.max_attempts:
                self.finish(job["id"], "failed", f"After {job['attempts']} attempts: {e}")
            else:
                self.release(job["id"], str(e))
        else:
            if outcome.kind == "paused":
                self.release(job["id"], "Worker shut down; will resume")
            else:
                self.finish(job["id"], outcome.kind)
        return True

    def work(self, should_stop: Callable[[], bool]) -> None:
        """Run imports until told to stop."""
        while not should_stop():
            try:
                busy = self.process_next(should_stop)
            except Conflict:
                time.sleep(self.config.backoff_seconds)
                continue
            if not busy:
                time.sleep(self.config.poll_seconds)
