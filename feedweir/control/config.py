"""Settings of an engine instance."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    batch_rows: int = 20_000
    window_bytes: int = 256 << 20
    split_bytes: int = 64 << 20
    lease_seconds: int = 30
    poll_seconds: float = 0.5
    backoff_seconds: float = 2.0
    max_attempts: int = 5
    max_upload_bytes: int = 3 << 30
    max_files: int = 20
    access_token_seconds: int = 900
    refresh_token_seconds: int = 14 * 86_400
    #: At least 32 and 8 characters.
    token_secret: str = ""
    staff_code: str = ""

    def checked(self) -> Config:
        if self.batch_rows < 1:
            raise ValueError("batch_rows must be positive")
        if len(self.token_secret) < 32:
            raise ValueError("token_secret needs 32 characters at least")
        if len(self.staff_code) < 8:
            raise ValueError("staff_code needs 8 characters at least")
        return self
