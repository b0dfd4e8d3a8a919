"""Errors with the status that a web front end would send."""

from __future__ import annotations


class ApiError(Exception):
    def __init__(self, status: int, code: str, message: str, details: object = None):
        super().__init__(message)
        self.status, self.code, self.message, self.details = status, code, message, details

    def envelope(self) -> dict:
        return {"error": {"code": self.code, "message": self.message} | ({"details": self.details} if self.details is not None else {})}
