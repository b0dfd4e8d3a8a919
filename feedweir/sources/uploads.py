"""Content-addressed storage of uploaded files."""

from __future__ import annotations

import hashlib
import os
import uuid
from dataclasses import dataclass
from pathlib import Path
from typing import BinaryIO


@dataclass(frozen=True)
class Upload:
    path: str
    sha256: str
    size: int


class TooLarge(ValueError):
    pass


class EmptyUpload(ValueError):
    pass


def store_upload(source: BinaryIO, folder: str, merchant_id: str, max_bytes: int = 3 << 30, chunk: int = 1 << 20) -> Upload:
    """Copy and hash in one pass to <folder>/<merchant>/<sha256>.csv.

    The file is written under a temporary name and renamed once it is whole. A file that is there already stays; an empty or too
    large upload leaves nothing, and never touches an older file with the same content.
    """
    home = Path(folder) / merchant_id
    home.mkdir(parents=True, exist_ok=True)
    temporary, digest, size = home / f".{uuid.uuid4().hex}.part", hashlib.sha256(), 0
    try:
        with temporary.open("xb") as out:
            while data := source.read(chunk):
                size += len(data)
                if size > max_bytes:
                    raise TooLarge(f"the file is larger than {max_bytes} bytes")
                digest.update(data)
                out.write(data)
            out.flush()
            os.fsync(out.fileno())
        if not size:
            raise EmptyUpload("the file is empty")
        final = home / f"{digest.hexdigest()}.csv"
        if not final.exists():
            os.replace(temporary, final)
        return Upload(str(final), digest.hexdigest(), size)
    finally:
        temporary.unlink(missing_ok=True)


def discard_upload(path: str) -> None:
    Path(path).unlink(missing_ok=True)
