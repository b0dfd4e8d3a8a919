"""Schema versions of a store: numbered steps that run once each, in order of their names."""

from __future__ import annotations

import hashlib
import inspect
import json
import os
from collections.abc import Callable
from pathlib import Path

from feedweir.control.store import Store, now_text

Step = Callable[[Store], None]


class ChangedMigration(RuntimeError):
    """A step that ran already has other code now."""


def _checksum(step: Step) -> str:
    return hashlib.sha256(inspect.getsource(step).encode()).hexdigest()


def applied(store: Store) -> dict[str, dict]:
    return {p.stem: json.loads(p.read_text()) for p in sorted((store.root / "migrations").glob("*.json"))}


def migrate(store: Store, steps: dict[str, Step], now) -> list[str]:
    """Run the steps that haven't run yet, and return their names. A lock file keeps a second runner out."""
    folder = Path(store.root) / "migrations"
    folder.mkdir(exist_ok=True)
    lock = folder / ".lock"
    os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
    try:
        done, ran = applied(store), []
        for name in sorted(steps):
            checksum = _checksum(steps[name])
            if name in done:
                if done[name]["checksum"] != checksum:
                    raise ChangedMigration(name)
                continue
            steps[name](store)
            (folder / f"{name}.json").write_text(json.dumps({"checksum": checksum, "applied_at": now_text(now())}))
            ran.append(name)
        return ran
    finally:
        lock.unlink()


# The steps of this version, run in the order of their names.


def identity(store: Store) -> None:
    """Accounts have a key of their own before the first one registers: every control table exists in a commit."""
    store.commit({t: {} for t in ("merchants", "users", "refresh_tokens")})


def imports(store: Store) -> None:
    """Imports that an older version left without the number of lines read go on from their header."""
    late = {k: r | {"lines_read": 1} for k, r in store.records("imports").items() if r.get("bytes_processed") and "lines_read" not in r}
    store.commit({"imports": late})


def folders(store: Store) -> None:
    """Remains of crashed writers go."""
    store.vacuum()


STEPS: dict[str, Step] = {"0001_identity": identity, "0002_imports": imports, "0003_folders": folders}
