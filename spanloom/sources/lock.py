"""Locks and manifests: which immutable snapshot a build reads, and that artifacts are as listed.

These are small driver-side documents; the data they name is read by Spark."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from pathlib import Path

from .sinks import pretty, write_text

SCHEMA_VERSION = 1


class LockError(ValueError):
    """A lock or manifest that can't be trusted."""


@dataclass(frozen=True)
class Lock:
    dataset: str
    revision: str
    snapshot: Path
    rows: dict[str, int]


def read_lock(path: str | Path) -> Lock:
    """The lock at a path; a relative snapshot is resolved beside the lock."""
    path = Path(path)
    try:
        found = json.loads(path.read_bytes())
    except (OSError, ValueError) as e:
        raise LockError("the lock can't be read") from e
    if not isinstance(found, dict) or found.get("schema_version") != SCHEMA_VERSION:
        raise LockError("unknown lock version")
    for key, kind in (("dataset", str), ("revision", str), ("snapshot", str), ("rows", dict)):
        if not isinstance(found.get(key), kind) or not found[key]:
            raise LockError(f"the lock has no {key}")
    snapshot = Path(found["snapshot"])
    return Lock(found["dataset"], found["revision"], snapshot if snapshot.is_absolute() else path.parent / snapshot, {k: int(v) for k, v in found["rows"].items()})


def write_lock(path: str | Path, lock: Lock) -> None:
    write_text(path, pretty({"schema_version": SCHEMA_VERSION, "dataset": lock.dataset, "revision": lock.revision, "snapshot": str(lock.snapshot), "rows": lock.rows}))


def acquire(path: str | Path, dataset: str, revision: str | None) -> Lock:
    """Offline acquisition: reuse the locked snapshot. A lock of another dataset, or of another
    revision than the one asked for, is refused rather than replaced."""
    lock = read_lock(path)
    if lock.dataset != dataset:
        raise LockError("the lock is of another dataset")
    if revision is not None and lock.revision != revision:
        raise LockError("the lock is of another revision")
    if not lock.snapshot.is_dir():
        raise LockError("the locked snapshot is not there")
    return lock


def file_digest(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def frozen(path: str | Path, expected: str) -> None:
    """Refuse a file that is not the frozen one; call before and after the work."""
    if file_digest(path) != expected:
        raise LockError("the frozen file has changed")


def manifest_faults(folder: str | Path, manifest: dict) -> list[tuple[str, str]]:
    """(name, fault) of listed artifacts that are missing or differ in size or digest."""
    out = []
    for name, entry in sorted(manifest.get("artifacts", {}).items()):
        path = Path(folder) / name
        if path.is_symlink() or not path.is_file():
            out.append((name, "missing"))
        elif path.stat().st_size != entry["bytes"]:
            out.append((name, "bytes"))
        elif file_digest(path) != entry["sha256"]:
            out.append((name, "sha256"))
    return out
