"""Versioned files on the driver: writes that happen only if nobody wrote in between. The one part that is not a DataFrame."""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import os
import tempfile
from collections.abc import Iterator
from pathlib import Path


class Conflict(RuntimeError):
    """The file is not in the state that the write was made for."""


class Store:
    """Files under one folder; a version is the SHA-256 of the bytes."""

    def __init__(self, root: str):
        self.root = Path(root).resolve()
        self.root.mkdir(parents=True, exist_ok=True)

    def _place(self, path: str) -> Path:
        place = (self.root / path).resolve()
        if self.root not in place.parents:
            raise ValueError(f"{path} leads out of the store")
        return place

    def read(self, path: str) -> tuple[bytes, str] | None:
        place = self._place(path)
        if not place.is_file():
            return None
        data = place.read_bytes()
        return data, hashlib.sha256(data).hexdigest()

    def list(self, prefix: str = "") -> list[str]:
        found = (p.relative_to(self.root).as_posix() for p in self.root.rglob("*") if p.is_file() and not p.name.startswith(".tmp-"))
        return sorted(p for p in found if p.startswith(prefix))

    def create(self, path: str, data: bytes) -> str:
        """Write a file that must not exist."""
        place = self._place(path)
        place.parent.mkdir(parents=True, exist_ok=True)
        temporary = self._temporary(place, data)
        try:
            os.link(temporary, place)  # fails where the name is taken
        except FileExistsError:
            raise Conflict(f"{path} exists") from None
        finally:
            os.unlink(temporary)
        return hashlib.sha256(data).hexdigest()

    def replace(self, path: str, data: bytes, version: str) -> str:
        """Write a file whose version must be ``version``."""
        with self._locked(path):
            now = self.read(path)
            if now is None or now[1] != version:
                raise Conflict(f"{path} is not at {version[:12]}")
            os.replace(self._temporary(self._place(path), data), self._place(path))
        return hashlib.sha256(data).hexdigest()

    def delete(self, path: str, version: str) -> None:
        with self._locked(path):
            now = self.read(path)
            if now is None or now[1] != version:
                raise Conflict(f"{path} is not at {version[:12]}")
            self._place(path).unlink()

    @contextlib.contextmanager
    def _locked(self, path: str) -> Iterator[None]:
        """One writer at a time between check and write. The lock is the operating system's, so it ends with its process."""
        name = hashlib.sha256(self._place(path).as_posix().encode()).hexdigest()[:32]
        with open(self.root / f".tmp-lock-{name}", "w") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            yield

    @staticmethod
    def _temporary(place: Path, data: bytes) -> str:
        handle, name = tempfile.mkstemp(prefix=".tmp-", dir=place.parent)
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        return name
