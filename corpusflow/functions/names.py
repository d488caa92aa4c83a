"""Column names that cannot clash."""

from __future__ import annotations

from collections.abc import Iterable


def free(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores behind it until no column of ``taken`` has that name, whatever the case."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name += "_"
    return name
