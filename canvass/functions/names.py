"""Column names for passing use."""

from __future__ import annotations

from collections.abc import Iterable


def unused(taken: Iterable[str], stem: str) -> str:
    """A name that no column of the input has, whatever its case."""
    have = {c.lower() for c in taken}
    name = stem
    while name.lower() in have:
        name += "_"
    return name
