"""Which texts spell a number."""

from __future__ import annotations

#: What counts as a number, as a pattern inside a SQL literal; nothing else does, whatever a parser of some language
#: may take (``5d``, ``3f``, ``1_000``).
DECIMAL = r"^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$"
UNBOUNDED = r"^\\s*[+-]?(inf|infinity)\\s*$"


def strict_number(e: str) -> str:
    """The number a text spells, NULL when it spells none (an undefined number included)."""
    return f"case when {e} rlike '{DECIMAL}' or lower({e}) rlike '{UNBOUNDED}' then try_cast({e} as double) end"
