"""Types of text columns, found in the cells by one aggregation.

Every cell belongs to a kind: logical, whole number, real number or text;
missing and blank cells to none. A column's kinds are the bits of one integer,
so that tasks merge them with ``bit_or``, and the type is the narrowest one
that holds all bits: logical and number together are text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.functions.numbers import DECIMAL, strict_number

LOGICAL, WHOLE, REAL, TEXT = 1, 2, 4, 8
#: Spellings of logical cells.
TRUE, FALSE = ("TRUE", "T", "true", "True"), ("FALSE", "F", "false", "False")


def _kind(e: str, missing: str) -> str:
    words = ", ".join(f"'{w}'" for w in (*TRUE, *FALSE))
    return (
        f"case when {e} is null or {e} = '{missing}' or {e} rlike '^\\\\s*$' then 0 when {e} in ({words}) then {LOGICAL} "
        f"when {e} rlike '^\\\\s*[+-]?[0-9]+\\\\s*$' and try_cast({e} as bigint) is not null then {WHOLE} "
        f"when {e} rlike '{DECIMAL}' or lower({e}) rlike '^\\\\s*([+-]?(inf|infinity)|nan)\\\\s*$' then {REAL} else {TEXT} end"
    )


def narrowest(bits: int) -> str:
    """Spark's type for a set of kinds; a column without any value is logical, as it may become anything."""
    if bits in (0, LOGICAL):
        return "boolean"
    if bits == WHOLE:
        return "bigint"
    return "double" if not bits & ~(WHOLE | REAL) else "string"


def inferred_types(cells: DataFrame, missing: str = "NA") -> dict[str, str]:
    """Type of each text column."""
    row = cells.selectExpr(*[f"cast({_kind(f'`{c}`', missing)} as int) as k{i}" for i, c in enumerate(cells.columns)]).agg(
        *[F.bit_or(f"k{i}").alias(f"k{i}") for i in range(len(cells.columns))]).first()
    return {c: narrowest(row[i] or 0) for i, c in enumerate(cells.columns)}


def typed_cell(e: str, kind: str, missing: str = "NA") -> str:
    """A cell under the type of its column. Blank text stays an answer, elsewhere it is missing."""
    if kind == "boolean":
        return f"case when {e} in ({', '.join(repr(w) for w in TRUE)}) then true when {e} in ({', '.join(repr(w) for w in FALSE)}) then false end"
    if kind == "bigint":
        return f"try_cast({e} as bigint)"
    if kind == "double":
        return strict_number(e)
    return f"case when {e} = '{missing}' then null else coalesce({e}, '') end"


def typed(cells: DataFrame, kinds: Mapping[str, str], names: Sequence[str] | None = None) -> DataFrame:
    return cells.selectExpr(*[f"{typed_cell(f'`{c}`', kinds[c])} as `{n}`" for c, n in zip(cells.columns, names or cells.columns)])
