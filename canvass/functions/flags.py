"""Row-level derivations: three-valued flags, answered flags, shares, indices, row extremes.

Inputs are SQL expressions, mostly plain column names, so that a hundred flags
cost a hundred short texts to parse rather than thousands of calls into the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.functions.numbers import strict_number


def quoted(value: str) -> str:
    """A SQL text literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def zero_to_null(e: str) -> Column:
    """A zero that stands for "not reported"."""
    return F.expr(f"nullif({e}, 0)")


def equals(e: str, value: str) -> Column:
    """True / false / NULL; a blank cell is false, a missing cell is NULL."""
    return F.expr(f"{e} = {quoted(value)}")


def _answered(e: str) -> str:
    return f"coalesce({e}, '') <> ''"


def answered(e: str) -> Column:
    """Neither missing nor blank. Never NULL."""
    return F.expr(_answered(e))


def any_answered(*es: str) -> Column:
    return F.expr(" or ".join(map(_answered, es)))


def any_positive(*es: str) -> Column:
    """Some amount above zero. Never NULL."""
    return F.expr(" or ".join(f"coalesce(({e}) > 0, false)" for e in es))


def text_positive(e: str) -> Column:
    """Amount kept as text: not a number counts as no amount. Never NULL."""
    return any_positive(strict_number(e))


def share(part: str, total: str) -> Column:
    """Part of a total; NULL when the total is zero."""
    return F.expr(f"try_divide({part}, {total})")


def concentration(*percents: str) -> Column:
    """Sum of squared percentages; NULL when any is missing."""
    return F.expr(" + ".join(f"({e}) * ({e})" for e in percents))


def row_sum(*es: str) -> Column:
    """Sum across columns; NULL when any is missing."""
    return F.expr(" + ".join(es))


def _complete(es: tuple[str, ...], value: str) -> Column:
    known = " and ".join(f"({e}) is not null" for e in es)
    return F.expr(f"case when {known} then {value} end")


def row_max(*es: str) -> Column:
    """Largest of the columns; NULL when any is missing (``greatest`` alone would skip NULLs)."""
    return _complete(es, f"greatest({', '.join(es)})")


def row_min(*es: str) -> Column:
    """Smallest of the columns; NULL when any is missing."""
    return _complete(es, f"least({', '.join(es)})")


def booleans_to_int(df: DataFrame) -> DataFrame:
    """Turn every boolean column, found by type, into 0/1 with NULL kept."""
    return df.selectExpr(*[
        f"cast(`{f.name}` as int) as `{f.name}`" if isinstance(f.dataType, T.BooleanType) else f"`{f.name}`"
        for f in df.schema.fields])


def significance_mark(p: Column, level: float = 0.05) -> Column:
    """``*`` at or below the level, else blank; NULL p stays NULL."""
    return F.when(p.isNull(), F.lit(None)).when(p <= level, "*").otherwise("")


def sign_mark(estimate: Column, p: Column, level: float = 0.05) -> Column:
    """``(+)`` or ``(-)`` when significant, else one space; NULL p stays NULL."""
    return (
        F.when(p.isNull(), F.lit(None))
        .when(p <= level, F.when(estimate > 0, "(+)").otherwise("(-)"))
        .otherwise(" ")
    )


def stars(p: Column) -> Column:
    """Strictly below 1%, 5%, 10%."""
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.1, "*").otherwise("")
