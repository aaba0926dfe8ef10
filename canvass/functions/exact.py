"""Sums of doubles that do not depend on how rows are dealt out or in which order they meet.

A cell is cut at fixed powers of two into whole numbers of 26 bits, and Spark
adds these up as longs, exactly, in any order and in any number of steps; a
group of 270,000 million rows does not overflow them. Only the total is rounded. Cells too
large for the highest limb, and what lies below the lowest one (far below
the rounding of any total near 1), are summed as doubles beside them, so that
nothing is lost outside the range either.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.functions.names import unused

WIDTH = 26
#: Lowest bit of each limb: cells below 2**63, and squares below 2**115.
UNITS = tuple(range(38, -119, -WIDTH))
SQUARE_UNITS = tuple(range(90, -119, -WIDTH))


def _power(e: int) -> str:
    return f"double('{2.0**e!r}')"


def is_inexact(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DoubleType, T.FloatType))


def _limbs(x: str, units: Sequence[int]) -> list[str]:
    """x rounded to multiples of each unit, less what the unit above already has: whole numbers of 26 bits."""
    rounded = [f"rint({x} * {_power(-e)}) * {_power(e)}" for e in units]
    parts = [rounded[0], *[f"({b} - {a})" for a, b in zip(rounded, rounded[1:])]]
    return [f"cast({p} * {_power(-e)} as bigint)" for p, e in zip(parts, units)]


def inside(x: str, units: Sequence[int] = UNITS) -> str:
    """The cell where limbs can hold it, 0 for a larger or undefined one. A column of its own, as limbs name it often."""
    return f"case when abs({x}) < {_power(units[0] + WIDTH - 1)} then {x} when {x} is not null then 0.0D end"


def sum_parts(x: str, held: str, units: Sequence[int] = UNITS) -> list[str]:
    """What to add up, by ``sum``, for the exact sum of a double column and the column of its ``inside``: limbs, and what they leave."""
    low = units[-1]
    return [*_limbs(held, units), f"{x} - rint({held} * {_power(-low)}) * {_power(low)}"]


def squares(x: str) -> tuple[str, str]:
    """The rounded square of a column, and its rounding error (0 where that is undefined)."""
    high = f"({x} * 134217729.0D - ({x} * 134217729.0D - {x}))"
    low = f"({x} - {high})"
    error = f"((({high} * {high} - {x} * {x}) + 2.0D * {high} * {low}) + {low} * {low})"
    return f"{x} * {x}", f"case when abs({x}) < {_power(57)} then {error} when {x} is not null then 0.0D end"


def square_parts(square: str, held: str, error: str) -> list[str]:
    """What to add up for the exact sum of squares, from columns made by ``squares`` and ``inside``."""
    *limbs, rest = sum_parts(square, held, SQUARE_UNITS)
    return [*[f"{a} + {b}" for a, b in zip(limbs, _limbs(error, SQUARE_UNITS))], rest]


def _components(sums: Sequence[Column], units: Sequence[int]) -> Column:
    """The total as an array of doubles of few bits each, lowest first, but for what the limbs left at its ends.

    Digits are balanced (from minus to plus half a limb), so the highest one that is not zero tells sign and size.
    """
    *limbs, rest = sums
    zero = F.lit(0).cast("long")
    digits = F.array(*[F.coalesce(c, zero) for c in reversed(limbs)], zero, zero)
    scales = F.array(*[F.lit(2.0**e) for e in [*reversed(units), units[0] + WIDTH, units[0] + 2 * WIDTH]])
    start = F.struct(zero.alias("carried"), F.array().cast("array<double>").alias("out"))

    def carry(acc: Column, digit: Column) -> Column:
        whole = digit["digits"] + acc["carried"]
        carried = F.shiftright(whole + (1 << (WIDTH - 1)), WIDTH)
        own = (whole - F.shiftleft(carried, WIDTH)).cast("double") * digit["scales"]
        return F.struct(carried.alias("carried"), F.array_append(acc["out"], own).alias("out"))

    out = F.aggregate(F.arrays_zip(digits.alias("digits"), scales.alias("scales")), start, carry, lambda acc: acc["out"])
    # what was left is either far below the lowest digit or far above the highest one
    rest = F.coalesce(rest, F.lit(0.0))
    small = F.abs(rest) < 2.0 ** units[0]
    return F.array_append(F.array_prepend(out, F.when(small, rest).otherwise(0.0)), F.when(small, 0.0).otherwise(rest))


def total(sums: Sequence[Column], units: Sequence[int] = UNITS) -> Column:
    """The rounded total of summed parts; NULL where no cell was added."""
    value = F.aggregate(_components(sums, units), F.lit(0.0), lambda acc, v: acc + v)
    return F.when(sums[0].isNotNull(), value)


def pair(sums: Sequence[Column], units: Sequence[int] = UNITS) -> Column:
    """The total as a struct of two doubles, ``hi`` and what ``hi`` lacks, ``lo``."""
    def added(acc: Column, v: Column) -> Column:
        s = acc["hi"] + v
        back = s - acc["hi"]
        return F.struct(s.alias("hi"), (acc["lo"] + (acc["hi"] - (s - back)) + (v - back)).alias("lo"))

    zero = F.struct(F.lit(0.0).alias("hi"), F.lit(0.0).alias("lo"))
    return F.aggregate(_components(sums, units), zero, added)


def held_name(columns: Sequence[str], column: str) -> str:
    return unused(columns, f"held__{column}")


def with_held(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, list[str]]]:
    """The table with the columns that limbs are cut from, and what to sum for each of ``columns``."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    inexact = {c: held_name(df.columns, c) for c in columns if is_inexact(kinds[c])}
    wide = df.withColumns({h: F.expr(inside(f"cast(`{c}` as double)")) for c, h in inexact.items()}) if inexact else df
    return wide, {c: sum_parts(f"cast(`{c}` as double)", f"`{inexact[c]}`") if c in inexact else [f"`{c}`"] for c in columns}


def exact_sums(df: DataFrame, keys: Sequence[str | Column], columns: Sequence[str]) -> DataFrame:
    """``sum__c`` and ``cnt__c`` for each column by the keys, doubles reproducibly; whole numbers are exact anyway."""
    df, parts_of = with_held(df, columns)
    aggregates, shown = [], []
    for k, c in enumerate(columns):
        parts = parts_of[c]
        names = [f"part{k}_{i}" for i in range(len(parts))]
        aggregates += [F.expr(f"sum({p}) as {n}") for p, n in zip(parts, names)]
        aggregates.append(F.expr(f"count(`{c}`) as cnt{k}"))
        value = total([F.col(n) for n in names]) if len(parts) > 1 else F.col(names[0])
        shown += [value.alias(f"sum__{c}"), F.col(f"cnt{k}").alias(f"cnt__{c}")]
    grouped = df.groupBy(*keys).agg(F.expr("count(1) as rows"), *aggregates)
    own = grouped.columns[: len(grouped.columns) - 1 - len(aggregates)]
    return grouped.select(*[F.col(f"`{c}`") for c in own], "rows", *shown)


def variance(n: Column, s: Column, q: Column) -> Column:
    """Sample variance from the count and the pairs of the sum and the sum of squares."""
    # (q - s*s/n) / (n-1), s*s/n with its rounding errors: products by Veltkamp's halves
    def halves(v: Column) -> tuple[Column, Column]:
        high = v * 134217729.0 - (v * 134217729.0 - v)
        return high, v - high

    (sh, sl), mean = halves(s["hi"]), s["hi"] / n
    mh, ml = halves(mean)
    product = s["hi"] * mean
    error = ((sh * mh - product) + sh * ml + sl * mh) + sl * ml
    # the quotient's own rounding: what mean * n lacks of s
    nh, nl = halves(n.cast("double"))
    back = mean * n
    lacking = (s["hi"] - back) - (((mh * nh - back) + mh * nl + ml * nh) + ml * nl)
    cross = s["hi"] * (lacking + 2.0 * s["lo"]) / n
    spread = (q["hi"] - product) + (q["lo"] - error - cross)
    return F.when(n > 1, F.greatest(spread, F.lit(0.0)) / (n - 1))
