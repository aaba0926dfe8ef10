"""Wide and long forms, unions by name, crosstabs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.functions.flags import row_sum
from canvass.functions.names import unused

MISSING = "NA"
OTHER = "other"


def stack_by_name(*frames: DataFrame | None) -> DataFrame:
    """Union all by column name; absent columns become NULL, an absent frame is skipped."""
    present = [f for f in frames if f is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), present)


def select_first(df: DataFrame, *first: str) -> DataFrame:
    """Named columns first, then the rest in their old order."""
    return df.select(*first, *[c for c in df.columns if c not in first])


def only(value: Column) -> Column:
    """The value of a cell that has one row; a second row, a missing value included, is an error."""
    twice = F.raise_error(F.lit("several rows fall into one cell; say how to merge them"))
    return F.when(F.count(F.lit(1)) > 1, twice.cast("void")).otherwise(F.first(value))


def spread(
    df: DataFrame, ids: Sequence[str], key: str, values: Sequence[str],
    value: str, fill: Column | None = None, merge: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One column per listed key; a missing key goes to the column ``NA`` if that is listed.

    A key that is not listed, a text spelled like a column that stands for
    something else included, is an error when the query runs: leaving it out would lose rows.
    So are two rows of the same cell, unless ``merge`` (an aggregate such as ``F.sum`` or ``F.max``) makes one of them.
    ``fill`` replaces combinations that have no row. NaN marks a row whose value
    is undefined (a mean over nothing) and is kept apart from those.
    """
    unlisted = F.raise_error(F.concat(F.lit(f"{key} has a value without a column: "), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("NULL"))))
    slots = slot_of(F.col(f"`{key}`"), values, unlisted.cast("int"))
    slot, cell = unused(df.columns, "slot"), unused(df.columns, "cell")
    cells = df.withColumn(slot, slots).groupBy(*ids, slot).agg((merge or only)(F.col(f"`{value}`")).alias(cell))
    wide = cells.groupBy(*ids).pivot(slot, list(range(len(values)))).agg(F.first(cell))
    # by position: an id may be called like a pivoted column
    wide = wide.toDF(*[f"i{k}" for k in range(len(ids))], *[f"v{k}" for k in range(len(values))])
    out = [F.col(f"v{k}") if fill is None else F.coalesce(F.col(f"v{k}"), fill) for k in range(len(values))]
    return wide.select(*[F.col(f"i{k}").alias(i) for k, i in enumerate(ids)], *[c.alias(v) for c, v in zip(out, values)])


def slot_of(key: Column, values: Sequence[str], unlisted: Column) -> Column:
    """Position of a key's column; NULL belongs to ``NA``, which no text can reach."""
    missing = F.lit(list(values).index(MISSING)) if MISSING in values else unlisted
    out = F.when(key.isNull(), missing)
    for i, v in enumerate(values):
        if v != MISSING:
            out = out.when(key == v, F.lit(i))
    return out.otherwise(unlisted)


def gather(df: DataFrame, ids: Sequence[str], values: Sequence[str],
           key: str = "var", value: str = "value") -> DataFrame:
    """One row per listed column; missing values stay as rows."""
    return df.unpivot(list(ids), list(values), key, value)


def spread_pairs(
    df: DataFrame, ids: Sequence[str], pair: tuple[str, str], names: Sequence[str], value: str,
    merge: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One column per listed ``first_second`` name made from two key columns; an unlisted pair is an error.

    A missing key is spelled ``NA``; a text spelled so would share its column, and is an error too.
    """
    taken = F.raise_error(F.lit(f"a key is spelled {MISSING}, like a missing one"))
    parts = [F.when(F.col(c) == MISSING, taken.cast("string")).otherwise(F.coalesce(F.col(c), F.lit(MISSING))) for c in pair]
    return spread(df.withColumn("pair", F.concat_ws("_", *parts)), ids, "pair", names, value, merge=merge)


def transpose(df: DataFrame, measures: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Profile rows become columns ``type_level``, measures become rows ``var``."""
    long = gather(df.select("type", "level", *measures), ["type", "level"], measures)
    return spread_pairs(long, ["var"], ("type", "level"), names, "value")


def with_row_total(df: DataFrame, columns: Sequence[str], name: str = "all") -> DataFrame:
    return df.withColumn(name, row_sum(*[f"`{c}`" for c in columns]))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str], label: str) -> DataFrame:
    """Counts by two categories: ``(type, level, one column per value, NA, other, all)``.

    ``NA`` counts missing values, ``other`` all that are not listed, so ``all`` is the number of rows.
    """
    wide_names = _with_rest(values)
    slots = slot_of(F.col(column), wide_names[:-1], F.lit(len(values) + 1))
    counts = df.groupBy(F.col(row).alias("level"), slots.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    wide = counts.groupBy("level").pivot("slot", list(range(len(wide_names)))).agg(F.first("n"))
    filled = [F.coalesce(F.col(f"`{i}`"), F.lit(0).cast("long")).alias(v) for i, v in enumerate(wide_names)]
    return with_row_total(wide.select(F.lit(label).alias("type"), "level", *filled), wide_names)


def _with_rest(values: Sequence[str]) -> list[str]:
    if {MISSING, OTHER, "all"} & set(values):
        raise ValueError(f"{MISSING}, {OTHER} and all name columns of their own")
    return [*values, MISSING, OTHER]


def crosstab_means(
    df: DataFrame, row: str, column: str, values: Sequence[str], measure: str, label: str
) -> DataFrame:
    """Means by two categories: NaN where rows exist but none has a value, 0 where no row exists."""
    wide_names = _with_rest(values)
    slots = slot_of(F.col(column), wide_names[:-1], F.lit(len(values) + 1))
    cells = df.groupBy(F.col(row).alias("level"), slots.alias("slot")).agg(
        F.coalesce(F.avg(measure), F.lit(float("nan"))).alias("m"))
    wide = cells.groupBy("level").pivot("slot", list(range(len(wide_names)))).agg(F.first("m"))
    filled = [F.coalesce(F.col(f"`{i}`"), F.lit(0.0)).alias(v) for i, v in enumerate(wide_names)]
    return wide.select(F.lit(label).alias("type"), "level", *filled)
