"""Joins against lookup maps, frequencies and the region dataset.

Spark chooses how to join: constants and stored maps are broadcast by their size
in bytes, derived tables are joined by sort-merge with adaptive skew handling.
No job runs while a plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on every column name the two sides share."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("the two sides share no column")
    return left.join(right, on=shared, how="left")


def lookup(
    fact: DataFrame, key: str, table: DataFrame, table_key: str, match_missing: bool = False
) -> DataFrame:
    """Left join on differently named keys; rows without a match stay with NULLs.

    ``match_missing`` lets a missing key find a missing key, for maps that hold
    one. The table's key column is dropped.
    """
    on = fact[key].eqNullSafe(table[table_key]) if match_missing else fact[key] == table[table_key]
    return fact.join(table, on, "left").drop(table[table_key])


def outer_merge(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Full outer join; the key keeps the left name and takes whichever side has it."""
    key = F.coalesce(left[left_key], right[right_key]).alias(left_key)
    rest = [left[c] for c in left.columns if c != left_key]
    rest += [right[c] for c in right.columns if c != right_key]
    return left.join(right, left[left_key] == right[right_key], "full").select(key, *rest)


def group_frequency(df: DataFrame, column: str, name: str = "freq") -> DataFrame:
    """Rows per value; a missing value is a group."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name))


def frequency_table(df: DataFrame, column: str, name: str = "freq") -> DataFrame:
    """Rows per value, missing values left out."""
    return group_frequency(df.where(F.col(column).isNotNull()), column, name)


def region_frequency(attributes: DataFrame, df: DataFrame, name: str, column: str) -> DataFrame:
    """Map dataset: region attributes with response counts and their square root.

    Regions without responses and counts without a region both stay.
    """
    merged = outer_merge(attributes, frequency_table(df, column), name, column)
    return merged.withColumn("sqrt_freq", F.sqrt("freq"))


def complete_cases(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with no missing value in the listed columns."""
    return df.na.drop(subset=list(columns))


def pairs(left: Sequence[str], right: Sequence[str]) -> list[tuple[str, str]]:
    """Every (left, right) pair, right varying fastest."""
    return [(a, b) for a in left for b in right]
