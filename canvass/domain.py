"""Category domains: an ordered list of levels, which Spark strings do not carry themselves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.functions.flags import quoted


@dataclass(frozen=True)
class Domain:
    """Ordered levels; ``ref`` is the level regression dummies are measured against."""

    levels: tuple[str, ...]
    ref: str | None = None

    def restrict(self, c: Column) -> Column:
        """Values outside the levels become NULL."""
        return F.when(c.isin(*self.levels), c)

    def ordinal(self, c: Column) -> Column:
        """Position of the level from 1; NULL outside the domain."""
        position = F.when(c == self.levels[0], F.lit(1))
        for i, level in enumerate(self.levels[1:], start=2):
            position = position.when(c == level, F.lit(i))
        return position

    def relevel(self, ref: str) -> "Domain":
        if ref not in self.levels:
            raise ValueError(f"{ref!r} is not one of {self.levels}")
        return replace(self, levels=(ref, *[v for v in self.levels if v != ref]), ref=ref)

    def dummies(self, name: str) -> dict[str, str]:
        """A 0/1 expression per level other than the reference (the first level if none is set).

        A value outside the levels is missing, not the reference.
        """
        ref = self.ref or self.levels[0]
        listed = ", ".join(quoted(v) for v in self.levels)
        return {v: f"case when {name} in ({listed}) then cast({name} = {quoted(v)} as double) end" for v in self.levels if v != ref}


def bin_by(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Left-closed bins: below the first edge takes the first label; NULL stays NULL."""
    if len(labels) != len(edges) + 1:
        raise ValueError("one more label than edges is needed")
    out = F.when(c.isNull(), F.lit(None))
    for edge, label in zip(edges, labels):
        out = out.when(c < edge, label)
    return out.otherwise(labels[-1])


def recode(c: Column, mapping: Mapping[str, str]) -> Column:
    """Map values to labels, several values may share one; anything else becomes NULL."""
    out = None
    for label in dict.fromkeys(mapping.values()):
        hit = c.isin(*[v for v, target in mapping.items() if target == label])
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def pick(levels: Sequence[str], positions: Mapping[int, str]) -> dict[str, str]:
    """Mapping for ``recode`` from positions (from 1) in a sorted level list."""
    return {levels[i - 1]: label for i, label in positions.items() if i <= len(levels)}


def sorted_levels(df: DataFrame, first: Mapping[str, int], collation: str | None = None) -> dict[str, list[str]]:
    """Per column, its first distinct values in sorted order, as many as asked for.

    The order is that of code points, or of one of Spark's collations (``UNICODE``,
    ``de``, ...), with code points between texts that a collation calls equal.
    Picking by position never needs more than the largest position, so each pass
    takes the least value above the one before, of all columns at once: one
    aggregate a level, of which each task hands on a row. Store ``df`` first where computing it is dear.
    """
    found: dict[str, list[str]] = {c: [] for c in first}
    todo = [c for c, n in first.items() if n > 0]
    while todo:
        row = df.agg(*[_least_above(F.col(f"`{c}`").cast("string"), found[c][-1:], collation).alias(f"v{i}") for i, c in enumerate(todo)]).first()
        for c, v in zip(todo, row):
            found[c] += [] if v is None else [v if collation is None else v["own"]]
        todo = [c for c, v in zip(todo, row) if v is not None and len(found[c]) < first[c]]
    return found


def _least_above(c: Column, last: Sequence[str], collation: str | None) -> Column:
    if collation is None:
        return F.min(F.when(c > last[0], c) if last else c)
    rank = F.collate(c, collation)
    value = F.struct(rank.alias("rank"), c.alias("own"))
    above = c.isNotNull()
    if last:
        before = F.collate(F.lit(last[0]), collation)
        above = (rank > before) | ((rank == before) & (c > last[0]))
    return F.min(F.when(above, value))


def sorted_position(df: DataFrame, column: str, positions: Mapping[int, str], collation: str | None = None) -> dict[str, str]:
    """``pick`` on the levels found in the data."""
    return pick(sorted_levels(df, {column: max(positions)}, collation)[column], positions)
