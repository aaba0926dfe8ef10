"""Multi-cut profiles: the same measures overall and by each of several category columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.domain import Domain
from canvass.functions import exact
from canvass.functions.names import unused

# Grouping first by all cuts together reads every row once and leaves at most
# this many groups per task; above it the rows are expanded per cut instead.
JOINT_GROUP_LIMIT = 10_000


@dataclass(frozen=True)
class Cut:
    """A category column, the name it carries in the output, and its domain if known."""

    column: str
    label: str
    domain: Domain | None = None


@dataclass(frozen=True)
class Measure:
    """One output column: ``mean`` or ``sum`` of a column, NULLs skipped.

    A sum over nothing is 0, a mean over nothing is NULL.
    """

    name: str
    column: str
    kind: str = "mean"

    def __post_init__(self) -> None:
        if self.kind not in ("mean", "sum"):
            raise ValueError(f"unknown measure kind {self.kind!r}")


def means(*columns: str) -> list[Measure]:
    return [Measure(c, c) for c in columns]


def sums(*columns: str) -> list[Measure]:
    return [Measure(c, c, "sum") for c in columns]


def joint_groups_bounded(cuts: Sequence[Cut]) -> bool:
    """Whether the domains, once ``enforced``, bound the joint grouping (one more group each for NULL and ``other``)."""
    if any(c.domain is None for c in cuts):
        return False
    return reduce(mul, [len(c.domain.levels) + 2 for c in cuts], 1) <= JOINT_GROUP_LIMIT


def outside(domain: Domain) -> str:
    """The level that counts the values outside a domain."""
    return unused(domain.levels, "other")


def enforced(df: DataFrame, cuts: Sequence[Cut]) -> DataFrame:
    """Values outside a cut's domain become one level, which makes the domain's bound on groups a fact.

    Nothing is left out: that level counts them all. Missing values stay missing.
    """
    def folded(c: Cut) -> Column:
        value = F.col(f"`{c.column}`").cast("string")
        return F.when(value.isNull() | value.isin(*c.domain.levels), value).otherwise(outside(c.domain))

    return df.withColumns({c.column: folded(c) for c in cuts if c.domain is not None})


def partials(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Row count plus, per column, the sums of its parts and the count of non-missing values.

    These add up, so any coarser grouping can be built from the result
    without going back to the rows.
    """
    wide, parts = exact.with_held(df, columns)
    return wide.groupBy(*keys).agg(
        F.expr("count(1) as rows"),
        *[F.expr(f"sum({p}) as `sum__{c}__{i}`") for c, own in parts.items() for i, p in enumerate(own)],
        *[F.expr(f"count(`{c}`) as `cnt__{c}`") for c in columns],
    )


def roll_up(
    df: DataFrame, sets: Sequence[Sequence[str]], keys: Sequence[str],
    columns: Sequence[str], pre_aggregate: bool,
) -> DataFrame:
    """One aggregate per grouping set; ``gid`` tells the sets apart.

    With ``pre_aggregate`` the raw rows meet a single hash aggregation on all
    keys and only its few groups are expanded per set. Without it the rows are
    expanded per set before partial aggregation, which is right when the joint
    grouping has no useful bound. Sums of doubles come out the same however the
    rows are dealt out.
    """
    if pre_aggregate:
        return roll_up_partials(partials(df, keys, columns), sets, keys, columns)
    wide, parts = exact.with_held(df.select(*dict.fromkeys([*keys, *columns])), columns)
    return _expanded(wide, sets, keys, parts, "count(1)", "count(`{0}`)")


def roll_up_partials(source: DataFrame, sets: Sequence[Sequence[str]], keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The same from ``partials``, of one table or of several put together."""
    parts = {c: [f"`{n}`" for n in source.columns if n.startswith(f"sum__{c}__") and n[len(f"sum__{c}__"):].isdigit()] for c in columns}
    return _expanded(source, sets, keys, parts, "sum(rows)", "sum(`cnt__{0}`)")


def _expanded(source: DataFrame, sets: Sequence[Sequence[str]], keys: Sequence[str], parts: Mapping[str, Sequence[str]], rows: str, count: str) -> DataFrame:
    rolled = source.groupingSets([list(s) for s in sets], *keys).agg(
        F.grouping_id().alias("gid"),
        F.expr(f"coalesce({rows}, 0) as rows"),
        *[F.expr(f"sum({p}) as `sum__{c}__{i}`") for c, own in parts.items() for i, p in enumerate(own)],
        *[F.expr(f"coalesce({count.format(c)}, 0) as `cnt__{c}`") for c in parts],
    )
    totals = {c: [F.col(f"`sum__{c}__{i}`") for i in range(len(own))] for c, own in parts.items()}
    return rolled.select(
        *keys, "gid", "rows",
        *[(exact.total(own) if len(own) > 1 else own[0]).alias(f"sum__{c}") for c, own in totals.items()],
        *[f"`cnt__{c}`" for c in parts])


def set_id(keys: Sequence[str], used: Sequence[str]) -> int:
    """The grouping id of a set: one bit per key, high bit first, set when the key is *not* used."""
    return sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in used)


def tagged(gid: Column, tags: dict[int, Column | str]) -> Column:
    """Choose a column (or text) by grouping id."""
    out = None
    for key, value in tags.items():
        value = F.lit(value) if isinstance(value, str) else value
        out = F.when(gid == key, value) if out is None else out.when(gid == key, value)
    return out


def profile(
    df: DataFrame,
    cuts: Sequence[Cut],
    measures: Sequence[Measure],
    *,
    overall: str = "All Farms",
    count_as: str | None = "N",
    with_order: bool = False,
) -> DataFrame:
    """Rows ``(type, level, N, measures...)``: one overall, then one per level of each cut.

    A missing level is a group of its own; a table without rows gives no rows. Where the cuts' domains are to bound the
    groups, values outside a domain share the level ``other``, after the others. ``with_order`` adds ``block_ord`` and
    ``level_ord`` so that a sink can write blocks in order and levels in domain
    order with the missing level last.
    """
    keys = [c.column for c in cuts]
    columns = list(dict.fromkeys(m.column for m in measures))
    bounded = joint_groups_bounded(cuts)
    rolled = roll_up(enforced(df, cuts) if bounded else df, [[], *[[k] for k in keys]], keys, columns, bounded)
    return shown(rolled, cuts, measures, overall=overall, count_as=count_as, with_order=with_order)


def shown(
    rolled: DataFrame, cuts: Sequence[Cut], measures: Sequence[Measure], *,
    overall: str = "All Farms", count_as: str | None = "N", with_order: bool = False,
) -> DataFrame:
    """The rows of a profile from its grouping sets: none, then one per cut."""
    keys = [c.column for c in cuts]
    gid = F.col("gid")
    ids = [set_id(keys, [])] + [set_id(keys, [k]) for k in keys]
    block = dict(zip(ids, [overall, *[c.label for c in cuts]]))
    level = {ids[0]: "All"} | {i: F.col(c.column) for i, c in zip(ids[1:], cuts)}

    def value(m: Measure) -> Column:
        if m.kind == "sum":
            return F.expr(f"coalesce(`sum__{m.column}`, 0) as `{m.name}`")
        return F.expr(f"try_divide(cast(`sum__{m.column}` as double), `cnt__{m.column}`) as `{m.name}`")

    out = [tagged(gid, block).alias("type"), tagged(gid, level).alias("level")]
    if count_as:
        out.append(F.col("rows").alias(count_as))
    out += [value(m) for m in measures]
    if with_order:
        order = {i: F.lit(n) for n, i in enumerate(ids)}
        place = {ids[0]: F.lit(1)} | {
            i: Domain((*c.domain.levels, outside(c.domain))).ordinal(F.col(c.column)) if c.domain else F.lit(None).cast("int")
            for i, c in zip(ids[1:], cuts)
        }
        out += [tagged(gid, order).alias("block_ord"), tagged(gid, place).alias("level_ord")]
    return rolled.select(*out)


def in_order(df: DataFrame) -> DataFrame:
    """Sort a profile made ``with_order`` and drop the ordering columns."""
    return df.orderBy(
        "block_ord", F.col("level_ord").asc_nulls_last(), F.col("level").asc_nulls_last()
    ).drop("block_ord", "level_ord")


def global_summary(df: DataFrame, measures: Sequence[Measure], count_as: str = "N") -> DataFrame:
    """The overall row alone."""
    sums = exact.exact_sums(df, [], list(dict.fromkeys(m.column for m in measures)))

    def value(m: Measure) -> Column:
        whole = F.col(f"`sum__{m.column}`")
        return F.try_divide(whole.cast("double"), F.col(f"`cnt__{m.column}`")) if m.kind == "mean" else F.coalesce(whole, F.lit(0))

    return sums.select(F.col("rows").alias(count_as), *[value(m).alias(m.name) for m in measures])


def conditional_count(df: DataFrame, column: str, value: str, name: str = "n") -> DataFrame:
    """How many rows hold ``value``."""
    return df.agg(F.count_if(F.col(column) == value).alias(name))
