"""Chi-squared independence tests and mean intervals."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canvass.functions import exact
from canvass.functions.flags import significance_mark
from canvass.functions.special import chi2_log_upper_tail, chi2_upper_tail, t_quantile
from canvass.operators.profile import Cut, enforced, joint_groups_bounded, roll_up, set_id, tagged


def chi2_from_counts(counts: DataFrame, tests: Sequence[str], many_cells: bool = False, with_log: bool = False) -> DataFrame:
    """Pearson tests from long counts ``(tests..., row, col, o)``, one row per table cell.

    Cells nobody falls into may be absent. Levels without observations do not
    count. Two-by-two tables take the Yates correction. Fewer than two levels on
    a side give NULLs.

    Tables of survey categories are small whatever the number of rows behind
    them: a test's cells then share a partition and one shuffle serves all
    margins. With ``many_cells`` a table of any size is spread over partitions:
    its margins are grouped, combined inside the tasks, and joined back, so no
    task holds a level or a test. ``with_log`` adds ``log_p``, the decimal
    logarithm of the p-value, which still ranks tests whose p-value is 0 as a double.
    """
    found = counts.where(F.col("o") > 0)
    margins = {"total": [], "r": ["row"], "c": ["col"]}
    if many_cells:
        for name, own in margins.items():
            sums = found.groupBy(*tests, *own).agg(F.sum("o").cast("double").alias(name), F.count("o").alias(f"in_{name}"))
            margins[name] = [*tests, *own], sums
        for on, sums in margins.values():
            found = found.join(sums, on)
    else:
        for name, own in margins.items():
            over = Window.partitionBy(*tests, *own)
            found = found.withColumns({name: F.sum("o").over(over).cast("double"), f"in_{name}": F.count("o").over(over)})
    cells = found.withColumn("e", F.col("r") * F.col("c") / F.col("total")).withColumn("dev", F.abs(F.col("o") - F.col("e")))
    tables = cells.groupBy(*tests).agg(
        F.round(F.sum(1.0 / F.col("in_r"))).cast("long").alias("nr"),
        F.round(F.sum(1.0 / F.col("in_c"))).cast("long").alias("nc"),
        F.first("total").alias("total"),
        F.sum(F.col("dev") * F.col("dev") / F.col("e")).alias("seen"),
        # An absent cell has o = 0 and adds its whole expectation.
        (F.first("total") - F.sum("e")).alias("unseen"),
        F.count(F.lit(1)).alias("cells"),
        F.min("dev").alias("dev"),
        (F.min("r") * F.max("r") * F.min("c") * F.max("c")).alias("margins"),
    )
    nr, nc, total = F.col("nr"), F.col("nc"), F.col("total")
    usable = (nr >= 2) & (nc >= 2)
    # All four deviations of a two-by-two table are equal, and the sum of 1/e is total^3 / margins.
    corrected = F.col("dev") - F.least(F.lit(0.5), F.col("dev"))
    yates = corrected * corrected * total * total * total / F.col("margins")
    plain = F.col("seen") + F.when(F.col("cells") < nr * nc, F.col("unseen")).otherwise(0.0)
    out = tables.select(
        *tests,
        F.when(usable, F.when((nr == 2) & (nc == 2), yates).otherwise(plain)).alias("stat"),
        F.when(usable, ((nr - 1) * (nc - 1)).cast("int")).alias("df"),
    ).withColumn("pval", chi2_upper_tail(F.col("stat"), F.col("df")))
    if with_log:
        out = out.withColumn("log_p", chi2_log_upper_tail(F.col("stat"), F.col("df")) / math.log(10.0))
    return out.withColumn("sig", significance_mark(F.col("pval")))


def flag_counts(df: DataFrame, cuts: Sequence[Cut], responses: Sequence[str]) -> DataFrame:
    """Long counts of every 0/1 response by every cut, from one pass over the rows.

    Rows missing the cut or the response do not count. Values outside a domain that bounds the tables are one level.
    """
    keys = [c.column for c in cuts]
    bounded = joint_groups_bounded(cuts)
    rolled = roll_up(enforced(df, cuts) if bounded else df, [[k] for k in keys], keys, list(responses), bounded)
    ids = {set_id(keys, [k]): k for k in keys}
    cut = tagged(F.col("gid"), ids).alias("cut")
    row = tagged(F.col("gid"), {i: F.col(k).cast("string") for i, k in ids.items()}).alias("row")
    ones = {r: f"coalesce(`sum__{r}`, 0)" for r in responses}
    cells = ", ".join(
        f"struct('{r}' as resp, '0' as col, cast(`cnt__{r}` - {n} as bigint) as o), "
        f"struct('{r}' as resp, '1' as col, cast({n} as bigint) as o)" for r, n in ones.items())
    return (
        rolled.select(cut, row, F.expr(f"inline(array({cells}))"))
        .where("row is not null")
        .select("cut", "row", "resp", "col", "o")
    )


def chi2_flags(df: DataFrame, cuts: Sequence[Cut], responses: Sequence[str], with_log: bool = False) -> DataFrame:
    """``(cut, resp, stat, df, pval, sig)`` for every cut against every 0/1 response.

    Cuts without a known domain may have any number of levels, and their tables are spread.
    """
    return chi2_from_counts(flag_counts(df, cuts, responses), ["cut", "resp"], not joint_groups_bounded(cuts), with_log)


def chi2_test(df: DataFrame, x: str, y: str, with_log: bool = False) -> DataFrame:
    """One test between two category columns of any size."""
    counts = (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(F.col(x).cast("string").alias("row"), F.col(y).cast("string").alias("col"))
        .agg(F.count(F.lit(1)).alias("o"))
        .withColumns({"cut": F.lit(x), "resp": F.lit(y)})
    )
    return chi2_from_counts(counts, ["cut", "resp"], True, with_log)


def mean_interval(df: DataFrame, column: str, by: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """``n, mu, sigma, se, ciMult, ci, upper, lower`` of the non-missing values.

    Sums and sums of squares are exact before their last rounding, so neither the dealing out of rows nor values far
    from zero show in the deviation.
    """
    keys = [f"by{k}" for k in range(len(by))]
    rows = df.where(F.col(column).isNotNull()).select(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.col(column).cast("double").alias("x"))
    square, error = exact.squares("x")
    rows = rows.select(*keys, "x", F.expr(f"{square} as xx"), F.expr(f"{error} as error"))
    rows = rows.select(*keys, "x", "xx", "error", F.expr(f"{exact.inside('x')} as held"), F.expr(f"{exact.inside('xx', exact.SQUARE_UNITS)} as held2"))
    parts = {"s": exact.sum_parts("x", "held"), "q": exact.square_parts("xx", "held2", "error")}
    sums = rows.groupBy(*keys).agg(F.expr("count(1) as n"), *[F.expr(f"sum({p}) as {k}_{i}") for k, own in parts.items() for i, p in enumerate(own)])
    of = lambda k: [F.col(f"{k}_{i}") for i in range(len(parts[k]))]
    n = F.col("n")
    stats = sums.select(*keys, "n", exact.total(of("s")).alias("s"), exact.pair(of("s")).alias("s2"), exact.pair(of("q"), exact.SQUARE_UNITS).alias("q2"))
    stats = stats.select(
        *[F.col(k).alias(b) for b, k in zip(by, keys)], "n",
        F.try_divide(F.col("s"), n).alias("mu"), F.sqrt(exact.variance(n, F.col("s2"), F.col("q2"))).alias("sigma"))
    stats = stats.withColumns(
        {
            "se": F.try_divide(F.col("sigma"), F.sqrt("n")),
            "ciMult": t_quantile(level / 2 + 0.5, F.col("n") - 1),
        }
    ).withColumn("ci", F.col("se") * F.col("ciMult"))
    return stats.withColumns({"upper": F.col("mu") + F.col("ci"), "lower": F.col("mu") - F.col("ci")})
