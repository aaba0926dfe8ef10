"""A survey-shaped table made from the order tables: one respondent per customer.

Each order line is read as one small answer. Its discount and tax say which
question it answers, its return flag how; its quantity says which box of a
check-all question it ticks, its tax which land use and its ship day which sales
channel its amount belongs to. A customer's answers are kept as bit sets
(``bit_or``) and exact integer sums, so the line table is reduced by order and
then by customer with map-side partial aggregation: a customer or order holding
a large part of all lines only costs its own tasks a few more additions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.domain import Domain
from canvass.operators.relate import lookup
from canvass.plans.survey import Dictionary, attach_region, derive
from canvass.sources import schema
from canvass.sources.conform import conform
from canvass.sources.tables import table

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
STATUSES = ("F", "O", "P")
YEARS = ("1995", "1996", "1997", "1998", "1999", "2000", "2001")

DICTIONARY = Dictionary.from_levels(
    {
        "org_v_conv": ("", *SEGMENTS),
        "border_noncrop": ("", *PRIORITIES),
        "border_livestock": ("", *PRIORITIES),
        "water_freq_test": ("", *YEARS),
        "water_treat": ("", *[a + b for a in STATUSES for b in STATUSES]),
    },
    regions=Domain(("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")),
)

LAND_USES = (
    "acre_infield_veg_herb", "acre_infield_fruit", "acre_infield_cerealbeans", "acre_gh",
    "acre_pasture", "acre_grass", "acre_wild", "acre_fallow", "acre_other",
)
LAND_USE_BY_DISCOUNT = (0, 0, 0, 1, 1, 2, 3, 4, 5, 6, 7)  # discount in percent -> land use
CHANNELS = (
    "sale_directcons", "sale_wholesale", "sale_grocery", "sale_massmerch",
    "sale_process", "sale_other", "sale_foodserv",
)
CHANNEL_FROM_DAY = (1, 13, 17, 20, 23, 26, 29)  # first ship day of month of each channel


def _bits(position: Column, when: Column | None = None) -> Column:
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), position)
    return F.bit_or(bit if when is None else F.when(when, bit).otherwise(F.lit(0).cast("long")))


def _sum_if(when: Column, value: Column) -> Column:
    return F.sum(F.when(when, value).otherwise(F.lit(0).cast("long")))


# Revenue is spending weighted by the squared share of the account balance, nothing when in debt.
_HELD = "(greatest(c_acctbal, 0.0D) / 10000.0D)"
_WEIGHT = f"({_HELD} * {_HELD})"


def _unless_owing(text: str) -> str:
    """Customers in debt leave the cell blank."""
    return f"case when c_acctbal < 0 then '' else coalesce({text}, 'NA') end"


def _bit(mask: str, position: int) -> str:
    return f"coalesce(getbit({mask}, {position}), 0) = 1"


def _answer(slot: int, yes: str, no: str) -> str:
    """Never asked is missing; a return says yes, none says no, anything else leaves a blank."""
    return (f"case when not ({_bit('asked', slot)}) then 'NA' when {_bit('yes', slot)} then '{yes}' "
            f"when {_bit('no', slot)} then '{no}' else '' end")


def _box(position: int) -> str:
    return f"case when {_bit('ticked', position)} then 'Used' when {_bit('seen', position)} then '' else 'NA' end"


def order_answers(lineitem: DataFrame) -> DataFrame:
    """Lines reduced to one row per order."""
    percent = F.rint(F.col("l_discount") * 100).cast("int")
    tax = F.rint(F.col("l_tax") * 100).cast("int")
    lines = lineitem.select(
        "l_orderkey", "l_returnflag", "l_linestatus", percent.alias("percent"), tax.alias("tax"),
        F.col("l_quantity").cast("int").alias("qty"),
        F.rint(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        F.dayofmonth("l_shipdate").alias("day"),
        (tax * 5 + F.least(F.floor(percent / 2).cast("int"), F.lit(4))).alias("slot"),
    )
    col = F.col
    use = F.when(col("tax") == 8, 8)
    for p, land in enumerate(LAND_USE_BY_DISCOUNT):
        use = use.when(col("percent") == p, land)
    channel = F.when(col("day") >= CHANNEL_FROM_DAY[-1], len(CHANNELS) - 1)
    for i in range(len(CHANNELS) - 2, -1, -1):
        channel = channel.when(col("day") >= CHANNEL_FROM_DAY[i], i)
    lines = lines.withColumns({"use": use, "channel": channel})
    qty = col("qty").cast("long")
    return lines.groupBy("l_orderkey").agg(
        _bits(col("slot")).alias("asked"),
        _bits(col("slot"), col("l_returnflag") == "R").alias("yes"),
        _bits(col("slot"), col("l_returnflag") == "N").alias("no"),
        _bits(col("qty")).alias("seen"),
        _bits(col("qty"), col("l_linestatus") == "F").alias("ticked"),
        F.sum(qty).alias("acres"),
        F.sum("cents").alias("cents"),
        *[_sum_if(col("use") == i, qty).alias(f"use{i}") for i in range(len(LAND_USES))],
        *[_sum_if(col("channel") == i, col("cents")).alias(f"channel{i}") for i in range(len(CHANNELS))],
        _sum_if((col("l_returnflag") == "R") & (col("tax") == 0), qty).alias("lost0"),
        _sum_if((col("l_returnflag") == "R") & (col("tax") == 1), qty).alias("lost1"),
        _sum_if((col("l_returnflag") == "R") & (col("tax") == 2), qty).alias("lost2"),
    )


def customer_answers(orders: DataFrame, per_order: DataFrame) -> DataFrame:
    """Orders reduced to one row per customer, with the first and last order's attributes."""
    joined = orders.join(per_order, orders.o_orderkey == per_order.l_orderkey, "left")
    masks = ("asked", "yes", "no", "seen", "ticked")
    totals = [c for c in per_order.columns if c not in masks and c != "l_orderkey"]
    key = F.col("o_orderkey")
    # Categories as numbers: the aggregation buffers stay fixed-width, which keeps it a hash aggregation.
    priority, status = _code("o_orderpriority", PRIORITIES), _code("o_orderstatus", STATUSES)
    return joined.groupBy("o_custkey").agg(
        *[F.bit_or(m).alias(m) for m in masks],
        *[F.sum(c).alias(c) for c in totals],
        F.max_by(priority, key).alias("last_priority"),
        F.min_by(priority, key).alias("first_priority"),
        F.max_by(F.year("o_orderdate"), key).alias("last_year"),
        F.max_by(status, key).alias("last_status"),
        F.min_by(status, key).alias("first_status"),
    )


def _code(column: str, levels: tuple[str, ...]) -> Column:
    return Domain(levels).ordinal(F.col(column))


def _level(code: str, levels: tuple[str, ...]) -> str:
    return f"get(array({', '.join(repr(v) for v in levels)}), {code} - 1)"


def raw_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw response table, missing as the text ``NA`` and blanks as empty cells."""
    answers = customer_answers(
        table(spark, sf_dir, "orders"), order_answers(table(spark, sf_dir, "lineitem")))
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    answered = customer.join(answers, customer.c_custkey == answers.o_custkey, "left")
    base = lookup(answered, "c_nationkey", nation, "n_nationkey")
    cells = {
        "state": _unless_owing("n_name"),
        "rev_est": f"cents / 100.0D * {_WEIGHT}",
        "exp_est": f"channel0 / 100.0D * {_WEIGHT}",
        "org_v_conv": _unless_owing("c_mktsegment"),
        "border_noncrop": _unless_owing(_level("last_priority", PRIORITIES)),
        "border_livestock": _unless_owing(_level("first_priority", PRIORITIES)),
        "water_freq_test": _unless_owing("cast(last_year as string)"),
        "water_treat": _unless_owing(f"{_level('last_status', STATUSES)} || {_level('first_status', STATUSES)}"),
        "acre_sum": "cast(acres as double)",
        **{c: f"cast(use{i} as double)" for i, c in enumerate(LAND_USES)},
        "acre_other": f"case when c_acctbal >= 0 then cast(use{len(LAND_USES) - 1} as double) end",
        **{c: f"case when c_acctbal < 9500 then try_divide(100.0D * channel{i}, cents) end"
           for i, c in enumerate(CHANNELS)},
        **{c: f"case when lost{i} <> 7 then cast(lost{i} as double) end"
           for i, c in enumerate(("loss_acre_animals", "loss_acre_water", "loss_noncrop_acre"))},
        "loss_insurance_payout": f"coalesce(case when {_bit('yes', 40)} then cast(lost1 as string) end, 'NA')",
        "loss_other_payout": f"case when {_bit('no', 41)} then 'none' "
                             f"when {_bit('yes', 41)} then cast(lost2 as string) else '' end",
        "other_pna": _answer(44, "Source used", "Source not used"),
        **{c: _answer(i, "Yes", "No") for i, c in enumerate(schema.YES_NO)},
        **{c: _answer(i, "High Risk", "Low Risk")
           for i, c in enumerate(schema.RISK, start=len(schema.YES_NO))},
        **{c: _box(i % 50 + 1) for i, c in enumerate(schema.CHECK_ALL)},
    }
    return base.selectExpr("c_custkey", *[f"{cells[c]} as {c}" for c in schema.COLUMNS])


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``region_epa, state_abb`` from the nation and region tables."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("r_name").alias("region_epa"), F.col("n_nationkey").cast("string").alias("state_abb"))


def state_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("state_abb"), F.col("n_name").alias("state_name"))


def derived_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conformed, joined to regions, derived."""
    survey = conform(raw_survey(spark, sf_dir))
    return derive(attach_region(survey, regions(spark, sf_dir), state_names(spark, sf_dir)), DICTIONARY)
