"""Named queries on inputs that lose rows, digits or meaning where care is lacking, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.domain import Domain, recode, sorted_position
from canvass.functions import exact
from canvass.operators import inference, probit, profile, relate, reshape
from canvass.plans import oracle, panel
from canvass.plans.catalog import REGIONS, Query, customers, labelled_documents, lines, rounded
from canvass.plans.oracle import r
from canvass.session import scratch_path
from canvass.sources import sinks
from canvass.sources.conform import read_survey
from canvass.sources.records import read_cells
from canvass.sources.shapes import read_shapes, write_shapes
from canvass.sources.tables import SCHEMAS, table
from canvass.streaming.increment import GrowingProfile

# --- regressions -----------------------------------------------------------


def probit_near_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two regressors that differ by a millionth of their size: the discount, and what the quantity does besides."""
    terms = [probit.numeric_term("l_quantity"), probit.numeric_term("nudged", "l_quantity + l_discount / 1000"),
             *probit.factor_terms("l_linestatus", Domain(("F", "O")))]
    found = probit.fit_probits(lines(spark, sf_dir), terms, {"lines": ("returned", "untaxed")}).coefficients
    of = lambda term, c: F.max(F.when(F.col("term") == term, F.col(c)))
    return rounded(found.groupBy("dep").agg(
        (of("nudged", "estimate") / 1000).alias("slope"),
        (of("nudged", "std_error") / 1000).alias("std_error"),
        (of("nudged", "std_error_robust") / 1000).alias("std_error_robust"),
        of("nudged", "z").alias("z"),
        (of("nudged", "estimate") + of("l_quantity", "estimate")).alias("common_slope"),
        F.max("status").alias("status")))


def probit_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that a regressor foretells always, but for ties, and almost always."""
    docs = labelled_documents(spark, sf_dir).select(
        F.floor(F.col("n_chars") / 1000).cast("double").alias("thousands"),
        (F.col("n_chars") >= 3000).cast("int").alias("complete"),
        (F.col("n_chars") >= 2500).cast("int").alias("quasi"),
        ((F.col("n_chars") >= 3000) != (F.col("doc_id") % 97 == 0)).cast("int").alias("near"))
    batch = probit.fit_probits(docs, [probit.numeric_term("thousands")], {"lengths": ("complete", "quasi", "near")})
    return batch.fits.select("dep", "n", "ones", "status")


SEPARATION = """
with d as (
  select floor(n_chars / 1000) as x, unnest(['complete', 'quasi', 'near']) as dep,
         unnest([n_chars >= 3000, n_chars >= 2500, (n_chars >= 3000) <> (doc_id % 97 = 0)]) as y
  from documents left join labels using (doc_id) where n_chars is not null)
select dep, count(*) as n, count(*) filter (y) as ones,
       case when max(x) filter (not y) < min(x) filter (y) then 'separated'
            when max(x) filter (not y) <= min(x) filter (y) then 'quasi-separated' else 'ok' end as status
from d group by dep"""

# --- sources and sinks -----------------------------------------------------


def csv_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to CSV, line breaks and all, and read back by many tasks."""
    path = scratch_path(spark, "texts")
    sinks.write_quoted_table(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang"), path)
    text = F.coalesce("text", F.lit(""))
    return read_cells(spark, path, ["doc_id", "text", "lang"]).select(
        F.col("doc_id").cast("long"), F.md5(text).alias("digest"), F.length(text).cast("long").alias("chars"), "lang")


def csv_inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column types found in the cells of a written file, with what was read under them."""
    path = scratch_path(spark, "orders")
    sinks.write_table(table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "F").alias("filled"), "o_orderpriority",
        F.concat((F.col("o_orderkey") % 10).cast("string"), F.lit("d")).alias("code"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 7).alias("gaps"),
        F.lit(None).cast("string").alias("nothing")), path)
    found = read_survey(spark, path, multi_line=True, infer=True)
    numbers = {n for n, kind in found.dtypes if kind in ("bigint", "double")}
    cells = [f"struct('{n}' as name, '{kind}' as kind, count({n}) as filled, {f'cast(sum({n}) as double)' if n in numbers else 'cast(null as double)'} as total)" for n, kind in found.dtypes]
    return rounded(found.agg(F.expr(f"array({', '.join(cells)})").alias("c")).select(F.inline("c")), 2)


def _typed(name: str, kind: str, e: str, total: bool) -> str:
    return f"select '{name}' as name, '{kind}' as kind, count({e}) as filled, {f'round(sum({e})::double, 2)' if total else 'null::double'} as total from orders"


INFERRED = "\nunion all ".join([
    _typed("o_orderkey", "bigint", "o_orderkey", True), _typed("o_totalprice", "double", "o_totalprice", True),
    _typed("filled", "boolean", "o_orderstatus", False), _typed("o_orderpriority", "string", "o_orderpriority", False),
    _typed("code", "string", "o_orderkey", False), _typed("gaps", "bigint", "case when o_orderkey % 3 <> 0 then o_orderkey % 7 end", True),
    _typed("nothing", "boolean", "null::int", False)])


def csv_missing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts spelled ``NA``, blank and missing cells, written and read back as what they were."""
    key = F.col("c_custkey") % 4
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(key == 0, "NA").when(key == 1, "").when(key == 2, F.col("c_mktsegment")).alias("cell"),
        F.when(key != 3, F.col("c_acctbal")).alias("balance"))
    path = scratch_path(spark, "missing")
    sinks.write_table(rows, path)
    return sinks.read_table(spark, path, rows)


# --- pivots, levels, profiles ----------------------------------------------


def spread_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many rows a cell, merged by an aggregate of the caller's."""
    return reshape.spread(lines(spark, sf_dir), ["l_returnflag", "large"], "l_linestatus", ["F", "O"], "l_linenumber", merge=F.sum)


def collated_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels in mixed case, picked by their place in dictionary order."""
    mixed = F.when(F.col("o_orderkey") % 2 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority"))
    orders = table(spark, sf_dir, "orders").select(mixed.alias("spelt"))
    places = sorted_position(orders, "spelt", {k: f"level {k}" for k in range(1, 6)}, "UNICODE")
    return relate.group_frequency(orders.withColumn("place", recode(F.col("spelt"), places)), "place", "n")


def profile_beyond_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A domain that lists two of five segments: the others are one level, and the groups stay bounded."""
    cuts = [profile.Cut("c_mktsegment", "Segment", Domain(("BUILDING", "MACHINERY"))), profile.Cut("r_name", "Region", REGIONS)]
    return profile.profile(customers(spark, sf_dir), cuts, profile.means("in_credit", "wealthy"), overall="All customers")


def profile_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as a stream, their profile kept as sums that add up."""
    cuts = [profile.Cut("o_orderstatus", "Status", Domain(("F", "O", "P"))), profile.Cut("o_orderpriority", "Priority", Domain(panel.PRIORITIES))]
    path = scratch_path(spark, "growing")
    growing = GrowingProfile(spark, f"{path}/sums", cuts, [*profile.means("o_totalprice"), profile.Measure("customers", "o_custkey", "sum")])
    stream = spark.readStream.schema(SCHEMAS["orders"]).parquet(f"{sf_dir}/orders.parque[t]")  # a file or a folder of files
    growing.follow(stream, f"{path}/seen", availableNow=True).awaitTermination()
    return rounded(growing.profile(overall="All orders"), 4)


def exact_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charged amounts by return flag, summed without an order."""
    charged = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    sums = exact.exact_sums(lines(spark, sf_dir).withColumn("charged", charged), ["l_returnflag"], ["charged", "l_linenumber"])
    return rounded(sums.select("l_returnflag", "rows", F.col("sum__charged").alias("charged"), F.col("sum__l_linenumber").alias("numbers")), 2)


def chi2_log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests whose p-values are too small for a double, told apart by their logarithms."""
    rows = lines(spark, sf_dir).withColumn("shipyear", F.year("l_shipdate"))
    tests = [inference.chi2_test(rows, x, y, with_log=True) for x, y in (("l_returnflag", "l_linestatus"), ("l_returnflag", "shipyear"), ("l_returnflag", "l_linenumber"))]
    return rounded(reshape.stack_by_name(*tests).select("cut", "resp", "stat", "df", "log_p"), 4)


CHI2_LOG = f"""
with {oracle.LINES}, ly as (select *, year(l_shipdate) as shipyear from li),
{oracle.chi2([("ly", "l_returnflag", "l_linestatus"), ("ly", "l_returnflag", "shipyear"), ("ly", "l_returnflag", "l_linenumber")])}"""
#: All three tables have an even number of degrees of freedom, whose tail is a finite sum.
CHI2_LOG = f"""
select cut, resp, {r('stat', 4)} as stat, cast(df as int) as df,
       {r('-stat / 2 / ln(10) + log10(list_sum(list_transform(range(0, cast(df // 2 as bigint)), lambda k: pow(stat / 2, k) / gamma(k + 1))))', 4)} as log_p
from ({CHI2_LOG})"""

def shapefile_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle for each customer, a third of them with a hole, some without geometry, through a folder of shapefiles."""
    corners = lambda *points: "array(" + ", ".join(f"array(cast({x} as double), cast({y} as double))" for x, y in points) + ")"
    place = table(spark, sf_dir, "customer").selectExpr(
        "*", "c_custkey % 360 - 180 as x", "c_nationkey as y", "1 + c_custkey % 7 as w", "1 + c_custkey % 5 as h")
    outer = corners(("x", "y"), ("x", "y + h"), ("x + w", "y + h"), ("x + w", "y"), ("x", "y"))
    hole = corners(("x + 0.25", "y + 0.25"), ("x + 0.25", "y + 0.5"), ("x + 0.5", "y + 0.5"), ("x + 0.5", "y + 0.25"), ("x + 0.25", "y + 0.25"))
    path = scratch_path(spark, "shapes")
    write_shapes(place.selectExpr(
        "cast(c_custkey as long) as custkey", "case when c_custkey % 4 <> 2 then c_mktsegment end as segment",
        "cast(c_acctbal as double) as balance", "c_custkey % 2 = 0 as even",
        f"case when c_custkey % 11 <> 0 then if(c_custkey % 3 = 0, array({outer}, {hole}), array({outer})) end as rings"), path)
    return read_shapes(spark, path)


SHAPES = """
with p as (select *, c_custkey % 360 - 180 as x, c_nationkey as y, 1 + c_custkey % 7 as w, 1 + c_custkey % 5 as h from customer)
select cast(c_custkey as bigint) as custkey, case when c_custkey % 4 <> 2 then c_mktsegment end as segment,
       cast(c_acctbal as double) as balance, c_custkey % 2 = 0 as even,
       case when c_custkey % 11 <> 0 then
         format('POLYGON (({} {}, {} {}, {} {}, {} {}, {} {})', x, y, x, y + h, x + w, y + h, x + w, y, x, y)
         || case when c_custkey % 3 = 0 then format(', ({} {}, {} {}, {} {}, {} {}, {} {})',
              x + 0.25, y + 0.25, x + 0.5, y + 0.25, x + 0.5, y + 0.5, x + 0.25, y + 0.5, x + 0.25, y + 0.25) else '' end
         || ')' end as geometry_wkt from p"""


QUERIES: dict[str, Query] = {
    "probit_near_dependence": probit_near_dependence,
    "probit_separation": probit_separation,
    "csv_line_breaks": csv_line_breaks,
    "csv_inferred_types": csv_inferred_types,
    "csv_missing_texts": csv_missing_texts,
    "shapefile_round_trip": shapefile_round_trip,
    "spread_merged": spread_merged,
    "collated_levels": collated_levels,
    "profile_beyond_domain": profile_beyond_domain,
    "profile_streamed": profile_streamed,
    "exact_totals": exact_totals,
    "chi2_log_tail": chi2_log_tail,
}
ORACLE: dict[str, str] = {
    "probit_near_dependence": f"""with {oracle.LINES},\n{oracle.LINE_MODELS}
        select dep, {r("max(estimate) filter (term = 'l_discount')")} as slope, {r("max(std_error) filter (term = 'l_discount')")} as std_error,
          {r("max(std_error_robust) filter (term = 'l_discount')")} as std_error_robust, {r("max(z) filter (term = 'l_discount')")} as z,
          {r("max(estimate) filter (term = 'l_quantity')")} as common_slope, 'ok' as status from coefs group by dep""",
    "probit_separation": SEPARATION,
    "csv_line_breaks": "select doc_id, md5(coalesce(text, '')) as digest, length(coalesce(text, '')) as chars, lang from documents",
    "csv_inferred_types": INFERRED,
    "csv_missing_texts": """
        select c_custkey, case c_custkey % 4 when 0 then 'NA' when 1 then '' when 2 then c_mktsegment end as cell,
          case when c_custkey % 4 <> 3 then c_acctbal end as balance from customer""",
    "shapefile_round_trip": SHAPES,
    "spread_merged": """
        select l_returnflag, cast(l_quantity > 25 as int) as large, sum(l_linenumber) filter (l_linestatus = 'F')::bigint as "F",
          sum(l_linenumber) filter (l_linestatus = 'O')::bigint as "O" from lineitem group by all""",
    "collated_levels": """
        with o as (select case when o_orderkey % 2 = 0 then lower(o_orderpriority) else o_orderpriority end as v from orders),
        place as (select v, row_number() over (order by lower(v), v desc) as k from (select distinct v from o where v is not null))
        select case when k <= 5 then 'level ' || k end as place, count(*) as n from o left join place using (v) group by 1""",
    "profile_beyond_domain": f"with {oracle.CUSTOMERS}\n" + oracle.profile(
        "cus", [("case when c_mktsegment is null or c_mktsegment in ('BUILDING', 'MACHINERY') then c_mktsegment else 'other' end", "Segment"), ("r_name", "Region")],
        {"in_credit": oracle.avg("in_credit"), "wealthy": oracle.avg("wealthy")}, "All customers"),
    "profile_streamed": oracle.profile(
        "orders", [("o_orderstatus", "Status"), ("o_orderpriority", "Priority")],
        {"o_totalprice": r("fsum(o_totalprice) / count(o_totalprice)", 4), "customers": oracle.total("o_custkey")}, "All orders"),
    "exact_totals": """
        select l_returnflag, count(*) as rows, round(fsum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as charged,
          sum(l_linenumber)::bigint as numbers from lineitem group by l_returnflag""",
    "chi2_log_tail": CHI2_LOG,
}
