"""Named queries over the given tables, one per operator and per output of the survey analysis."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.domain import Domain, bin_by, recode, sorted_position
from canvass.functions import flags
from canvass.operators import inference, probit, profile, relate, reshape
from canvass.plans import panel, survey
from canvass.session import local_table, scratch_path
from canvass.sources import sinks
from canvass.sources.conform import conform, read_region_attributes, read_region_map, read_survey, text_cell
from canvass.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

SEGMENTS = Domain(panel.SEGMENTS)
REGIONS = panel.DICTIONARY.regions
LANGUAGES = Domain(("de", "en", "es", "fr"))
LENGTHS = Domain(("<500", "500-2K", "2-8K", "8K+"))
PRIORITIES = Domain(panel.PRIORITIES)
LABELLED = Domain(("low", "high"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, so that summing order does not show.

    Means of whole numbers need none of this: they are one exact division.
    """
    return df.select(*[
        (F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def tests_shown(df: DataFrame) -> DataFrame:
    """Test results with the logarithm of the p-value, in which small ones differ."""
    return rounded(df.withColumn("log_p", F.when(F.col("pval") > 0, F.log10("pval"))))


# --- shared inputs ---------------------------------------------------------


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their region, spending and spending bin."""
    customer, nation, region, orders = (
        table(spark, sf_dir, t) for t in ("customer", "nation", "region", "orders"))
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    spend = orders.groupBy("o_custkey").agg(
        F.sum(F.rint(F.col("o_totalprice") * 100).cast("long")).alias("spend_cents"),
        F.count(F.lit(1)).alias("n_orders"))
    joined = customer.join(places, customer.c_nationkey == places.n_nationkey, "left").join(
        spend, customer.c_custkey == spend.o_custkey, "left")
    return joined.withColumns({
        "balance_cents": F.rint(F.col("c_acctbal") * 100).cast("long"),
        "spend_bin": bin_by(F.col("spend_cents") / 100, survey.REVENUE_EDGES, survey.REVENUE.levels),
        "in_credit": (F.col("c_acctbal") > 0).cast("int"),
        "wealthy": (F.col("c_acctbal") > 5000).cast("int"),
        "n_orders": F.coalesce(F.col("n_orders"), F.lit(0)),
    })


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their 0/1 labels where they have any."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "label_id")
    joined = relate.lookup(documents, "doc_id", labels, "label_id")
    return joined.withColumns({
        "length": bin_by(F.col("n_chars"), (500, 2000, 8000), LENGTHS.levels),
        "label": recode(F.col("quality").cast("string"), {"0": "low", "1": "high"}),
        "english": flags.equals("lang", "en").cast("int"),
    })


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumns({
        "discounted": (F.col("l_discount") > 0.05).cast("int"),
        "untaxed": (F.col("l_tax") == 0).cast("int"),
        "large": (F.col("l_quantity") > 25).cast("int"),
        "returned": (F.col("l_returnflag") == "R").cast("int"),
    })


# --- profiles and aggregates -----------------------------------------------


def profile_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = [profile.Cut("c_mktsegment", "Segment", SEGMENTS), profile.Cut("r_name", "Region", REGIONS),
            profile.Cut("spend_bin", "Spending", survey.REVENUE)]
    measures = [profile.Measure("balance_cents", "balance_cents"), profile.Measure("spend_cents", "spend_cents"),
                profile.Measure("in_credit", "in_credit"), profile.Measure("wealthy", "wealthy"),
                profile.Measure("orders", "n_orders", "sum")]
    return profile.profile(customers(spark, sf_dir), cuts, measures, overall="All customers")


def profile_flags_nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = [profile.Cut("lang", "Language", LANGUAGES), profile.Cut("length", "Length", LENGTHS),
            profile.Cut("label", "Label", LABELLED)]
    measures = profile.means("quality", "toxic", "english") + [
        profile.Measure("toxic_docs", "toxic", "sum")]
    return profile.profile(labelled_documents(spark, sf_dir), cuts, measures, overall="All documents")


def profile_open_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts without a declared domain: rows are expanded per cut."""
    cuts = [profile.Cut("source", "Source"), profile.Cut("lang", "Language")]
    return profile.profile(
        labelled_documents(spark, sf_dir), cuts, profile.means("quality", "toxic"), overall="All documents")


def global_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.global_summary(
        labelled_documents(spark, sf_dir),
        [*profile.means("quality", "toxic"), profile.Measure("toxic_docs", "toxic", "sum")])


def conditional_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.conditional_count(table(spark, sf_dir, "orders"), "o_orderpriority", "1-URGENT", "urgent")


def frequency_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.frequency_table(labelled_documents(spark, sf_dir), "label")


def group_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.group_frequency(labelled_documents(spark, sf_dir), "label")


def mean_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.mean_interval(table(spark, sf_dir, "lineitem"), "l_discount"), 9)


def mean_interval_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.mean_interval(
        labelled_documents(spark, sf_dir), "quality", by=["source"], level=0.9))


# --- reshape ---------------------------------------------------------------


def crosstab_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = Domain(tuple(p for p in PRIORITIES.levels if p != "4-NOT SPECIFIED"))
    orders = table(spark, sf_dir, "orders").withColumn("priority", known.restrict(F.col("o_orderpriority")))
    return reshape.crosstab(orders, "o_orderstatus", "priority", known.levels, "Status")


def crosstab_unlisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column with values that are not listed, one of them spelled ``NA``, next to missing ones."""
    odd = F.expr("case lang when 'fr' then 'NA' when 'es' then null else lang end")
    documents = table(spark, sf_dir, "documents").select("source", odd.alias("odd"))
    return reshape.crosstab(documents, "source", "odd", ["en"], "Source")


def crosstab_means_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reshape.crosstab_means(
        labelled_documents(spark, sf_dir), "source", "lang", LANGUAGES.levels, "toxic", "Source"))


def _line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    discounted, untaxed = F.col("discounted") == 1, F.col("untaxed") == 1
    return lines(spark, sf_dir).withColumns({
        "off": discounted.cast("int"),
        "free": (~discounted & untaxed).cast("int"),
        "plain": (~discounted & ~untaxed).cast("int"),
    })


def transpose_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = ["off", "free", "plain"]
    flag, status = Domain(("A", "N", "R")), Domain(("F", "O"))
    long = profile.profile(
        _line_classes(spark, sf_dir),
        [profile.Cut("l_returnflag", "Flag", flag), profile.Cut("l_linestatus", "Status", status)],
        profile.sums(*measures), overall="All", count_as=None)
    names = ["All_All", *[f"Flag_{v}" for v in flag.levels], *[f"Status_{v}" for v in status.levels]]
    return reshape.transpose(long, measures, names)


def gather_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = labelled_documents(spark, sf_dir).select("doc_id", "quality", "toxic", "english")
    return reshape.gather(wide, ["doc_id"], ["quality", "toxic", "english"])


def union_by_name_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("place"),
        F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("place"))
    return reshape.stack_by_name(customer, None, supplier)


# --- projections and derivations -------------------------------------------


def bin_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts with zero as "not reported", binned, with the bin's position."""
    amount = flags.zero_to_null("greatest(c_acctbal, 0.0D)")
    domain = Domain(("<1K", "1-4K", "4-8K", "8K+"))
    return (
        table(spark, sf_dir, "customer")
        .withColumn("bin", bin_by(amount, (1000, 4000, 8000), domain.levels))
        .groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bin_ord", domain.ordinal(F.col("bin"))))


def recode_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels picked by position in the sorted distinct values, several sharing a label."""
    orders = table(spark, sf_dir, "orders")
    mapping = sorted_position(orders, "o_orderpriority", {5: "calm", 1: "fast", 2: "fast", 3: "calm"})
    return relate.group_frequency(
        orders.withColumn("pace", recode(F.col("o_orderpriority"), mapping)), "pace", "n")


def domain_restrict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-domain values become NULL and sort last; positions follow the domain."""
    domain = Domain(("MACHINERY", "BUILDING", "FURNITURE"))
    segment = domain.restrict(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select(
        segment.alias("segment"), domain.ordinal(segment).alias("segment_ord")
    ).groupBy("segment", "segment_ord").agg(F.count(F.lit(1)).alias("n"))


def share_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer, the concentration of spending across order priorities."""
    cents = F.rint(F.col("o_totalprice") * 100).cast("long")
    spend = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.sum(cents).alias("total"),
        *[F.sum(F.when(F.col("o_orderpriority") == p, cents).otherwise(0)).alias(f"part{i}")
          for i, p in enumerate(PRIORITIES.levels)])
    joined = relate.lookup(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", spend, "o_custkey")
    shares = joined.withColumns({
        f"share{i}": flags.share(f"part{i}", "total") for i in range(len(PRIORITIES.levels))})
    return rounded(shares.select("c_custkey", "share0", flags.concentration(
        *[f"share{i} * 100" for i in range(len(PRIORITIES.levels))]).alias("hhi")), 4)


def _event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").selectExpr(
        "event_id", "event_type", "value",
        "case event_type when 'error' then 'NA' when 'view' then '' else props end as props",
        "case event_type when 'error' then 'yes' when 'click' then 'NA' else '' end as note")
    return raw.selectExpr("event_id", "event_type", "value",
                          f"{text_cell('props')} as props", f"{text_cell('note')} as note")


def answered_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank and missing cells, counted by kind of event, booleans cast by type."""
    cells = _event_cells(spark, sf_dir)
    marked = flags.booleans_to_int(cells.select(
        "event_type",
        flags.answered("props").alias("answered"),
        flags.any_answered("props", "note").alias("any_answered"),
        flags.equals("note", "yes").alias("yes"),
        flags.any_positive("value - 50", "case when note = 'yes' then value end").alias("positive"),
    ))
    return rounded(marked.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("answered").alias("answered"),
        F.sum("any_answered").alias("any_answered"), F.avg("yes").alias("yes"),
        F.count("yes").alias("yes_known"), F.sum("positive").alias("positive")))


def coerce_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts kept as text, some of it no number."""
    text = ("case c_mktsegment when 'MACHINERY' then c_name when 'FURNITURE' then null "
            "else cast(floor(c_acctbal) as string) end")
    return table(spark, sf_dir, "customer").select(
        "c_mktsegment", flags.text_positive(text).cast("int").alias("paid")
    ).groupBy("c_mktsegment").agg(F.sum("paid").alias("paid"), F.count("paid").alias("n"))


def row_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row maximum and minimum where a missing value stays missing."""
    cols = ("quality", "toxic", "english")
    return labelled_documents(spark, sf_dir).select(
        "doc_id", flags.row_max(*cols).alias("most"), flags.row_min(*cols).alias("least"),
        flags.row_sum(*cols).alias("total"))


def boolean_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-valued logic kept through a cast chosen by column type."""
    good, bad = F.col("quality") == 1, F.col("toxic") == 1
    return flags.booleans_to_int(labelled_documents(spark, sf_dir).select(
        "doc_id", "lang", good.alias("good"), (good & ~bad).alias("clean"), (good | bad).alias("either"),
        F.col("quality").isNull().alias("unlabelled")))


def select_and_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column order, renames and an in-place rescale."""
    part = table(spark, sf_dir, "part").withColumn("p_retailprice", F.col("p_retailprice") / 100)
    moved = reshape.select_first(part, "p_type", "p_brand").withColumnsRenamed({"p_type": "kind", "p_brand": "brand"})
    return rounded(moved.toDF(*[c.removeprefix("p_") for c in moved.columns]))


# --- joins and missing data ------------------------------------------------


def natural_join_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inline table joined on the column both sides share; unmatched rows stay."""
    side = local_table(
        spark, [(0, "South"), (1, "West"), (3, "North")], "n_regionkey int, side string")
    nation = table(spark, sf_dir, "nation")
    mapped = relate.natural_left_join(nation, side).select("n_nationkey", "side")
    placed = relate.lookup(table(spark, sf_dir, "customer"), "c_nationkey", mapped, "n_nationkey")
    return relate.group_frequency(placed, "side", "n")


def left_join_keep_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_documents(spark, sf_dir).select("doc_id", "quality", "toxic")


def full_outer_region_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region attributes and counts, each side with a region the other lacks."""
    attributes = table(spark, sf_dir, "region").where(F.col("r_name") != "AFRICA").select(
        F.col("r_name").alias("name"), F.concat(F.lit("POINT("), F.col("r_regionkey"), F.lit(" 0)")).alias("geometry_wkt"))
    people = customers(spark, sf_dir).where(F.col("r_name") != "EUROPE")
    return rounded(relate.region_frequency(attributes, people, "name", "r_name"))


def listwise_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = relate.complete_cases(labelled_documents(spark, sf_dir), "quality", "toxic")
    return known.select("doc_id", "quality", "toxic")


# --- tests -----------------------------------------------------------------


def chi2_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of three and more levels against 0/1 flags."""
    cut = [profile.Cut("l_returnflag", "Flag", Domain(("A", "N", "R")))]
    by_flag = inference.chi2_flags(lines(spark, sf_dir), cut, ["discounted", "untaxed", "large"])
    segments = inference.chi2_flags(
        customers(spark, sf_dir), [profile.Cut("c_mktsegment", "Segment", SEGMENTS),
                                   profile.Cut("r_name", "Region", REGIONS)], ["in_credit", "wealthy"])
    return tests_shown(reshape.stack_by_name(by_flag, segments))


def chi2_two_by_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = [profile.Cut("l_linestatus", "Status", Domain(("F", "O")))]
    return tests_shown(inference.chi2_flags(lines(spark, sf_dir), cut, ["discounted", "untaxed", "large", "returned"]))


def chi2_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of dozens of levels: more than 3,000 degrees of freedom."""
    keys = table(spark, sf_dir, "lineitem").selectExpr("l_partkey % 61 as part", "l_orderkey % 53 as ord")
    return tests_shown(inference.chi2_test(keys, "part", "ord"))


def chi2_nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses and levels with missing values, in pairs of every shape."""
    cuts = [profile.Cut("lang", "Language", LANGUAGES), profile.Cut("length", "Length", LENGTHS),
            profile.Cut("label", "Label", LABELLED), profile.Cut("source", "Source")]
    return tests_shown(inference.chi2_flags(
        labelled_documents(spark, sf_dir), cuts, ["quality", "toxic", "english"]))


def chi2_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two categories of several levels each."""
    return tests_shown(inference.chi2_test(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority"))


def chi2_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with cells nobody falls into."""
    return tests_shown(inference.chi2_test(labelled_documents(spark, sf_dir), "source", "length"))


# --- regressions -----------------------------------------------------------


def _document_terms() -> list[probit.Term]:
    return [*probit.factor_terms("lang", LANGUAGES.relevel("en")),
            probit.numeric_term("kchars", "n_chars / 1000")]


def design_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = relate.complete_cases(labelled_documents(spark, sf_dir), "quality", "toxic")
    return rounded(probit.design_matrix(known, _document_terms(), keep=["doc_id", "quality"]))


def _document_models(spark: SparkSession, sf_dir: str) -> probit.ProbitBatch:
    return probit.fit_probits(
        labelled_documents(spark, sf_dir), _document_terms(), {"labels": ("quality", "toxic")})


def probit_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_document_models(spark, sf_dir).coefficients)


def probit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marginal effects over every order line: two measures, one category, two outcomes."""
    terms = [probit.numeric_term("l_quantity"), probit.numeric_term("l_discount"),
             *probit.factor_terms("l_linestatus", Domain(("F", "O")))]
    batch = probit.fit_probits(lines(spark, sf_dir), terms, {"lines": ("returned", "untaxed")})
    return rounded(batch.effects)


def probit_far_from_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same effects for a regressor whose mean is more than 300,000 times its spread."""
    terms = [probit.numeric_term("l_quantity", "l_quantity + 5000000"), probit.numeric_term("l_discount"),
             *probit.factor_terms("l_linestatus", Domain(("F", "O")))]
    batch = probit.fit_probits(lines(spark, sf_dir), terms, {"lines": ("returned", "untaxed")})
    return rounded(batch.effects)


def probit_undeclared_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in a language that the domain does not list leave the models."""
    terms = [*probit.factor_terms("lang", Domain(("en", "de", "fr"))), probit.numeric_term("kchars", "n_chars / 1000.0D")]
    return rounded(probit.fit_probits(labelled_documents(spark, sf_dir), terms, {"labels": ("quality", "toxic")}).coefficients)


# --- sources and sinks -----------------------------------------------------


def _round_trip(write, df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    write(df, path)
    return sinks.read_table(df.sparkSession, path, df)


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile written as CSV with ``NA`` for missing, and read back."""
    return _round_trip(sinks.write_table, profile_flags_nullable(spark, sf_dir), "csv")


def quoted_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(sinks.write_quoted_table, chi2_nullable(spark, sf_dir), "quoted")


def region_attributes_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region attributes stored and scanned under their declared schema."""
    path = scratch_path(spark, "regions")
    table(spark, sf_dir, "region").select(
        F.col("r_name").alias("name"),
        F.concat(F.lit("POINT("), F.col("r_regionkey"), F.lit(" 0)")).alias("geometry_wkt")).write.parquet(path)
    return read_region_attributes(spark, path)


def region_map_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region map written as a quoted CSV, its columns dotted and in another order, and read by its header."""
    path = scratch_path(spark, "region_map")
    panel.regions(spark, sf_dir).select(F.col("state_abb").alias("state.abb"), "region_epa").write.options(
        header=True, quoteAll=True).csv(path)
    return read_region_map(spark, path)


def _bundled(spark: SparkSession, sf_dir: str) -> tuple[str, list[str]]:
    path = scratch_path(spark, "bundle")
    tables = {"segments": profile_segments(spark, sf_dir), "documents": profile_flags_nullable(spark, sf_dir),
              "orders": crosstab_counts(spark, sf_dir)}
    sinks.write_bundle(tables, path)
    return path, list(tables)


def bundle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables stored as one bundle and counted."""
    return sinks.bundle_manifest(spark, *_bundled(spark, sf_dir))


def bundle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables stored as one bundle and read back, cell by cell."""
    path, names = _bundled(spark, sf_dir)
    return reshape.stack_by_name(*[sinks.read_bundle(spark, path, n).withColumn("name", F.lit(n)) for n in names])


# --- the survey analysis ---------------------------------------------------


def _derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.derived_survey(spark, sf_dir)


def _stored(df: DataFrame) -> DataFrame:
    """A derived table as parquet in the shared folder, for work that reads it several times."""
    path = scratch_path(df.sparkSession, "survey")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


DERIVED_COLUMNS = (
    "rev_cat", "rev_cat_abbr", "org", "org_abbr", "fvacreage_pct", *survey.SHARES,
    "fvacreage_quartile", "acre_hhi", "dist_hhi", "directsales_quartile", "lscape_wild", "lscape_graze",
    *survey.YES_FLAGS, *survey.RISK_FLAGS, *survey.ANSWERED_FLAGS, *survey.ANY_ANSWERED_FLAGS,
    *survey.ANY_POSITIVE_FLAGS, *survey.AMOUNT_FLAGS, "test_freq", "treat_freq",
    *survey.ROW_MAX_FLAGS, *survey.ROW_MIN_FLAGS,
)


def derived_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every derived column of every respondent, to the last bit."""
    wide = survey.collapse_inputs(_derived(spark, sf_dir))
    return wide.select("c_custkey", "region_epa", "rev_est", "exp_est", *DERIVED_COLUMNS)


def survey_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw survey written as CSV, scanned and conformed, its cells counted by kind."""
    path = scratch_path(spark, "raw")
    raw = panel.raw_survey(spark, sf_dir)
    raw.write.csv(path, header=True)
    cells = read_survey(spark, path, raw.columns)
    kinds = ["state", "org_v_conv", "other_pna", "train_attend", "risk_birds", "water_stand"]
    numbers = ["rev_est", "acre_other", "sale_directcons", "loss_acre_animals"]
    return cells.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_missing") for c in kinds + numbers],
        *[F.count_if(F.col(c) == "").alias(f"{c}_blank") for c in kinds],
        F.sum("acre_sum").alias("acres"))


def farm_characteristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(survey.farm_characteristics(_derived(spark, sf_dir), panel.DICTIONARY))


def farm_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(survey.farm_checks(_derived(spark, sf_dir)))


def water_management(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.water_management(_derived(spark, sf_dir), panel.DICTIONARY)


def _profile_table(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return survey.profile_table(_derived(spark, sf_dir), panel.DICTIONARY, name)
    return run


def workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eleven tables stored as one bundle and read back, cell by cell."""
    path = scratch_path(spark, "workbook")
    tables = survey.all_tables(_stored(_derived(spark, sf_dir)), panel.DICTIONARY)
    sinks.write_bundle(tables, path)
    read = {n: sinks.read_bundle(spark, path, n) for n in tables}
    read["tbl1"] = rounded(read["tbl1"])
    return reshape.stack_by_name(*[df.withColumn("name", F.lit(n)) for n, df in read.items()])


def tbl2_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each row of a table stands: blocks in their order, levels in that of their domain."""
    rows = survey.profile_table(_derived(spark, sf_dir), panel.DICTIONARY, "tbl2", with_order=True)
    place = F.row_number().over(Window.orderBy("block_ord", F.col("level_ord").asc_nulls_last(), F.col("level").asc_nulls_last()))
    return rows.select("type", "level", place.alias("place"))


def tbl2_from_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second table with the category levels looked up in the data instead of declared."""
    answers = conform(panel.raw_survey(spark, sf_dir))
    words = survey.Dictionary.from_data(answers, panel.DICTIONARY.regions)
    placed = survey.attach_region(answers, panel.regions(spark, sf_dir), panel.state_names(spark, sf_dir))
    return survey.profile_table(survey.derive(placed, words), words, "tbl2")


def independence_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = survey.independence_columns(survey.collapse_inputs(_derived(spark, sf_dir)))
    return tests_shown(survey.independence_tests(_stored(columns), panel.DICTIONARY))


def acreage_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(survey.acreage_interval(_derived(spark, sf_dir)), 9)


def region_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(survey.region_map_data(region_attributes_scan(spark, sf_dir), _derived(spark, sf_dir)))


def probit_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(survey.probit_models(_derived(spark, sf_dir)).coefficients)


def probit_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(survey.probit_models(_derived(spark, sf_dir)).effects)


def probit_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(survey.probit_models(_derived(spark, sf_dir)).fits.drop("iterations"))


def probit_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.probit_signs(survey.probit_models(_derived(spark, sf_dir)))


def _probit_report(family: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return survey.probit_report(survey.probit_models(_derived(spark, sf_dir), [family]), family)
    return run


def model_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models stored by family and read back, number by number."""
    path = scratch_path(spark, "models")
    sinks.write_models(survey.probit_models(_derived(spark, sf_dir)), path)
    return rounded(reshape.stack_by_name(*[
        spark.read.parquet(f"{path}/{name}").withColumn("stored_as", F.lit(name))
        for name in ("coefficients", "effects", "fits")]).drop("iterations"))


def report_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five coefficient reports written as CSV and read back, cell by cell."""
    path = scratch_path(spark, "reports")
    models = survey.probit_models(_derived(spark, sf_dir))
    sinks.write_reports({f: survey.probit_report(models, f) for f in survey.PROBIT_FAMILIES}, path)
    return reshape.stack_by_name(*[
        spark.read.csv(f"{path}/{f}", header=True, nullValue="NA", escape='"').withColumn("family", F.lit(f))
        for f in survey.PROBIT_FAMILIES])


QUERIES: dict[str, Query] = {
    "profile_segments": profile_segments,
    "profile_flags_nullable": profile_flags_nullable,
    "profile_open_cuts": profile_open_cuts,
    "global_summary": global_summary,
    "conditional_count": conditional_count,
    "frequency_table": frequency_table,
    "group_frequency": group_frequency,
    "mean_interval": mean_interval,
    "mean_interval_by": mean_interval_by,
    "crosstab_counts": crosstab_counts,
    "crosstab_unlisted": crosstab_unlisted,
    "crosstab_means_nan": crosstab_means_nan,
    "transpose_table": transpose_table,
    "gather_measures": gather_measures,
    "union_by_name_fill": union_by_name_fill,
    "bin_thresholds": bin_thresholds,
    "recode_collapse": recode_collapse,
    "domain_restrict": domain_restrict,
    "share_concentration": share_concentration,
    "answered_flags": answered_flags,
    "coerce_positive": coerce_positive,
    "row_extremes": row_extremes,
    "boolean_columns": boolean_columns,
    "select_and_rename": select_and_rename,
    "natural_join_map": natural_join_map,
    "left_join_keep_unmatched": left_join_keep_unmatched,
    "full_outer_region_freq": full_outer_region_freq,
    "listwise_complete": listwise_complete,
    "chi2_by_flag": chi2_by_flag,
    "chi2_two_by_two": chi2_two_by_two,
    "chi2_nullable": chi2_nullable,
    "chi2_large": chi2_large,
    "chi2_categories": chi2_categories,
    "chi2_sparse": chi2_sparse,
    "design_matrix": design_matrix,
    "probit_documents": probit_documents,
    "probit_lines": probit_lines,
    "probit_far_from_zero": probit_far_from_zero,
    "probit_undeclared_level": probit_undeclared_level,
    "csv_round_trip": csv_round_trip,
    "quoted_csv_round_trip": quoted_csv_round_trip,
    "region_attributes_scan": region_attributes_scan,
    "region_map_csv": region_map_csv,
    "bundle_counts": bundle_counts,
    "bundle_round_trip": bundle_round_trip,
    "derived_columns": derived_columns,
    "survey_csv_scan": survey_csv_scan,
    "tbl1": farm_characteristics,
    "tbl1_checks": farm_checks,
    **{name: _profile_table(name) for name in survey.PROFILE_TABLES},
    "tblA1": water_management,
    "tbl2_order": tbl2_order,
    "tbl2_from_data": tbl2_from_data,
    "workbook": workbook,
    "independence_tests": independence_tests,
    "acreage_interval": acreage_interval,
    "region_map": region_map,
    "probit_coefficients": probit_coefficients,
    "probit_effects": probit_effects,
    "probit_fits": probit_fits,
    "probit_signs": probit_signs,
    "tblA3": _probit_report("fs"),
    "tblA4": _probit_report("buf"),
    "tblA5": _probit_report("hab"),
    "tblA6": _probit_report("det"),
    "tblA7": _probit_report("con"),
    "model_bundle": model_bundle,
    "report_bundle": report_bundle,
}
