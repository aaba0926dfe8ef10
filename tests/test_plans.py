"""What the physical plans look like: one pass, pruned scans, no Python, no unchecked broadcast."""

import re

import pytest
from pyspark.sql import functions as F

from canvass.operators import inference, profile, relate
from canvass.plans import panel, survey
from canvass.plans.catalog import QUERIES, lines
from canvass.session import materialized
from tests.conftest import SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def stored(spark):
    with materialized(panel.derived_survey(spark, SMALL), "plans") as table:
        yield table


def test_profile_reads_rows_once_and_expands_groups_only(stored):
    text = plan(survey.profile_table(stored, panel.DICTIONARY, "tbl5"))
    tree = text.split("\n\n")[0]
    assert tree.count("Scan parquet") == 1
    order = re.findall(r"(Expand|HashAggregate|Exchange|Scan parquet)", tree)
    assert order == ["HashAggregate", "Exchange", "HashAggregate", "Expand",
                     "HashAggregate", "Exchange", "HashAggregate", "Scan parquet"]


def test_profile_reads_only_its_columns(stored):
    text = plan(survey.profile_table(stored, panel.DICTIONARY, "tbl5"))
    schema = re.search(r"ReadSchema: struct<(.*)>", text).group(1)
    assert sorted(c.split(":")[0] for c in schema.split(",")) == sorted(
        ["rev_cat", "org_abbr", "lscape_wild", "lscape_graze", *survey.HABITAT])


def test_first_table_reads_rows_once(stored):
    tree = plan(survey.farm_characteristics(stored, panel.DICTIONARY)).split("\n\n")[0]
    assert tree.count("Scan parquet") == 1


def test_tests_take_four_passes(stored):
    tree = plan(survey.independence_tests(survey.collapse_inputs(stored), panel.DICTIONARY)).split("\n\n")[0]
    assert tree.count("Scan parquet") == 4


def test_table_totals_share_one_shuffle(make):
    counts = make([("x", "y", "a", "0", 1)], "cut string, resp string, row string, col string, o bigint")
    tree = plan(inference.chi2_from_counts(counts, ["cut", "resp"])).split("\n\n")[0]
    assert tree.count("Exchange") == 1


def test_large_tables_spread_over_partitions(spark):
    """Many levels on both sides: margins are partitioned by level, never by the whole test."""
    df = spark.range(200_000).selectExpr("cast(id % 997 as string) as a", "cast(id % 499 as string) as b")
    test = inference.chi2_test(df, "a", "b")
    tree = test._jdf.queryExecution().toString()
    assert re.search(r"hashpartitioning\([^)]*row#\d+", tree) and re.search(r"hashpartitioning\([^)]*col#\d+", tree)
    got = test.first()
    assert got.df == 996 * 498
    # nearly even: far too regular for chance, so the tail is all of the distribution
    assert got.stat < 0.7 * got.df and got.pval == 1.0 and got.sig == ""
    tied = inference.chi2_test(df.selectExpr("a", "cast(int(a) % 97 as string) as c"), "a", "c").first()
    assert tied.df == 996 * 96 and tied.stat > 1e7 and tied.pval == 0.0 and tied.sig == "*"


def test_filters_reach_the_scan(spark):
    text = plan(inference.mean_interval(lines(spark, SMALL), "l_discount"))
    assert "PushedFilters: [IsNotNull(l_discount)]" in text
    assert "ReadSchema: struct<l_discount:double>" in text


def test_documents_are_profiled_without_their_text(spark):
    assert "text:string" not in plan(QUERIES["profile_flags_nullable"](spark, SMALL))


def test_panel_aggregates_stay_hashed_and_narrow(spark):
    tree = plan(panel.derived_survey(spark, SMALL)).split("\n\n")[0]
    assert "SortAggregate" not in tree and "ObjectHashAggregate" not in tree


@pytest.mark.parametrize("name", ["tbl1", "tbl2", "chi2_by_flag", "mean_interval", "derived_columns"])
def test_no_python_in_the_plan(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert not re.search(r"Python|Pandas|ArrowEval|MapInArrow", text)


def test_spark_chooses_the_join_by_size(spark):
    fact = spark.range(1000).withColumnRenamed("id", "k")
    small = relate.lookup(fact, "k", spark.range(100), "id")
    large = relate.lookup(fact, "k", spark.range(10_000_000), "id")
    assert "BroadcastHashJoin" in plan(small) and "BroadcastHashJoin" not in plan(large)
    assert small.count() == large.count() == 1000


@pytest.mark.parametrize("name", ["share_concentration", "derived_columns", "tbl2", "natural_join_map", "left_join_keep_unmatched"])
def test_building_a_plan_starts_no_job(spark, name):
    group = f"building {name}"
    spark.sparkContext.setJobGroup(group, name)
    try:
        df = QUERIES[name](spark, SMALL)
        df._jdf.queryExecution().executedPlan()
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_derivations_are_compiled(spark):
    """Every projection over the wide table is inside a code generation stage."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tree = QUERIES["derived_columns"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    projects = [line for line in tree.splitlines() if re.match(r"^[ +:-]*(\*\(\d+\) )?Project ", line)]
    assert projects and all("*(" in line for line in projects)


def test_results_do_not_depend_on_partitioning_or_join_choice(spark):
    key = lambda r: tuple(str(v) for v in r)
    before = sorted(QUERIES["tbl2"](spark, SMALL).collect(), key=key)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "3",
                "spark.sql.adaptive.enabled": "false", "spark.sql.files.maxPartitionBytes": "20000"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert sorted(QUERIES["tbl2"](spark, SMALL).collect(), key=key) == before
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_one_customer_with_a_third_of_all_lines(spark, tmp_path):
    """The hot customer and a hot order only show in their own totals."""
    from canvass.sources.tables import table

    lineitem = table(spark, SMALL, "lineitem")
    hot = lineitem.withColumn("l_orderkey", F.when(F.col("l_linenumber") % 3 == 0, F.lit(1)).otherwise(F.col("l_orderkey")))
    orders = table(spark, SMALL, "orders").withColumn(
        "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(7)).otherwise(F.col("o_custkey")).cast("bigint"))
    got = panel.customer_answers(orders, panel.order_answers(hot)).agg(
        F.sum("acres").alias("acres"), F.sum("cents").alias("cents"), F.count("*").alias("n")).first()
    want = lineitem.agg(F.sum("l_quantity").alias("q"), F.sum(F.round(F.col("l_extendedprice") * 100)).alias("c")).first()
    assert (got.acres, got.cents) == (int(want.q), int(want.c))
    assert got.n == orders.select("o_custkey").distinct().count()


def test_joint_grouping_equals_expansion_on_the_panel(stored, monkeypatch):
    key = lambda r: tuple(str(v) for v in r)
    joint = sorted(survey.profile_table(stored, panel.DICTIONARY, "tbl9").collect(), key=key)
    monkeypatch.setattr(profile, "JOINT_GROUP_LIMIT", 0)
    expanded = survey.profile_table(stored, panel.DICTIONARY, "tbl9")
    assert sorted(expanded.collect(), key=key) == joint
