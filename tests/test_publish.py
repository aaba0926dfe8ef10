import os

import pytest
from pyspark.sql import functions as F

from canvass.plans import panel, survey
from canvass.plans.publish import publish
from canvass.sources.conform import conform
from canvass.sources.tables import table
from tests.conftest import MEDIUM


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("results"))
    shapes = table(spark, MEDIUM, "region").select(
        F.col("r_name").alias("name"), F.lit("POLYGON EMPTY").alias("geometry_wkt"))
    paths = publish(conform(panel.raw_survey(spark, MEDIUM)), panel.DICTIONARY, panel.regions(spark, MEDIUM),
                    panel.state_names(spark, MEDIUM), shapes, out)
    return out, paths


def test_everything_is_written(results):
    out, paths = results
    assert all(os.path.isdir(p) for p in paths)
    assert sorted(os.listdir(f"{out}/tables")) == sorted(
        ["tbl1", "tbl2", "tbl3", "tbl4", "tbl5", "tbl6", "tbl7", "tbl8", "tbl9", "tblA1", "tblA2"])
    assert len([n for n in os.listdir(f"{out}/workbook") if n.startswith("table=")]) == 11
    assert sorted(os.listdir(f"{out}/probit_tables")) == ["tblA3", "tblA4", "tblA5", "tblA6", "tblA7"]


def test_shapes(spark, results):
    out, _ = results
    read = lambda name: spark.read.csv(f"{out}/{name}", header=True, escape='"')
    signs, tests = read("sig_tbl"), read("chi_tbl")
    assert signs.columns == ["depvar", *[t.name for t in survey.probit_terms()]] and signs.count() == 35
    assert tests.columns == ["cut", "resp", "stat", "df", "pval", "sig"] and tests.count() == 237
    assert [(r.cut, r.resp) for r in tests.collect()][5:8] == [
        ("rev_cat", "fs_loss"), ("org_abbr", "emp_train"), ("org_abbr", "fs_plan")]
    assert read("tables/tbl2").columns[:3] == ["type", "level", "N"]
    assert read("fv_interval").columns == ["n", "mu", "sigma", "se", "ciMult", "ci", "upper", "lower"]
    assert read("region_map").count() == 5 and read("region_counts").count() == 6
    assert spark.read.parquet(f"{out}/probit/coefficients").count() == 35 * 8
    assert [r.term for r in read("probit_tables/tblA4").collect()][:2] == ["Intercept", "Some Organic (0/1)"]


def test_csv_keeps_block_order(spark, results):
    out, _ = results
    rows = spark.read.csv(f"{out}/tables/tbl3", header=True).collect()
    assert list(dict.fromkeys(r["type"] for r in rows)) == [
        "All Farms", "Revenue Category", "Organic Status", "Landscape Wildlife Habitat", "Landscape Grazing"]
    assert [r.level for r in rows if r["type"] == "Landscape Grazing"] == ["Most", "Some", "None", "NA"]
