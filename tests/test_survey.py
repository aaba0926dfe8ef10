"""The analysis on a small hand-made survey with real state names and dotted headers."""

import pytest
from pyspark.sql import functions as F

from canvass.plans import survey
from canvass.session import local_table
from canvass.sources import maps, schema
from canvass.sources.conform import conform

LEVELS = {
    "org_v_conv": ["", "Both", "Certified", "Conventional", "Unsure"],
    "border_noncrop": ["", "All", "None at all", "Not sure", "Part"],
    "border_livestock": ["", "All", "None at all", "Not sure", "Part"],
    "water_freq_test": ["", "1 Monthly", "2 ?", "3 Never", "4 Weekly", "5 Yearly", "6 ?", "7 Rarely"],
    "water_treat": ["", "1 Never", "2 ?", "3 Always", "4 Sometimes"],
}


def respondents():
    base = {c: "" for c in schema.TEXT} | {c: "0" for c in schema.NUMERIC} | {"acre_sum": "100"}
    a = base | {
        "state": "Ohio", "rev_est": "24999.99", "exp_est": "0", "org_v_conv": "Both", "border_noncrop": "All",
        "border_livestock": "None at all", "water_freq_test": "4 Weekly", "water_treat": "3 Always",
        "acre_infield_veg_herb": "50", "acre_infield_fruit": "25", "acre_grass": "25", "sale_directcons": "75",
        "sale_wholesale": "25", "train_attend": "Yes", "fsplan": "No", "risk_birds": "High Risk",
        "fspract_sanitize": "Used", "water_stand": "Used", "loss_acre_water": "2", "loss_insurance_payout": "500",
        "concern_wl_buyer": "Yes", "concern_nc_none": "x", "other_pna": "Source used"}
    b = base | {
        "state": "District of Columbia", "rev_est": "500000", "exp_est": "10", "org_v_conv": "Conventional",
        "border_noncrop": "Part", "border_livestock": "NA", "water_freq_test": "7 Rarely", "water_treat": "2 ?",
        "acre_other": "NA", "sale_directcons": "24.9", "train_attend": "NA", "fsplan": "Yes",
        "water_notouch_flow": "Used", "loss_other_payout": "none", "concern_wl_none": "x", "concern_nc_none": "x",
        "other_pna": "NA"}
    c = base | {
        "state": "Atlantis", "rev_est": "0", "exp_est": "NA", "org_v_conv": "Unsure", "border_noncrop": "Not sure",
        "acre_sum": "0", "sale_directcons": "NA", "train_attend": "", "water_freq_test": "3 Never", "other_pna": "x"}
    d = base | {"state": "NA", "rev_est": "NA", "org_v_conv": "Certified", "train_attend": "Yes",
                "border_noncrop": "None at all", "border_livestock": "Part", "water_freq_test": "1 Monthly",
                "water_treat": "4 Sometimes", "acre_infield_veg_herb": "24"}
    return [a, b, c, d]


@pytest.fixture(scope="module")
def raw(spark):
    rows = [(i, *[r[c] for c in schema.COLUMNS]) for i, r in enumerate(respondents())]
    dotted = ", ".join(f"`{c.replace('_', '.')}` string" for c in schema.COLUMNS)
    return conform(local_table(spark, rows, f"id int, {dotted}"))


@pytest.fixture(scope="module")
def dictionary(raw):
    return survey.Dictionary.from_levels(LEVELS)


@pytest.fixture(scope="module")
def derived(spark, raw, dictionary):
    return survey.derive(
        survey.attach_region(raw, maps.region_map(spark), maps.state_names(spark)), dictionary)


@pytest.fixture(scope="module")
def rows(derived):
    return {r.id: r for r in survey.water_classes(survey.collapse_inputs(derived)).collect()}


def column(rows, name):
    return [rows[i][name] for i in range(4)]


EXPECTED = {
    "region_epa": ["Upper Midwest", "Mid-Atlantic", None, None],
    "rev_est": [24999.99, 500000.0, None, None],
    "exp_est": [None, 10.0, None, None],
    "rev_cat": ["<25K", "500K-1M", None, None],
    "rev_cat_abbr": ["<25K", ">500K", None, None],
    "org": ["Both", "Conventional", None, "Organic"],
    "org_abbr": ["Some", "None", None, "Some"],
    "lscape_wild": ["Most", "Some", None, "None"],
    "lscape_graze": ["None", None, None, "Some"],
    "test_freq": ["freq", "occ", "never", "freq"],
    "treat_freq": ["always", None, None, "sometimes"],
    "fvacreage_pct": [0.75, 0.0, None, 0.24],
    "fvacreage_quartile": ["[75%,100%)", "[0%,25%)", None, "[0%,25%)"],
    "directsales_quartile": ["[75%,100%)", "[0%,25%)", None, "[0%,25%)"],
    "acre_hhi": [50.0**2 + 25.0**2 + 25.0**2, None, None, 24.0**2],
    "dist_hhi": [75.0**2 + 25.0**2, 24.9**2, None, 0.0],
    "emp_train": [1, None, 0, 1],
    "fs_plan": [0, 1, 0, 0],
    "hr_bird": [1, 0, 0, 0],
    "prac_sani": [1, 0, 0, 0],
    "acre_rej": [1, 0, 0, 0],
    "fs_ins_payout": [1, 0, 0, 0],
    "fs_oth_comp": [0, 0, 0, 0],
    "water_any_flow": [0, 1, 0, 0],
    "water_touch_stand": [1, 0, 0, 0],
    "buyer": [1, 0, 0, 0],
    "advisor": [0, 0, 0, 0],
    "noone": [0, 1, 0, 0],
    "surface": [1, 0, 0, 0],
    "surface_nt": [0, 1, 0, 0],
    "nosurface_any": [0, 0, 1, 1],
    "nosurface": [0, 0, 1, 1],
}


@pytest.mark.parametrize("name", EXPECTED)
def test_derived(rows, name):
    assert column(rows, name) == (pytest.approx(EXPECTED[name]) if "hhi" in name else EXPECTED[name])


def test_number_of_derived_columns(raw, derived):
    from canvass.plans.catalog import DERIVED_COLUMNS

    assert len(DERIVED_COLUMNS) == len(set(DERIVED_COLUMNS)) == 112
    added = set(survey.collapse_inputs(derived).columns) - set(raw.columns)
    assert added == {*DERIVED_COLUMNS, "region_epa", "state_abb"}


def test_levels_found_in_data(raw):
    found = survey.Dictionary.from_data(raw)
    # No respondent left the cell blank, so the sorted levels start one position later.
    assert found.recodes["org_v_conv"] == {"Certified": "Both", "Conventional": "Organic", "Unsure": "Conventional"}
    assert found.recodes["water_treat"] == {"2 ?": "never", "4 Sometimes": "always"}


def test_first_table(derived, dictionary):
    got = {(r["type"], r.level): r for r in survey.farm_characteristics(derived, dictionary).collect()}
    assert got["All Farms", "All"]["<25K"] == 1 and got["All Farms", "All"]["NA"] == 2
    assert got["All Farms", "All"]["all"] == got["All Farms", "All"]["row_sum"] == 4
    share = got["Prop. FV Acreage", "All"]
    assert share["5M+"] == 0 and share["<25K"] == 0.75 and share["all"] == pytest.approx(0.33)
    assert got["Organic Status", None]["NA"] == 1 and got["Surface Water", "All"]["all"] == 1
    assert got["Other Water", "All"]["NA"] == 2


def test_table_order(derived, dictionary):
    tables = survey.all_tables(derived, dictionary)
    assert list(tables) == ["tbl1", "tbl2", "tbl3", "tbl4", "tbl5", "tbl6", "tbl7", "tbl8", "tbl9", "tblA1", "tblA2"]
    blocks = list(dict.fromkeys(r["type"] for r in tables["tbl2"].collect()))
    assert blocks == ["All Farms", "Revenue Category", "Organic Status", "Geographic Region",
                      "FV Acreage Proportion", "Direct Sales Proportion"]
    first = list(dict.fromkeys(r["type"] for r in tables["tbl1"].collect()))
    assert first == ["All Farms", "Organic Status", "Region", "Prop. FV Acreage", "Avg. Acreage HHI",
                     "Avg. Distribution HHI", "Landscape Wildlife Habitat", "Landscape Grazing Land",
                     "Surface Water", "Other Water"]


def test_profile_means(derived, dictionary):
    got = {(r["type"], r.level): r for r in survey.profile_table(derived, dictionary, "tbl2").collect()}
    assert got["All Farms", "All"].emp_train == pytest.approx(2 / 3)
    assert got["Revenue Category", "500K-1M"].emp_train is None
    assert "none" in survey.profile_table(derived, dictionary, "tbl7").columns


def test_water_table(derived, dictionary):
    got = {r["var"]: r for r in survey.water_management(derived, dictionary).collect()}
    assert got["surface"]["All Farms_All"] == 1 and got["surface"]["Testing Frequency_freq"] == 1
    assert got["nosurface"]["Treatment Frequency_NA"] == 1 and got["surface"]["Treatment Frequency_never"] is None


def test_number_of_tests_and_models(derived, dictionary):
    tests = survey.independence_tests(survey.collapse_inputs(derived), dictionary)
    assert sum(len(c) * len(r) for c, r in survey.CHI2_FAMILIES) == 237
    assert tests.columns == ["cut", "resp", "stat", "df", "pval", "sig"]
    assert sum(map(len, survey.PROBIT_FAMILIES.values())) == 35
    assert [t.name for t in survey.probit_terms()] == list(survey.COEFFICIENT_LABELS)[1:]


def test_model_rows_need_every_regressor_and_the_region(derived):
    assert [r.id for r in survey.probit_rows(derived).collect()] == [0, 1]
    assert survey.probit_rows(derived).first().fvacreage_pct == 75.0


def test_map_data(make, derived):
    shapes = make([("Upper Midwest", "P1"), ("Southeast", "P2")], "name string, geometry_wkt string")
    got = {r.name: (r.geometry_wkt, r.freq, r.sqrt_freq) for r in survey.region_map_data(shapes, derived).collect()}
    assert got == {"Upper Midwest": ("P1", 1, 1.0), "Southeast": ("P2", None, None), "Mid-Atlantic": (None, 1, 1.0)}


def test_checks(derived):
    assert survey.farm_checks(derived).select(F.col("other_pna_used")).first()[0] == 1
