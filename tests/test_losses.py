"""Inputs that used to lose rows, mix up columns or change a result silently."""

import pytest
from pyspark.sql import functions as F

from canvass.domain import Domain, sorted_levels
from canvass.operators import probit, reshape
from canvass.sources.conform import read_region_map, read_survey

ODD = [("r", "x"), ("r", "y"), ("r", "z"), ("r", None), ("r", "NA"), ("r", "NA")]


def test_crosstab_keeps_unlisted_missing_and_odd_spellings(make):
    row = reshape.crosstab(make(ODD, "g string, k string"), "g", "k", ["x", "y"], "T").first()
    assert row.asDict() == {"type": "T", "level": "r", "x": 1, "y": 1, "NA": 1, "other": 3, "all": 6}
    with pytest.raises(ValueError):
        reshape.crosstab(make(ODD, "g string, k string"), "g", "k", ["x", "NA"], "T")


@pytest.mark.parametrize("values", [["x", "y", "NA"], ["x", "y", "z"]])
def test_spread_refuses_values_without_a_column(make, values):
    df = make([(g, k, 1) for g, k in ODD], "g string, k string, n int")
    with pytest.raises(Exception, match="without a column"):
        reshape.spread(df, ["g"], "k", values, "n").collect()


def test_spread_pairs_and_transpose_refuse_unlisted_pairs(make):
    df = make([("a", "b", 1), ("a", "c", 2), ("a", None, 3)], "type string, level string, m int")
    got = reshape.transpose(df, ["m"], ["a_b", "a_c", "a_NA"]).first()
    assert (got.a_b, got.a_c, got.a_NA) == (1, 2, 3)
    with pytest.raises(Exception, match="without a column"):
        reshape.transpose(df, ["m"], ["a_b", "a_NA"]).collect()
    with pytest.raises(Exception, match="spelled NA"):
        reshape.transpose(df.fillna("NA", ["level"]), ["m"], ["a_b", "a_c", "a_NA"]).collect()


def test_two_rows_of_a_cell_are_an_error_or_merged(make):
    rows = make([("a", "x", 1), ("a", "x", 2), ("a", "y", 3), ("b", "x", None), ("b", "x", None)], "i string, k string, v int")
    with pytest.raises(Exception, match="several rows"):
        reshape.spread(rows.filter("i = 'a'"), ["i"], "k", ["x", "y"], "v").collect()
    with pytest.raises(Exception, match="several rows"):
        reshape.spread(rows.filter("i = 'b'"), ["i"], "k", ["x", "y"], "v").collect()
    for merge, want in ((F.sum, 3), (F.min, 1), (F.count, 2)):
        got = {r.i: (r.x, r.y) for r in reshape.spread(rows, ["i"], "k", ["x", "y"], "v", merge=merge).collect()}
        assert got["a"] == (want, 1 if merge is F.count else 3) and got["b"][1] is None
    assert reshape.spread(rows.filter("k = 'y'"), ["i"], "k", ["x", "y"], "v").first().asDict() == {"i": "a", "x": None, "y": 3}


def test_pivots_of_duplicates_refuse(make):
    with pytest.raises(Exception, match="several rows"):
        reshape.transpose(make([("t", "l", 1.0), ("t", "l", 2.0)], "type string, level string, m double"), ["m"], ["t_l"]).collect()


def test_spread_leaves_columns_of_its_own_names_alone(make):
    rows = make([(1, "x", 5, 7, 9)], "slot int, k string, v int, cell int, `0` int")
    assert reshape.spread(rows, ["slot", "cell", "0"], "k", ["x"], "v").first().asDict() == {"slot": 1, "cell": 7, "0": 9, "x": 5}


def test_values_outside_the_domain_leave_the_fit(make):
    terms = probit.factor_terms("lang", Domain(("de", "en", "fr")))
    rows = probit.design_matrix(make([("de",), ("en",), ("it",), (None,)], "lang string"), terms).collect()
    assert [tuple(r) for r in rows] == [(0.0, 0.0), (1.0, 0.0), (None, None), (None, None)]


def test_only_true_dependence_is_aliased(spark):
    base = spark.range(4000).selectExpr("id", "sin(id * 12.9898) as x", "cast(sin(id * 78.233) + sin(id * 12.9898) > 0 as int) as y")
    terms = [probit.numeric_term("far", "x + 1e7"), probit.numeric_term("twice", "2 * x + 3")]
    got = {r.term: r for r in probit.fit_probits(base, terms, {"f": ["y"]}).coefficients.collect()}
    near = {r.term: r for r in probit.fit_probits(base, [probit.numeric_term("x")], {"f": ["y"]}).coefficients.collect()}
    assert got["far"].status == "ok" and got["twice"].status == "aliased"
    assert got["far"].estimate == pytest.approx(near["x"].estimate, rel=1e-5)
    assert got["far"].std_error == pytest.approx(near["x"].std_error, rel=1e-5)


def test_header_decides_the_columns(spark, tmp_path):
    path = str(tmp_path / "map.csv")
    with open(path, "w") as f:
        f.write('"state.abb","region_epa"\n"AL","South, East"\n')
    assert [tuple(r) for r in read_region_map(spark, path).collect()] == [("South, East", "AL")]
    swapped = str(tmp_path / "survey.csv")
    with open(swapped, "w") as f:
        f.write("b,a\nB1,A1\n")
    assert read_survey(spark, swapped, ["b", "a"]).first().asDict() == {"b": "B1", "a": "A1"}
    with pytest.raises(Exception, match="header"):
        read_survey(spark, swapped, ["a", "b"]).collect()


def test_levels_are_reduced_in_the_tasks(spark):
    df = spark.range(10_000).selectExpr("cast(id as string) as free", "if(id % 3 = 0, null, cast(id % 2 as string)) as flag").repartition(6)
    assert sorted_levels(df, {"free": 3, "flag": 5}) == {"free": ["0", "1", "10"], "flag": ["0", "1"]}
