"""One case per missing-value, binning and marking rule."""

import pytest
from pyspark.sql import functions as F

from canvass.domain import Domain, bin_by, pick, recode, sorted_levels, sorted_position
from canvass.functions import flags
from canvass.plans import survey
from canvass.sources.conform import conform


def test_blank_is_no_and_missing_leaves_the_mean(make):
    df = conform(make([("",), ("NA",), ("Yes",), (None,)], "a string"), numeric=())
    got = df.select("a", flags.equals("a", "Yes").cast("int").alias("y")).collect()
    assert [(r.a, r.y) for r in got] == [("", 0), (None, None), ("Yes", 1), ("", 0)]
    assert df.select(F.avg(flags.equals("a", "Yes").cast("int"))).first()[0] == pytest.approx(1 / 3)


def test_answered_never_missing(make, values):
    df = make([("",), (None,), ("x",)], "a string")
    assert values(df.select(flags.answered("a").cast("int"))) == [0, 0, 1]


def test_any_answered(make, values):
    df = make([("", "x"), (None, ""), (None, None), ("x", "x")], "a string, b string")
    assert values(df.select(flags.any_answered("a", "b"))) == [True, False, False, True]


def test_any_positive(make, values):
    df = make([(None, 1.0), (0.0, None), (None, None), (-1.0, 0.5)], "a double, b double")
    assert values(df.select(flags.any_positive("a", "b"))) == [True, False, False, True]


def test_text_amount(make, values):
    df = make([("12",), ("abc",), ("0",), (None,), ("-3",), ("",)], "a string")
    assert values(df.select(flags.text_positive("a").cast("int"))) == [1, 0, 0, 0, 0, 0]


def test_bin_edges_go_up(make, values):
    df = make([(24999.99,), (25000.0,), (250000.0,), (5e6,), (None,)], "a double")
    got = values(df.select(bin_by(F.col("a"), survey.REVENUE_EDGES, survey.REVENUE.levels)))
    assert got == ["<25K", "25-250K", "250-500K", "5M+", None]


def test_bin_needs_matching_labels():
    with pytest.raises(ValueError):
        bin_by(F.lit(1), (1, 2), ("a", "b"))


def test_zero_sentinel(make, values):
    assert values(make([(0.0,), (1.0,), (None,)], "a double").select(flags.zero_to_null("a"))) == [None, 1.0, None]


def test_out_of_domain(make):
    domain = Domain(("b", "a"))
    got = make([("a",), ("z",), (None,), ("b",)], "v string").select(
        domain.restrict(F.col("v")).alias("v"), domain.ordinal(F.col("v")).alias("o")).collect()
    assert [(r.v, r.o) for r in got] == [("a", 2), (None, None), (None, None), ("b", 1)]


def test_collapse(make, values):
    df = make([("500K-1M",), ("<25K",), ("250-500K",), ("?",)], "v string")
    assert values(df.select(recode(F.col("v"), survey.REVENUE_GROUPS))) == [">500K", "<25K", "25-500K", None]


def test_levels_by_sorted_position(make):
    df = make([(v,) for v in ["c", "", "a", "b", "a", None]], "v string")
    assert sorted_levels(df, {"v": 3}) == {"v": ["", "a", "b"]}
    assert sorted_position(df, "v", {2: "first", 4: "last", 9: "absent"}) == {"a": "first", "c": "last"}
    assert pick(["", "x"], {2: "one"}) == {"x": "one"}


def test_levels_of_several_columns(make):
    df = make([("b", "y"), ("a", None), ("c", "x")], "p string, q string")
    assert sorted_levels(df, {"p": 2, "q": 5}) == {"p": ["a", "b"], "q": ["x", "y"]}


def test_relevel_and_dummies(make):
    domain = Domain(("Some", "None")).relevel("None")
    assert domain.levels == ("None", "Some")
    dummies = domain.dummies("v")
    got = make([("Some",), ("None",), (None,)], "v string").select(F.expr(dummies["Some"]).alias("d")).collect()
    assert list(dummies) == ["Some"] and [r.d for r in got] == [1.0, 0.0, None]
    with pytest.raises(ValueError):
        domain.relevel("x")


def test_row_extremes_propagate_missing(make):
    got = make([(1, None), (0, 1), (1, 1)], "a int, b int").select(
        flags.row_max("a", "b").alias("hi"), flags.row_min("a", "b").alias("lo"), flags.row_sum("a", "b").alias("s"))
    assert [tuple(r) for r in got.collect()] == [(None, None, None), (1, 0, 1), (1, 1, 2)]


def test_share_of_nothing_is_missing(make, values):
    df = make([(1.0, 0.0), (0.0, 0.0), (1.0, 4.0), (None, 4.0)], "a double, b double")
    assert values(df.select(flags.share("a", "b"))) == [None, None, 0.25, None]


def test_concentration(make, values):
    df = make([(50.0, 50.0), (100.0, None)], "a double, b double")
    assert values(df.select(flags.concentration("a", "b"))) == [5000.0, None]


def test_booleans_found_by_type(make):
    df = make([(1,), (None,)], "a int").withColumn("b", F.col("a") == 1).withColumn("c.d", F.lit(True))
    got = flags.booleans_to_int(df)
    assert [f.dataType.simpleString() for f in got.schema] == ["int", "int", "int"]
    assert [tuple(r) for r in got.collect()] == [(1, 1, 1), (None, None, 1)]


def test_marks(make):
    df = make([(0.05, -1.0), (0.0501, 1.0), (0.01, 2.0), (None, 1.0)], "p double, b double")
    got = df.select(flags.sign_mark(F.col("b"), F.col("p")).alias("s"), flags.significance_mark(F.col("p")).alias("m"))
    assert [tuple(r) for r in got.collect()] == [("(-)", "*"), (" ", ""), ("(+)", "*"), (None, None)]


def test_stars_are_strict(make, values):
    df = make([(0.009,), (0.01,), (0.049,), (0.1,)], "p double")
    assert values(df.select(flags.stars(F.col("p")))) == ["***", "**", "**", ""]


def test_quoting():
    assert flags.quoted("it's") == "'it\\'s'"


def test_collated_levels_mix_cases_and_accents(make):
    words = ["Zebra", "apple", "Éclair", "eclair", "éclair", "Apple", "zebra", "Eclair", "", "10", "e"]
    df = make([(w, w.lower()) for w in words * 3] + [(None, None)], "v string, w string")
    got = sorted_levels(df, {"v": 20, "w": 4}, "UNICODE")
    assert got["v"] == ["", "10", "apple", "Apple", "e", "eclair", "Eclair", "éclair", "Éclair", "zebra", "Zebra"]
    assert got["w"] == ["", "10", "apple", "e"]
    assert sorted_levels(df, {"v": 4})["v"] == ["", "10", "Apple", "Eclair"]
    assert sorted_position(df, "v", {3: "first", 5: "third"}, "UNICODE") == {"apple": "first", "e": "third"}


def test_levels_that_a_collation_calls_equal_all_count(make):
    df = make([("b",), ("B",), ("a",), ("A",), ("A",)], "v string")
    assert sorted_levels(df, {"v": 9}, "UTF8_LCASE") == {"v": ["A", "a", "B", "b"]}


def test_levels_need_no_python_worker(spark, monkeypatch):
    from pyspark.sql import DataFrame

    monkeypatch.setattr(DataFrame, "mapInArrow", None)
    assert sorted_levels(spark.range(50).selectExpr("cast(id % 7 as string) as v"), {"v": 3}) == {"v": ["0", "1", "2"]}
