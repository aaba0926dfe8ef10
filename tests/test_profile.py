import math
from itertools import product

import pytest
from pyspark.sql import functions as F

from canvass.domain import Domain
from canvass.operators import profile as P
from canvass.operators import relate, reshape
from tests.conftest import SMALL

A = P.Cut("a", "By a", Domain(("x", "y")))
B = P.Cut("b", "By b", Domain(("u", "v")))
ROWS = [("x", "u", 1), ("x", None, 0), ("y", "v", None), (None, "v", 1), ("x", "u", None)]


@pytest.fixture()
def frame(make):
    return make(ROWS, "a string, b string, f int")


def as_dict(df):
    return {(r["type"], r["level"]): r for r in df.collect()}


def test_profile_equals_plain_groups(frame):
    got = as_dict(P.profile(frame, [A, B], [P.Measure("m", "f"), P.Measure("s", "f", "sum")]))
    assert len(got) == 7
    assert got["All Farms", "All"].asDict() == {"type": "All Farms", "level": "All", "N": 5, "m": pytest.approx(2 / 3), "s": 2}
    for cut in (A, B):
        for r in frame.groupBy(cut.column).agg(F.count("*").alias("n"), F.avg("f").alias("m")).collect():
            row = got[cut.label, r[0]]
            assert (row.N, row.m) == (r.n, r.m)
            assert row.s == (0 if r.m is None else row.s)


def test_missing_level_is_a_group_and_counts_add_up(frame):
    rows = P.profile(frame, [A, B], P.means("f")).collect()
    for label in ("By a", "By b"):
        assert sum(r.N for r in rows if r["type"] == label) == 5
        assert [r for r in rows if r["type"] == label and r.level is None]


def test_both_strategies_agree(frame):
    open_cuts = [P.Cut("a", "By a"), P.Cut("b", "By b")]
    assert P.joint_groups_bounded([A, B]) and not P.joint_groups_bounded(open_cuts)
    measures = [*P.means("f"), P.Measure("s", "f", "sum")]
    key = lambda r: (r["type"], r.level or "")
    assert sorted(P.profile(frame, [A, B], measures).collect(), key=key) == sorted(
        P.profile(frame, open_cuts, measures).collect(), key=key)


def test_large_domains_are_not_joined():
    wide = Domain(tuple(map(str, range(500))))
    assert not P.joint_groups_bounded([P.Cut("a", "a", wide), P.Cut("b", "b", wide)])


def test_order(frame):
    got = P.in_order(P.profile(frame, [B, A], P.means("f"), with_order=True)).collect()
    assert [(r["type"], r.level) for r in got] == [
        ("All Farms", "All"), ("By b", "u"), ("By b", "v"), ("By b", None), ("By a", "x"), ("By a", "y"), ("By a", None)]


def test_sum_of_nothing_is_zero_mean_is_missing(make):
    empty = make([("x", None), ("x", None)], "a string, f int")
    row = P.global_summary(empty, [P.Measure("s", "f", "sum"), P.Measure("m", "f")]).first()
    assert (row.N, row.s, row.m) == (2, 0, None)
    rolled = as_dict(P.profile(empty, [A], [P.Measure("s", "f", "sum"), P.Measure("m", "f")]))
    assert (rolled["By a", "x"].s, rolled["By a", "x"].m) == (0, None)


def test_empty_table_has_no_blocks(make):
    none = make([], "a string, f int")
    assert P.profile(none, [A], P.means("f")).collect() == []
    assert P.global_summary(none, [P.Measure("s", "f", "sum")]).first().N == 0


def test_unknown_measure_kind():
    with pytest.raises(ValueError):
        P.Measure("m", "m", "median")


def test_frequency_tables(make):
    df = make([("a",), (None,), ("a",)], "k string")
    assert {tuple(r) for r in relate.group_frequency(df, "k").collect()} == {("a", 2), (None, 1)}
    assert {tuple(r) for r in relate.frequency_table(df, "k").collect()} == {("a", 2)}


def test_pivot_fill_keeps_undefined_means(make):
    df = make([("r", "a", None), ("r", "b", 2.0), ("s", None, 1.0)], "g string, k string, v double")
    got = {r.level: r for r in reshape.crosstab_means(df, "g", "k", ["a", "b"], "v", "T").collect()}
    assert math.isnan(got["r"]["a"]) and got["r"]["b"] == 2.0 and got["r"]["NA"] == 0.0
    assert got["s"]["a"] == 0.0 and got["s"]["NA"] == 1.0


def test_crosstab(make):
    df = make([("r", "a"), ("r", "a"), ("r", None), (None, "b")], "g string, k string")
    got = {r.level: tuple(r) for r in reshape.crosstab(df, "g", "k", ["a", "b"], "T").collect()}
    assert got == {"r": ("T", "r", 2, 0, 1, 0, 3), None: ("T", None, 0, 1, 0, 0, 1)}


def test_union_widens_and_fills(make):
    a, b = make([(1, "x")], "n int, t string"), make([(2.5,)], "n double")
    got = reshape.stack_by_name(a, None, b)
    assert got.schema["n"].dataType.simpleString() == "double"
    assert [tuple(r) for r in got.collect()] == [(1.0, "x"), (2.5, None)]


def test_transpose(make):
    df = make([("A", "1", 10, 20), ("B", None, 30, None)], "type string, level string, p int, q int")
    got = {r["var"]: r for r in reshape.transpose(df, ["p", "q"], ["A_1", "B_NA"]).collect()}
    assert (got["p"]["A_1"], got["p"]["B_NA"], got["q"]["A_1"], got["q"]["B_NA"]) == (10, 30, 20, None)


def test_select_first(make):
    assert reshape.select_first(make([(1, 2, 3)], "a int, b int, c int"), "c").columns == ["c", "a", "b"]


def test_joins(make):
    left = make([("a", 1), (None, 2), ("z", 3)], "k string, v int")
    right = make([("a", 10), (None, 20)], "m string, w int")
    plain = {r.v: r.w for r in relate.lookup(left, "k", right, "m").collect()}
    assert plain == {1: 10, 2: None, 3: None}
    missing = {r.v: r.w for r in relate.lookup(left, "k", right, "m", match_missing=True).collect()}
    assert missing == {1: 10, 2: 20, 3: None}
    merged = {r.k: (r.v, r.w) for r in relate.outer_merge(
        left.where("k is not null"), make([("a", 10), ("q", 5)], "m string, w int"), "k", "m").collect()}
    assert merged == {"a": (1, 10), "z": (3, None), "q": (None, 5)}
    named = relate.natural_left_join(left, right.withColumnRenamed("m", "k")).where("k = 'a'").first()
    assert named.w == 10
    with pytest.raises(ValueError):
        relate.natural_left_join(left, right)


def test_pairs():
    assert relate.pairs(["a", "b"], ["x", "y"]) == list(product("ab", "xy"))


def test_hot_group(spark):
    """A third of all rows in one level: same totals, one aggregation over the rows."""
    df = spark.range(90_000).selectExpr(
        "case when id % 3 = 0 then 'x' else cast(id % 50 as string) end as a", "cast(id % 2 as int) as f")
    got = as_dict(P.profile(df, [P.Cut("a", "By a")], P.means("f")))
    assert got["By a", "x"].N == 30_000 and sum(r.N for (t, _), r in got.items() if t == "By a") == 90_000


def test_flagship_on_small_tables(spark):
    from canvass.plans.catalog import QUERIES

    got = QUERIES["profile_segments"](spark, SMALL)
    assert got.columns == ["type", "level", "N", "balance_cents", "spend_cents", "in_credit", "wealthy", "orders"]
    assert got.count() > 10


def test_a_false_domain_bounds_the_groups_and_loses_nothing(spark):
    """Five thousand values that a domain does not list meet in one level."""
    df = spark.range(20_000).selectExpr("if(id % 2 = 0, 'a', cast(id % 10000 as string)) as k", "if(id % 5 = 0, null, 'x') as g", "cast(id % 4 as int) as f")
    cuts = [P.Cut("k", "K", Domain(("a", "b"))), P.Cut("g", "G", Domain(("x",)))]
    got = {(r.type, r.level): (r.N, r.f, r.level_ord) for r in P.profile(df, cuts, P.means("f"), with_order=True).collect()}
    assert got["K", "a"] == (10_000, 1.0, 1) and got["K", "other"] == (10_000, 2.0, 3)
    assert {k for k in got if k[0] == "K"} == {("K", "a"), ("K", "other")} and got["G", None][0] == 4000
    joint = P.partials(P.enforced(df, cuts), ["k", "g"], ["f"])
    assert joint.count() == 4


def test_the_level_for_the_rest_has_a_name_of_its_own(make):
    df = make([("other", 1), ("other", 1), ("strange", 0), (None, 1)], "k string, f int")
    got = {r.level: r.N for r in P.profile(df, [P.Cut("k", "K", Domain(("other",)))], P.means("f")).collect() if r.type == "K"}
    assert got == {"other": 2, "other_": 1, None: 1}


def test_tests_under_a_false_domain(make):
    from canvass.operators.inference import chi2_flags

    rows = [(f"s{k}" if k % 3 else "a", int(k % 3 == 0 or k % 7 == 0)) for k in range(900)]
    got = chi2_flags(make(rows, "k string, y int"), [P.Cut("k", "K", Domain(("a",)))], ["y"], with_log=True).first()
    assert got.df == 1 and got.pval < 1e-100 and math.log10(got.pval) == pytest.approx(got.log_p)
