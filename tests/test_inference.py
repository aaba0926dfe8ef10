import pytest
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import functions as F

from canvass.domain import Domain
from canvass.operators import inference as I
from canvass.operators.profile import Cut
from canvass.plans.catalog import labelled_documents, lines
from tests.conftest import MEDIUM, SMALL


def cells(make, table):
    rows = [("x", "y", str(i), str(j), o) for i, line in enumerate(table) for j, o in enumerate(line)]
    return make(rows, "cut string, resp string, row string, col string, o bigint")


def run(make, table):
    return I.chi2_from_counts(cells(make, table), ["cut", "resp"]).first()


def test_yates_for_two_by_two(make):
    got = run(make, [[10, 20], [30, 40]])
    assert got.stat == pytest.approx(0.4464286, abs=1e-7) and got.df == 1 and got.sig == ""


def test_yates_never_overshoots(make):
    """A deviation below one half is corrected to zero, not past it."""
    assert run(make, [[10, 10], [10, 10]]).stat == 0.0
    assert run(make, [[5, 6], [6, 7]]).stat == 0.0


def test_no_yates_beyond_two_by_two(make):
    got = run(make, [[10, 20], [30, 40], [20, 10]])
    assert got.stat == pytest.approx(7.3696145, abs=1e-7) and got.df == 2
    import math

    assert got.pval == pytest.approx(math.exp(-got.stat / 2)) and got.sig == "*"


def test_empty_levels_do_not_count(make):
    assert run(make, [[10, 20], [30, 40], [0, 0]]).df == 1
    assert run(make, [[10, 20, 0], [30, 40, 0]]).stat == pytest.approx(0.4464286, abs=1e-7)


def test_two_by_two_with_an_empty_cell(make):
    """n=60, every expected count 15 apart by margins 20/40 and 30/30."""
    got = run(make, [[0, 20], [30, 10]])
    expected = [[10, 10], [20, 20]]
    stat = sum((abs(o - e) - 0.5) ** 2 / e for row, line in zip([[0, 20], [30, 10]], expected) for o, e in zip(row, line))
    assert got.stat == pytest.approx(stat)


def test_sparse_cells_may_be_absent(make):
    full = run(make, [[0, 20, 3], [30, 10, 0], [1, 2, 3]])
    sparse = I.chi2_from_counts(
        cells(make, [[0, 20, 3], [30, 10, 0], [1, 2, 3]]).where("o > 0"), ["cut", "resp"]).first()
    assert sparse.stat == pytest.approx(full.stat) and sparse.df == full.df == 4
    o = [[0, 20, 3], [30, 10, 0], [1, 2, 3]]
    n, r, c = 69, [23, 40, 6], [31, 32, 6]
    assert full.stat == pytest.approx(sum(
        (o[i][j] - r[i] * c[j] / n) ** 2 / (r[i] * c[j] / n) for i in range(3) for j in range(3)))


def test_too_few_levels_give_missing(make):
    got = run(make, [[10, 20]])
    assert (got.stat, got.df, got.pval, got.sig) == (None, None, None, None)


def test_missing_pairs_leave_one_test_only(make):
    rows = [("a", 1, None), ("a", 0, 1), ("b", 1, 0), ("b", 1, 1), (None, 1, 1), ("a", 1, 0)]
    df = make(rows, "k string, p int, q int")
    got = {(r.resp, r.row, r.col): r.o for r in I.flag_counts(df, [Cut("k", "K", Domain(("a", "b")))], ["p", "q"]).collect()}
    assert got == {("p", "a", "0"): 1, ("p", "a", "1"): 2, ("p", "b", "0"): 0, ("p", "b", "1"): 2,
                   ("q", "a", "0"): 1, ("q", "a", "1"): 1, ("q", "b", "0"): 1, ("q", "b", "1"): 1}


def ml_test(df, x, y):
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    indexed = StringIndexer(inputCol=x, outputCol="xi").fit(known).transform(known)
    indexed = StringIndexer(inputCol=y, outputCol="yi").fit(indexed.withColumn(y, F.col(y).cast("string"))).transform(indexed)
    features = VectorAssembler(inputCols=["xi"], outputCol="v").transform(indexed)
    return ChiSquareTest.test(features, "v", "yi").first()


@pytest.mark.parametrize("x,y", [("l_returnflag", "discounted"), ("l_returnflag", "l_linestatus")])
def test_against_ml(spark, x, y):
    df = lines(spark, MEDIUM)
    ours, ml = I.chi2_test(df, x, y).first(), ml_test(df, x, y)
    assert ours.stat == pytest.approx(ml.statistics[0]) and ours.df == ml.degreesOfFreedom[0]
    assert ours.pval == pytest.approx(ml.pValues[0])


def test_batch_equals_single_tests(spark):
    df = labelled_documents(spark, SMALL)
    batch = {r.cut: r for r in I.chi2_flags(df, [Cut("lang", "L"), Cut("length", "N")], ["quality"]).collect()}
    for cut in ("lang", "length"):
        single = I.chi2_test(df, cut, "quality").first()
        assert batch[cut].stat == pytest.approx(single.stat) and batch[cut].df == single.df


def test_interval(make):
    df = make([(1.0,), (2.0,), (4.0,), (None,)], "v double")
    got = I.mean_interval(df, "v").first()
    assert got.n == 3 and got.mu == pytest.approx(7 / 3) and got.sigma == pytest.approx(1.5275252)
    assert got.ciMult == pytest.approx(4.3026527) and got.ci == pytest.approx(got.sigma / 3**0.5 * got.ciMult)
    assert got.upper - got.mu == pytest.approx(got.mu - got.lower)


def test_interval_of_one_value_is_missing(make):
    got = I.mean_interval(make([(1.0,)], "v double"), "v").first()
    assert (got.n, got.mu, got.sigma, got.ci) == (1, 1.0, None, None)
