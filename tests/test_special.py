import decimal
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from canvass.functions import special


@settings(max_examples=200, deadline=None)
@given(st.floats(-10, 25))
def test_erfc_array(x):
    assert special.erfc_array(np.array([x]))[0] == pytest.approx(math.erfc(x), rel=1e-12, abs=1e-300)


def test_erfc_column_matches_array(make, values):
    xs = [-9.0, -1.5, -0.3, 0.0, 0.2, 0.46875, 0.5, 2.0, 4.0, 4.5, 12.0, None]
    got = values(make([(x,) for x in xs], "x double").select(special.erfc(F.col("x"))))
    assert got[-1] is None
    assert got[:-1] == pytest.approx([math.erfc(x) for x in xs[:-1]], rel=1e-12)


@pytest.mark.parametrize("df,critical", [
    (1, 3.841459), (2, 5.991465), (3, 7.814728), (4, 9.487729), (5, 11.070498), (6, 12.591587), (35, 49.801850)])
def test_chi2_tail_at_critical_values(make, df, critical):
    row = make([(critical, df)], "x double, df int").select(special.chi2_upper_tail(F.col("x"), F.col("df"))).first()
    assert row[0] == pytest.approx(0.05, abs=1e-7)


def test_chi2_tail_edges(make, values):
    df = make([(0.0, 1), (0.0, 2), (1e6, 3), (None, 2), (1.0, None)], "x double, df int")
    got = values(df.select(special.chi2_upper_tail(F.col("x"), F.col("df"))))
    assert got[:2] == [1.0, 1.0] and got[2] < 1e-290 and got[3:] == [None, None]


@pytest.mark.parametrize("nu,value", [
    (1, 12.706205), (2, 4.302653), (10, 2.228139), (30, 2.042272), (100, 1.983972), (101, 1.983731), (1000, 1.962339)])
def test_t_quantile(make, nu, value):
    got = make([(nu,)], "n bigint").select(special.t_quantile(0.975, F.col("n"))).first()[0]
    assert got == pytest.approx(value, abs=1e-6)


def test_t_quantile_without_freedom(make, values):
    assert values(make([(0,), (None,)], "n bigint").select(special.t_quantile(0.975, F.col("n")))) == [None, None]


def poisson_tail(x, df):
    """The finite sum for even degrees of freedom, in decimal arithmetic of 60 digits."""
    with decimal.localcontext(decimal.Context(prec=60)):
        h = decimal.Decimal(x) / 2
        term = total = decimal.Decimal(1)
        for k in range(1, df // 2):
            term = term * h / k
            total += term
        return float((-h).exp() * total)


@pytest.mark.parametrize("df", [2, 10, 18, 20, 22, 400, 1000, 2000, 9802, 496_008])
def test_chi2_tail_at_any_size(make, df):
    spread = math.sqrt(2 * df)
    xs = [max(0.5, df + k * spread) for k in (-3, -0.1, 0, 0.1, 1, 5, 12, 30)] + [float(df), df + 2.0]
    rows = make([(x, df) for x in xs], "x double, df int").select("x", special.chi2_upper_tail(F.col("x"), F.col("df")).alias("p")).collect()
    for x, p in rows:
        assert p == pytest.approx(poisson_tail(x, df), rel=1e-8, abs=1e-300), x


def test_chi2_tail_of_odd_degrees(make):
    """Against erfc and its recurrence."""
    xs = [0.01, 0.7, 1.0, 3.0, 9.0, 40.0, 300.0, 1300.0]
    rows = make([(x, df) for x in xs for df in (1, 3, 5, 21)], "x double, df int").select(
        "x", "df", special.chi2_upper_tail(F.col("x"), F.col("df")).alias("p")).collect()
    for x, df, p in rows:
        h = x / 2
        want = math.erfc(math.sqrt(h)) + sum(math.exp((k - 0.5) * math.log(h) - h - math.lgamma(k + 0.5)) for k in range(1, (df + 1) // 2))
        assert p == pytest.approx(want, rel=1e-9, abs=1e-300), (x, df)


def _log_tail(x, df):
    """Even degrees only: the Poisson sum, in logarithms."""
    h, m = x / 2, df // 2
    logs = [k * math.log(h) - h - math.lgamma(k + 1) for k in range(m)]
    top = max(logs)
    return top + math.log(math.fsum(math.exp(v - top) for v in logs))


def test_logarithm_of_the_tail(make):
    pairs = [(1.0, 2), (3.0, 2), (0.1, 4), (40.0, 4), (2000.0, 4), (9000.0, 20), (6.6e6, 9800), (1e5, 90_000), (9e4, 100_000), (1e8, 2)]
    df = make([(float(x), d) for x, d in pairs], "x double, d int")
    got = {(r.x, r.d): r.v for r in df.select("x", "d", special.chi2_log_upper_tail(F.col("x"), F.col("d")).alias("v")).collect()}
    for x, d in pairs:
        assert got[x, d] == pytest.approx(_log_tail(x, d), rel=1e-10, abs=1e-10), (x, d)
    odd = make([(6.6e6, 9801), (0.0, 3), (None, 3), (5.0, 0)], "x double, d int").select(special.chi2_log_upper_tail(F.col("x"), F.col("d")).alias("v")).collect()
    assert _log_tail(6.6e6, 9800) < odd[0].v < _log_tail(6.6e6, 9802)
    assert [r.v for r in odd[1:]] == [0.0, None, None]


def test_logarithm_agrees_with_the_tail(make):
    df = make([(x / 3, d) for x in range(1, 200, 7) for d in (1, 2, 3, 7, 30)], "x double, d int")
    for r in df.select(special.chi2_log_upper_tail(F.col("x"), F.col("d")).alias("v"), special.chi2_upper_tail(F.col("x"), F.col("d")).alias("p")).collect():
        assert math.exp(r.v) == pytest.approx(r.p, rel=1e-11)
