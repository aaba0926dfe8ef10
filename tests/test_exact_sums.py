"""Sums that come out the same, to the last bit, however rows are dealt out."""

import math
import statistics
import struct
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from canvass.domain import Domain
from canvass.functions import exact
from canvass.operators import profile as P
from canvass.operators.inference import mean_interval
from canvass.session import local_table

RNG = np.random.default_rng(11)
VALUES = {
    "mixed": (RNG.normal(size=5000) * 10.0 ** RNG.integers(-12, 12, 5000)).tolist(),
    "cancel": [v for x in RNG.normal(size=2000) * 1e9 for v in (x, -x * (1 + 2**-40))],
    "tenths": [0.1] * 4000 + [-0.3] * 700,
    "edge": [2.0**62, -(2.0**62), 1.0, 2.0**-100, 3e-5, -7.25, 2.0**41, 2.0**20 + 2**-30] * 50,
}


def dealt(spark, values, parts):
    order = np.random.default_rng(parts).permutation(len(values))
    rows = [("ab"[k % 2], values[k], k % 3) for k in order.tolist()]
    return local_table(spark, rows, "k string, x double, f int").repartition(parts)


def bits(row):
    return [struct.pack("<d", v) if isinstance(v, float) else v for v in row]


@pytest.mark.parametrize("name", VALUES)
def test_totals_are_rounded_once(spark, name):
    row = exact.exact_sums(dealt(spark, VALUES[name], 5), [], ["x", "f"]).first()
    want = float(sum(map(Fraction, VALUES[name])))
    assert row["sum__x"] == pytest.approx(want, rel=2e-16, abs=2.0**-112) and row["cnt__x"] == len(VALUES[name])
    assert row["sum__f"] == sum(k % 3 for k in range(len(VALUES[name])))


@pytest.mark.parametrize("name", VALUES)
def test_same_bits_on_any_number_of_partitions(spark, name):
    cuts = [P.Cut("k", "K", Domain(("a", "b")))]
    seen = []
    for parts in (1, 7, 64):
        df = dealt(spark, VALUES[name], parts)
        found = [
            P.profile(df, cuts, [*P.means("x"), P.Measure("t", "x", "sum")]),
            P.profile(df, [P.Cut("k", "K")], P.means("x")),
            P.global_summary(df, [*P.means("x"), P.Measure("t", "x", "sum")]),
            mean_interval(df, "x", ["k"]),
        ]
        seen.append([sorted(map(bits, f.collect()), key=repr) for f in found])
    assert seen[0] == seen[1] == seen[2]


def test_plain_sums_would_differ(spark):
    sums = {dealt(spark, VALUES["mixed"], p).agg(F.sum("x")).first()[0] for p in (1, 7, 64)}
    assert len(sums) > 1


@pytest.mark.parametrize("shift", [0.0, 1e6, 1e8])
def test_deviation_far_from_zero(spark, shift):
    values = (RNG.normal(size=3000) + shift).tolist()
    row = mean_interval(dealt(spark, values, 4), "x").first()
    assert row.mu == pytest.approx(float(sum(map(Fraction, values)) / len(values)), rel=1e-15)
    assert row.sigma == pytest.approx(math.sqrt(statistics.variance(map(Fraction, values))), rel=1e-12)


def test_cells_beyond_the_limbs(spark):
    df = local_table(spark, [(1e30,), (1e-40,), (2.0,), (None,)], "x double").coalesce(1)
    assert exact.exact_sums(df, [], ["x"]).first()["sum__x"] == 1e30
    tiny = local_table(spark, [(1e-40,), (2e-40,), (None,)], "x double")
    assert exact.exact_sums(tiny, [], ["x"]).first()["sum__x"] == pytest.approx(3e-40)
    odd = local_table(spark, [(math.inf,), (1.0,)], "x double")
    assert exact.exact_sums(odd, [], ["x"]).first()["sum__x"] == math.inf
    assert math.isnan(exact.exact_sums(local_table(spark, [(math.nan,), (1.0,)], "x double"), [], ["x"]).first()["sum__x"])


def test_nothing_to_add(spark):
    empty = local_table(spark, [(None, "a")], "x double, k string")
    row = exact.exact_sums(empty, ["k"], ["x"]).first()
    assert row["sum__x"] is None and row["cnt__x"] == 0 and row["rows"] == 1
    assert mean_interval(empty, "x").first().mu is None
    assert mean_interval(local_table(spark, [(1.5,)], "x double"), "x").first().sigma is None
