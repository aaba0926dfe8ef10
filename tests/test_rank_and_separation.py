"""Rank decisions without squared columns, and separation told apart from near separation."""

import itertools
import math

import numpy as np
import pytest

from canvass.functions.special import erfc_array
from canvass.operators import probit as P
from canvass.operators.separation import MARGIN, Program, separations
from canvass.operators.tall_skinny import independent, triangles
from canvass.session import local_table


def fit(spark, columns, y, parts=4):
    names = [f"x{k}" for k in range(len(columns))]
    rows = [(*map(float, r), v) for *r, v in zip(*columns, [None if v is None else int(v) for v in y])]
    df = local_table(spark, rows, ", ".join(f"{n} double" for n in names) + ", y int").repartition(parts)
    return P.fit_probits(df, [P.numeric_term(n) for n in names], {"f": ["y"]})


def slopes(batch):
    return {r.term: r for r in batch.coefficients.collect()}


def test_triangles_are_those_of_the_whole_table(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    df = local_table(spark, [tuple(map(float, r)) for r in x], "a double, b double, c double, d double").repartition(9)

    def pieces(batch):
        part = np.column_stack([c.to_numpy() for c in batch.columns])
        yield part, (part[:, :1] > 0).astype(int)

    first, whole = triangles(df, pieces, 1, 4)
    assert whole.T @ whole == pytest.approx(x.T @ x) and first.T @ first == pytest.approx(x[x[:, 0] > 0].T @ x[x[:, 0] > 0])


def test_rank_sees_below_the_root_of_rounding():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(2, 500))
    for own, kept in ((1e-3, 3), (1e-6, 3), (1e-9, 3), (1e-13, 2), (0, 2)):
        r = np.linalg.qr(np.column_stack([a, b, a + b + own * rng.normal(size=500)]), mode="r")
        assert len(independent(r)) == kept, own
    assert independent(np.zeros((3, 3))) == []


@pytest.mark.parametrize("own", [1e-3, 1e-6, 1e-8])
def test_nearly_dependent_regressors_are_fitted(spark, own):
    """The same model in two regressors that differ by little, and in those that span them."""
    rng = np.random.default_rng(3)
    x, e = rng.normal(size=(2, 4000))
    y = rng.normal(size=4000) < 0.3 + 0.5 * x + 0.4 * e
    far = x + own * e
    e = (far - x) / own  # as far as the cells hold it
    near, plain = slopes(fit(spark, [x, far], y)), slopes(fit(spark, [x, e], y))
    assert {r.status for r in near.values()} == {"ok"}
    scale = max(1.0, 1e-6 / own)
    assert near["x1"].estimate * own == pytest.approx(plain["x1"].estimate, rel=1e-7 * scale)
    assert near["x1"].std_error * own == pytest.approx(plain["x1"].std_error, rel=1e-7 * scale)
    assert near["x1"].std_error_robust * own == pytest.approx(plain["x1"].std_error_robust, rel=1e-7 * scale)
    assert near["x0"].estimate + near["x1"].estimate == pytest.approx(plain["x0"].estimate, abs=1e-6 * scale / own * 1e-6)


def test_terms_aliased_in_one_model_only(spark):
    rng = np.random.default_rng(4)
    x, w = rng.normal(size=(2, 2000))
    g = np.arange(2000) % 2
    rows = [(float(a), float(b), int(c), int(a + d > 0), int(a + d > 0) if c else None) for a, b, c, d in zip(x, w, g, rng.normal(size=2000))]
    df = local_table(spark, rows, "x double, w double, g int, y int, z int")
    terms = [P.Term("g", "cast(g as double)", True), P.numeric_term("x"), P.numeric_term("w")]
    got = {(r.dep, r.term): r.status for r in P.fit_probits(df, terms, {"f": ["y", "z"]}).coefficients.collect()}
    assert got["y", "g"] == "ok" and got["z", "g"] == "aliased" and got["z", "x"] == "ok"


def test_infinite_regressors_are_an_error(spark):
    with pytest.raises(Exception, match="regressor x0 is infinite"):
        fit(spark, [[1.0, math.inf, 3.0]], [0, 1, 0])


def test_complete_quasi_and_near_separation(spark):
    x = np.arange(40) - 19.5
    complete = x > 0
    quasi_x = np.where(np.abs(x) < 3, 0, x)
    quasi = np.where(quasi_x == 0, np.arange(40) % 2, x > 0)
    near = complete.copy()
    near[19], near[20] = True, False
    status = {}
    for name, v, y in (("complete", x, complete), ("quasi", quasi_x, quasi), ("near", x, near)):
        batch = fit(spark, [v], y)
        status[name] = batch.fits.first().status
        if name == "near":
            assert slopes(batch)["x0"].estimate > 0.1
    assert status == {"complete": "separated", "quasi": "quasi-separated", "near": "ok"}


def test_a_rare_level_without_ones_separates_in_part(spark):
    rng = np.random.default_rng(5)
    rare = np.arange(3000) < 12
    x = rng.normal(size=3000)
    y = (rng.normal(size=3000) < x) & ~rare
    assert fit(spark, [x, rare], y).fits.first().status == "quasi-separated"
    y[0] = True
    assert fit(spark, [x, rare], y).fits.first().status == "ok"


def test_steep_but_finite(spark):
    """Answers that all but follow a line: steps run far, and the maximum is finite."""
    x = np.linspace(-1, 1, 2001)
    y = x > 0
    y[[999, 1001]] = [True, False]
    got = fit(spark, [x], y)
    assert got.fits.first().status == "ok"
    b = slopes(got)
    eta = b["(Intercept)"].estimate + b["x0"].estimate * x
    p = 0.5 * erfc_array(-eta / math.sqrt(2))
    f = np.exp(-eta * eta / 2)
    seen = (p > 1e-290) & (1 - p > 0)
    x, y, p, f = x[seen], y[seen], p[seen], f[seen]
    assert abs((f * (y - p) / (p * (1 - p))) @ x) < 1e-5


def by_trial(rows):
    """Largest sum and largest margin over a grid of directions in the plane."""
    t = np.linspace(0, 2 * math.pi, 200_001)
    values = np.column_stack([np.cos(t), np.sin(t)]) @ rows.T
    if (values.min(axis=1) > 1e-7).any():
        return "separated"
    return "quasi-separated" if ((values.min(axis=1) > -1e-9) & (values.max(axis=1) > 1e-3)).any() else "overlap"


@pytest.mark.parametrize("seed", range(60))
def test_program_against_trial(seed):
    rng = np.random.default_rng(seed)
    rows = rng.integers(-2, 3, size=(rng.integers(1, 12), 2)).astype(float)
    if seed % 2:
        rows[:, 0] = np.abs(rows[:, 0])
    rows = rows[(rows != 0).any(axis=1)]
    if not len(rows):
        return
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    if not rows.sum(axis=0).any():
        assert by_trial(unit) == "overlap"
        return

    def obstructed(directions):
        return {k: unit[unit @ d - margin < -MARGIN][:2] for k, (d, margin) in directions.items()}

    assert separations({0: rows.sum(axis=0)}, obstructed) == {0: by_trial(unit)}, rows


def test_program_keeps_to_its_box():
    program = Program(np.array([1.0, 0.5]))
    assert program.solve()[0] == pytest.approx(1.5)
    program.add(np.array([[-1.0, 0.0]]))
    best, d = program.solve()
    assert best == pytest.approx(0.5) and d == pytest.approx([0, 1])
    for a, b in itertools.product((-1.0, 1.0), repeat=2):
        program.add(np.array([[a, b]]))
    assert program.solve()[0] == pytest.approx(0)
