"""Every query against its SQL counterpart in DuckDB.

The regressions need enough rows to have a maximum, so they run at the middle
size and only a few of them here; ``check.py`` runs them all.
"""

import pytest

import check
from __spark_entry__ import ORACLE, QUERIES, entry, oracle_sql, queries
from tests.conftest import MEDIUM, SMALL

FITTED = {n for n in QUERIES if n.startswith(("probit", "tblA", "model", "report")) and n not in ("tblA1", "tblA2")}
SLOW = FITTED - {"probit_coefficients", "probit_lines", "probit_far_from_zero", "probit_undeclared_level", "tblA4", "probit_near_dependence", "probit_separation"}


@pytest.fixture(scope="module")
def databases():
    return {d: check.duck(d) for d in (SMALL, MEDIUM)}


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, databases, name):
    size = MEDIUM if name in FITTED else SMALL
    assert check.compare(QUERIES[name](spark, size), databases[size], ORACLE[name]) == ""


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and df.columns == queries()["profile_segments"](spark, SMALL).columns
