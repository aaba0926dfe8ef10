"""Exact top-k against brute force, odd vectors, ties and pruning."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from canvass.llm import exact_topk as et

LONG = (-(2**63), 2**63 - 1)


def brute(rows, k=5, every=50):
    """rows: (id, vector)."""
    live = [(n, i, [math.floor(256 * x) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in live:
        if i is None or i % every:
            continue
        found = [(-min(max(sum(a * b for a, b in zip(q, v)), LONG[0]), LONG[1]), j is None, j or 0, j) for m, j, v in live if m != n]
        out += [(i, r + 1, j, -s) for r, (s, _, _, j) in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return sorted(out, key=str)


def searched(spark, rows, parts=3, k=5, every=50):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, id int, ids string").repartition(parts)
    return sorted(map(tuple, et.exact_topk(df, F.col("vec_id") % every == 0, k).collect()), key=str)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(et, "BLOCK_ROWS", 16)
    monkeypatch.setattr(et, "QUERY_BYTES", 2_000)


def test_random_vectors_in_small_blocks(spark, small_blocks):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(size=40) * rng.choice([0.1, 1, 5])).tolist()) for k in range(400)]
    assert searched(spark, rows, every=20) == brute(rows, every=20)


def test_odd_vectors(spark, small_blocks):
    rng = random.Random(1)
    odd = [None, [], [None], [math.nan, 1.0], [math.inf], [0.0] * 8, [1.0], [0.5] * 90, [-0.001, 0.001]]
    rows = [(k * 10, rng.choice(odd)) for k in range(60)] + [(None, [3.0, 1.0]), (0, [1.0, 2.0]), (0, [1.0, 2.0])]
    assert searched(spark, rows) == brute(rows)


def test_huge_components_stay_exact(spark):
    rows = [(0, [1e9, -2e9, 1e-3]), (1, [3e9, 5e8, 7.0]), (2, [1e300, 0.0]), (3, [123456.789] * 64), (50, [-1e300]), (100, [0.25] * 64)]
    got = searched(spark, rows)
    assert got == brute(rows) and any(s in LONG for *_, s in got)


def test_copies_and_ties_go_to_smaller_ids(spark, small_blocks):
    rows = [(k, [0.5, 0.25, -1.0]) for k in range(120)] + [(k, [0.0, 1.0, 0.0]) for k in range(120, 200)]
    assert searched(spark, rows) == brute(rows)


def test_few_rows_and_none(spark):
    assert searched(spark, [(0, [1.0]), (7, [2.0])]) == [(0, 1, 7, 256 * 512)]
    assert searched(spark, [(0, [1.0])]) == []
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert et.exact_topk(empty, F.col("vec_id") % 50 == 0).count() == 0


def test_text_ids(spark):
    df = spark.createDataFrame([("b", [1.0]), ("a", [1.0]), ("q", [1.0])], "name string, e array<float>")
    got = et.exact_topk(df, F.col("name") == "q", 2, "name", "e").collect()
    assert sorted((r.rank, r.name, r.score) for r in got) == [(1, "a", 65536), (2, "b", 65536)]


def test_bounds_leave_work_out():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 64)) * 40
    m = np.floor(np.repeat(centres, 500, axis=0) + rng.normal(size=(4000, 64)) * 8).T

    class Row:
        def __init__(self, k):
            self.id, self.part, self.number, self.place, self.digits, self.cells = k, 9, 9, k, None, m[:, k].astype("<f8").tobytes()

    asked = et._Asked([Row(k) for k in range(0, 4000, 50)])
    best = [et.Best(5) for _ in asked.ids]
    first = et._search_block(asked, best, 0, 0, m, list(range(4000)))
    again = et._search_block(asked, best, 0, 1, m, list(range(4000, 8000)))
    assert first == 4000 * 80 * 64 and again < 0.5 * first
