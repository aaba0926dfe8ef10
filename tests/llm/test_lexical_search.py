"""Ranked search against scoring every document, and what the bounds save."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from canvass.llm import lexical_search as ls


def terms(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, k=20):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, c.total()) for i, c in counted if c]
    big_n, total = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in counted:
            m = 100 - 25 + (25 * n * big_n) // total
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return sorted(out, key=str)


def searched(spark, docs, items, parts=3, k=20):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, id int, term string").repartition(parts)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, ask int")
    return sorted(map(tuple, ls.lexical_search(d, q, k).collect()), key=str)


def words(rng, n, size=300):
    return " ".join(rng.choice(["w", "W", "é", "日本"]) + str(min(int(rng.expovariate(0.02)), size)) + rng.choice(["", ",", ".", "\n", "@"]) for _ in range(n))


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(ls, "GATHERED_DOCS", 60)
    monkeypatch.setattr(ls, "SLICE_BYTES", 2_000)
    monkeypatch.setattr(ls, "QUERY_TERMS", 40)
    monkeypatch.setattr(ls, "SCORED", 3)


def test_same_as_scoring_everything(spark, small_blocks):
    rng = random.Random(2)
    docs = [(k, words(rng, rng.choice([1, 5, 40, 200]))) for k in range(400)]
    items = [(k, words(rng, rng.choice([1, 3, 20]))) for k in range(25)]
    assert searched(spark, docs, items) == brute(docs, items)


def test_odd_rows(spark, small_blocks):
    rng = random.Random(4)
    docs = [(k, rng.choice([None, "", " ,;", "a", "A a", "a b", "Ünï a", "ünï", "\0a\x7fb"])) for k in range(60)] + [(None, "a b c"), (None, "a b c"), (3, "a b c"), (7, "long " * 50_000 + "a"), (8, "x" * 70_000 + " a")]
    items = [(1, "a"), (1, "A b"), (None, "c ünï ÜNÏ"), (2, None), (3, ""), (4, "nothing here"), (5, "long long " * 3 + "x" * 70_000)]
    assert searched(spark, docs, items) == brute(docs, items)


def test_copies_tie_by_id(spark, small_blocks):
    docs = [(k, "one common passage of words") for k in range(200)] + [(200, "another passage")]
    items = [(1, "common passage"), (2, "another")]
    assert searched(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == [] and searched(spark, [(1, "a")], []) == []
    assert searched(spark, [(1, None)], [(1, "a")]) == []


def test_sample_tables(spark):
    read = lambda t, i: [(r[i], r.text) for r in spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").collect()]
    docs, items = read("documents", "doc_id"), read("benchmark", "item_id")
    assert searched(spark, docs, items) == brute(docs, items)


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = " ".join(f"w{k % 91}" for k in range(5_000)).encode()
    whole = ls.term_counts(text)
    monkeypatch.setattr(ls, "_PIECE", 100)
    assert ls.term_counts(text) == whole and whole.total() == 5_000


def indexed(rows):
    schema = ls.T.StructType.fromDDL(ls.INDEX.format(id="long"))
    gathered = ls._Gathered()
    for i, text in rows:
        gathered.add(i, text.encode())
    for cells in gathered.blocks():
        yield dict(zip(schema.names, cells))


def test_bounds_hold_and_leave_most_documents_out():
    rng = random.Random(6)
    docs = [(k, words(rng, 80, 3000)) for k in range(3000)]
    asked = ls._Queries([(k, ls.term_counts(" ".join(docs[k * 100][1].split()[:30]).encode())) for k in range(20)])
    blocks = list(indexed(docs))
    n, total = sum(b["docs"] for b in blocks), sum(b["tokens"] for b in blocks)
    df = Counter(t for _, text in docs for t in ls.term_counts(text.encode()))
    asked.weigh(n, {k: df[t] for k, t in enumerate(asked.vocabulary)})
    best, scored = [ls.Best(20) for _ in asked.ids], 0
    for row in blocks:
        block = ls._Block(row, n, total)
        bounds = block.bounds(asked)
        block.load()
        for q in range(len(asked.ids)):
            weight = np.zeros(len(block.exact[0]), np.int64)
            for t, w in zip(asked.terms[q], asked.weights[q]):
                if asked.vocabulary[t] in block.exact[0]:
                    weight[block.exact[0][asked.vocabulary[t]]] = w
            assert (bounds[q] >= block.scores(np.arange(len(block.ids)), weight)).all()
        scored += block.search(asked, best)
    assert scored < 0.1 * 20 * len(docs)
