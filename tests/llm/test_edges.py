"""Null, empty, very long, repeated and foreign input, for every operator."""

import hashlib

import pytest

from canvass.llm import decontaminate, exact_dedup, language_id, license_scan, near_dedup, packing, secret_scan, suffix_dedup, toxicity, url_filter

#: Columns that the operators use inside, as unrelated columns of the input.
EXTRA = "id long, norm string, h long, key string, words int, tag string, node long, score double, kept string, host string, label int"
COLUMNS = f"doc_id long, text string, lang string, source string, {EXTRA}"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
TEXTS = [(1, "a few plain words in a row"), (2, None), (3, ""), (4, " \t\n "), (5, LONG), (6, "a few plain words in a row"), (6, "a few plain words in a row"), (None, "no id here at all"), (8, "ünï \U0001f600 \0 code")]


def rows(texts):
    return [(i, t, None if k % 2 else "en", None, 9, "x", 9, "y", 9, "z", 9, 0.5, "q", "h", None) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(TEXTS), COLUMNS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (None, 1), (5, None), (77, 1)], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "a few plain words in a row"), (2, None), (3, ""), (None, "no id here at all"), (4, "too short")], "item_id long, text string")


def by_id(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))


def test_license_scan(docs, nothing):
    got = by_id(license_scan.license_scan(docs))
    assert len(got) == len(TEXTS) and all(r["licences"] is None and r["n_known"] == 0 for r in got)
    assert license_scan.license_scan(nothing).count() == 0


def test_packing(docs, nothing):
    got = by_id(packing.pack(docs))
    assert sum(r["piece"] == 0 for r in got) == len(TEXTS)
    assert {r["length"] for r in got if r["doc_id"] in (2, 3, 4)} == {1}
    assert sum(r["doc_id"] == 5 for r in got) > 20
    assert packing.pack(nothing).count() == 0


def test_secret_scan(docs, nothing):
    got = by_id(secret_scan.secret_scan(docs))
    assert len(got) == len(TEXTS)
    assert {(r["n_assign"], r["spans"], r["base_sha256"]) for r in got} == {(0, "", hashlib.sha256(b"").hexdigest())}
    assert secret_scan.secret_scan(nothing).count() == 0


def test_near_duplicates(docs, nothing):
    got = by_id(near_dedup.near_duplicates(docs))
    assert [(r["doc_id"], r["class_id"], r["kept"]) for r in got] == [
        (None, None, True), (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True), (6, 1, False), (6, 1, False), (8, 8, True)
    ]
    assert near_dedup.near_duplicates(nothing).count() == 0
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == 7


def test_suffix_dedup(docs, nothing):
    got = by_id(suffix_dedup.suffix_dedup(docs))
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 4, 5, 6, 6, 8]
    assert {r["n_removed"] for r in got if r["doc_id"] != 5} == {0}
    five = next(r for r in got if r["doc_id"] == 5)
    assert five["n_spans"] == 1 and five["n_removed"] > 0.9 * five["n_bytes"]
    assert suffix_dedup.suffix_dedup(nothing).count() == 0


def test_contamination(docs, items, nothing):
    got = by_id(decontaminate.contamination(docs, items))
    assert [(r["doc_id"], r["items"]) for r in got] == [(None, []), (1, [1]), (6, [1])]
    assert decontaminate.contamination(nothing, items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).count() == 0
    kept = decontaminate.keep_clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == 5


def test_exact_dedup(docs, nothing):
    got = by_id(exact_dedup.exact_dedup(docs))
    assert [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got] == [
        (None, None, 1, True), (1, 1, 3, True), (2, 2, 2, True), (3, 2, 2, False), (4, 4, 1, True), (5, 5, 1, True), (6, 1, 3, False), (6, 1, 3, False), (8, 8, 1, True)
    ]
    assert exact_dedup.exact_dedup(nothing).count() == 0
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == 6


def test_toxicity_without_labels_of_both_kinds(docs, labels, nothing):
    got = by_id(toxicity.toxicity(docs, labels))
    assert len(got) == len(TEXTS) and {(r["score"], r["predicted"]) for r in got} == {(0.0, 0)}
    assert next(r for r in got if r["doc_id"] is None)["held_out"] is True
    assert toxicity.toxicity(nothing, labels).count() == 0
    kept = toxicity.keep_clean(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == len(TEXTS)


def test_language_id(docs, nothing):
    got = by_id(language_id.language_id(docs))
    assert {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 4)} == {1: "en", 2: "und", 3: "und", 4: "und"}
    assert language_id.language_id(nothing).count() == 0
    assert {r["lang_pred"] for r in by_id(language_id.language_id(docs.filter("lang is null")))} == {"und"}


def test_url_filter(spark):
    urls = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://A.Spam-x.Org?q"), (5, "http://a.spam-x.org/" + "p" * 50_000), (None, "http://x.net/es/"), (7, "http://x.com")]
    pages = spark.createDataFrame([(i, u, "h", "p", True, "k") for i, u in urls], "page_id long, url string, host string, path string, listed boolean, _key string")
    got = {(r.page_id, r.path[:6]): (r.host, r.rule, r.verdict) for r in url_filter.url_verdicts(spark, pages).collect()}
    assert len(got) == 8
    assert got[1, ""] == got[2, ""] == got[3, ""] == got[4, ""] == ("", None, "allow")
    assert got[5, ""][2] == "allow" or got[5, ""] == ("a.spam-x.org", None, "block")
    assert got[5, "/ppppp"] == ("a.spam-x.org", None, "block")
    assert got[None, "/es/"] == ("x.net", "net/es/", "block")
    assert got[7, ""] == ("x.com", None, "allow")
    assert url_filter.url_verdicts(spark, pages.limit(0)).count() == 0
