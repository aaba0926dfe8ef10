"""The stages of the pipeline on odd tables: what each of them keeps, and that columns of any name come through."""

import pytest

import corpus_pipeline
from canvass.llm.common import stored

EXTRA = "_sha string, _gone long, _bad string, score double, kept boolean, own_id long, length long"
PLAIN = " ".join(f"plain{k}" for k in range(40))
LONG = " ".join(f"w{k % 997}" for k in range(40_000))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Two small tables that the stages read beside the documents."""
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, 0), (None, 1), (77, 1)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "a benchmark item of quite a few words in one row"), (2, None), (None, "tiny secret")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def through(spark, docs, sf_dir):
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stored(stage(spark, docs, sf_dir), name)
        if name != "best_fit_packing":
            assert docs.columns == columns
        kept[name] = docs
    return kept


def test_odd_rows(spark, sf_dir):
    texts = [
        (1, PLAIN), (2, PLAIN), (3, PLAIN + " more"), (4, None), (5, ""), (6, LONG), (7, "has a benchmark item of quite a few words in one row indeed"),
        (None, PLAIN), (None, "no id and tiny secret inside"), (None, "no id, all clean"), (9, "one id"), (9, "of two texts"), (10, "say no id, all clean?"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), str(i), 1, "b", 0.5, True, 2, 3) for i, t in texts], f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")
    kept = through(spark, docs, sf_dir)
    of = lambda name: sorted(((r.doc_id, (r.text or "")[:30]) for r in kept[name].collect()), key=repr)
    cut = lambda i, t: (i, (t or "")[:30])
    exact = [t for t in texts if t not in ((2, PLAIN), (None, PLAIN), (5, ""))]
    assert of("exact_dedup") == sorted((cut(*t) for t in exact), key=repr)
    near = [t for t in exact if t[0] != 3]
    assert of("minhash_near_dedup") == sorted((cut(*t) for t in near), key=repr)
    clean = [t for t in near if t[0] != 7 and "secret" not in (t[1] or "")]
    assert of("decontamination") == sorted((cut(*t) for t in clean), key=repr)
    rows = kept["best_fit_packing"].collect()
    assert sum(r.piece == 0 for r in rows) == len(clean) and sum(r.doc_id == 6 for r in rows) > 20
    assert {r._sha for r in kept["decontamination"].collect()} == {str(i) for i, _ in clean}


def test_tables_without_rows(spark, sf_dir):
    docs = spark.createDataFrame([], f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")
    assert all(df.count() == 0 for df in through(spark, docs, sf_dir).values())
