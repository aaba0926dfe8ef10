"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are character 1- to 3-grams of the lower-cased text, hashed to
``BUCKETS`` columns, weighted by term frequency times inverse document
frequency and scaled to unit length. Document frequencies cover every document
that may be learnt from, added up across tasks as one number per bucket.
Weights come from follow-the-regularised-leader with an elastic-net penalty,
fitted on about ``per_language`` documents a language (the documented bound of
the sample; its rows are chosen by a hash of the id). A fifth of the sample is
set aside to choose the softmax temperature.

What reaches the driver is bounded: one count per bucket, and the sample's
bucket counts. Scoring is one pass, in pieces of bounded size.

Predictions are ``und`` with score 0 where the text is null, has no letter, or
nothing could be learnt. Rows with a null language or id teach nothing.
Repeated rows are scored alike. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm.batches import chunks
from canvass.llm.common import text_of
from canvass.llm.split import held_out, sampled

BITS = 14
BUCKETS = 1 << BITS
PER_LANGUAGE = 600
LETTER = re.compile(r"[^\W\d_]")
_FACTORS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def bucket_counts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and counts of each text's n-grams."""
    parts = [t.lower().encode("utf-32-le", "surrogatepass") for t in texts]
    code = np.frombuffer(b"".join(parts), np.uint32)
    grams, h = [], np.zeros(len(code), np.uint32)
    for n, factor in enumerate(_FACTORS):
        if len(code) <= n:
            break
        h = (h[: len(code) - n] + code[n:]) * factor
        h = h ^ (h >> np.uint32(15))
        grams.append(((h * _FACTORS[0]) >> np.uint32(32 - BITS)).astype(np.int64))
    end = 0
    for p in parts:
        start, end = end, end + len(p) // 4
        own = [g[start : max(start, end - n)] for n, g in enumerate(grams)]
        counts = np.bincount(np.concatenate(own) if own else np.zeros(0, np.int64), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        yield at, counts[at]


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  #: buckets and a last row for the intercept, by language
    temperature: float

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = counts * self.idf[at]
        return x @ self.weights[at] / max(np.sqrt(x @ x), 1e-12) + self.weights[-1]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, alpha=0.5, beta=1.0, l1=1e-3, l2=1e-4, epochs=8, batch=16, seed=3) -> Model:
    """``rows``: language, buckets, counts. Per-coordinate steps of follow-the-regularised-leader over small batches."""
    names = sorted({r[0] for r in rows})
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    aside, learn = order[: len(rows) // 5], order[len(rows) // 5 :]
    if len(aside) == 0:
        learn = order
    z, n, w = (np.zeros((BUCKETS + 1, len(names))) for _ in range(3))
    ready = []
    for name, at, counts in rows:
        x = counts * idf[at]
        ready.append((names.index(name), np.append(at, BUCKETS), np.append(x / max(np.sqrt(x @ x), 1e-12), 1.0)))
    for _ in range(epochs):
        for start in range(0, len(learn), batch):
            own = [ready[i] for i in learn[start : start + batch]]
            at = np.unique(np.concatenate([a for _, a, _ in own]))
            g = np.zeros((len(at), len(names)))
            for y, a, x in own:
                p = softmax(x @ w[a])
                p[y] -= 1
                g[np.searchsorted(at, a)] += np.outer(x, p)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w[at]
            n[at] += g * g
            shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0)
            w[at] = -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)
        rng.shuffle(learn)
    check = [ready[i] for i in (aside if len(aside) else learn)]
    raw, truth = np.array([x @ w[a] for _, a, x in check]), np.array([y for y, _, _ in check])
    loss = lambda t: -np.log(softmax(raw / t)[np.arange(len(truth)), truth] + 1e-12).mean()
    temperature = min(np.geomspace(0.05, 20, 60), key=loss)
    return Model(names, idf, w, float(temperature))


def _document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Documents, and documents per bucket, of ``docs`` (id, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(BUCKETS + 1, np.int64), 0
        for _, texts in chunks(batches):
            for at, _ in bucket_counts(texts):
                df[at] += 1
                total += 1
        df[BUCKETS] = total
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["bucket", "n"])

    rows = docs.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(BUCKETS + 1, np.int64)
    for r in rows:
        df[r["bucket"]] = r["n"]
    return int(df[BUCKETS]), df[:BUCKETS]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """A model of the documents that are not held out and have a language; None if there are none."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(
        ~held_out(id_col) & F.col(lang_col).isNotNull()
    )
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    total, df = _document_frequencies(rows.select("id", "text"))
    idf = np.log((1 + total) / (1 + df)) + 1
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(share)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = list(bucket_counts(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([a for a, _ in found], pa.list_(pa.int64())), pa.array([c for _, c in found], pa.list_(pa.int64()))],
                names=["id", "lang", "at", "n"],
            )

    sample = rows.filter(sampled("id", share)).withColumn("id", F.col("id").cast("long")).mapInArrow(featured, "id long, lang string, at array<long>, n array<long>").collect()
    sample.sort(key=lambda r: (r["id"], r["lang"], r["at"], r["n"]))
    if not sample:
        return None
    return fit([(r["lang"], np.array(r["at"], np.int64), np.array(r["n"], np.float64)) for r in sample], idf)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score (the calibrated probability of the prediction)."""
    model = learn(docs, id_col, text_col, lang_col, per_language)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            names, scores = [], []
            for text, (at, counts) in zip(texts, bucket_counts(texts)):
                if model is None or not LETTER.search(text):
                    names.append("und")
                    scores.append(0.0)
                    continue
                p = softmax(model.logits(at, counts.astype(np.float64)) / model.temperature)
                best = int(p.argmax())
                names.append(model.languages[best])
                scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(predict, "id long, lang_pred string, score double")
    return found.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score")
