"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A word enters as a learnt vector of its own, if enough training documents have
it, next to the mean of learnt vectors of its hashed character 3- and 4-grams,
so spellings never seen still say something. One gated recurrent layer reads a window forwards, another one
backwards; attention weighs the words' states, and a logistic unit scores the
pooled state. Every text is cut into overlapping windows, all of them are
scored, and the highest logit, calibrated on the training documents, is the
document's score.

The network is trained in numpy on the driver, on about ``per_class`` toxic
and twice as many clean labelled documents (the documented bound of the sample, whose rows are chosen by
a hash of the id; of a repeated id one text teaches), of at most ``most_characters`` characters a class and none
longer than a piece that is scored at a time. Only documents carry labels, so a training step takes whole
documents and follows the soft maximum of their windows' logits: a toxic
document teaches by the windows that look toxic, a clean one by those that look
least clean. A fifth of the sample chooses the best round and calibrates.
Scoring is one pass in pieces of
bounded size: a piece's distinct words are embedded once, and all windows of
the piece advance together, one matrix product a step.

Nulls: a null text, like any text without a word, scores 0. Labels that are
null, or belong to held-out or missing documents, teach nothing; with no labels
of both kinds every score is 0. Repeated rows are scored alike; among several
texts of a labelled id, the least one in code point order teaches, and a
document that has both labels is toxic. Very long texts are scored whole, a
window at a time. Ids may be of any type. Further columns of any name are not
read by ``toxicity`` and pass ``keep_clean`` as they are. An empty table gives
an empty result.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canvass.llm.batches import chunks, mixed
from canvass.llm.common import text_of
from canvass.llm.split import held_out, sampled

PER_CLASS, CLEAN_TIMES = 800, 2
WINDOW, STRIDE = 40, 30
GRAMS = 1 << 16  #: rows of the n-gram table
LEAST_DOCUMENTS = 4  #: a word of fewer training documents is unknown: its spelling speaks for it
SIZE, HIDDEN = 8, 8  #: width of each embedding and of each direction's state
THRESHOLD = 0.3
#: Characters that are scored at a time, or one longer text.
PIECE = 400_000
MOST_CHARACTERS = 16_000_000  #: characters of each class that teach
#: Code points where letters (with the marks upon them) begin and end, in turn.
LETTER_EDGES = np.flatnonzero(np.diff([unicodedata.category(chr(c))[0] in "LM" for c in range(sys.maxunicode + 1)], prepend=False, append=False))


class Words(NamedTuple):
    """The words of some texts: per text its first word's number (one entry more than texts), and distinct words."""

    first: np.ndarray
    which: np.ndarray  #: distinct word of each word
    key: np.ndarray  #: hash of each distinct word
    gram: np.ndarray  #: rows of the n-gram table, of all distinct words in turn
    gram_at: np.ndarray  #: where a distinct word's n-grams begin


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def words_of(texts: list[str]) -> Words:
    """Words are runs of letters, lower-cased; whatever separates them ends n-grams too."""
    parts = [t.lower().encode("utf-32-le", "surrogatepass") for t in texts]
    code = np.frombuffer(b"\0\0\0\0" + b"\0\0\0\0".join([*parts, b"\0\0\0\0"]), np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(p) // 4 + 1 for p in parts]))).astype(np.int64)
    bounds = np.concatenate(([0], LETTER_EDGES, [sys.maxunicode + 1]))
    letter = np.repeat(np.arange(len(bounds) - 1) % 2 == 1, np.diff(bounds))[code]
    code = np.where(letter, code, 0).astype(np.uint64)
    edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power = np.full(int((end - begin).max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64)
    power = np.multiply.accumulate(power)
    at = _ranges(begin, end - begin)
    place = at - np.repeat(begin, end - begin)
    key = mixed(np.add.reduceat(code[at] * power[place], np.cumsum(end - begin) - (end - begin))) if len(begin) else np.zeros(0, np.uint64)
    distinct, sample, which = np.unique(key, return_index=True, return_inverse=True)
    three = code[:-2] * np.uint64(0x10001) * np.uint64(31) + code[1:-1] * np.uint64(0x1003F) + code[2:]
    four = three[:-1] * np.uint64(0x9E3779B1) + code[3:]
    grams = [(mixed(g + np.uint64(k << 60)) % np.uint64(GRAMS)).astype(np.int32) for k, g in enumerate((three, four), 1)]
    b, n = begin[sample], (end - begin)[sample]
    counts = np.stack([n, n - 1])
    gram = np.empty(int(counts.sum()), np.int32)
    gram_at = np.cumsum(counts.sum(axis=0)) - counts.sum(axis=0)
    gram[_ranges(gram_at, counts[0])] = grams[0][_ranges(b - 1, counts[0])]
    gram[_ranges(gram_at + counts[0], counts[1])] = grams[1][_ranges(b - 1, counts[1])]
    return Words(np.searchsorted(begin, starts), which, distinct, gram, gram_at)


def windows_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and length of every window."""
    n = np.diff(first)
    count = np.where(n == 0, 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)))
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return doc, first[doc] + k * STRIDE, np.minimum(WINDOW, n[doc] - k * STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def initial(known: int, seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    new = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
    p = {"word": new(known + 1, SIZE, scale=0.2), "gram": new(GRAMS, SIZE, scale=0.2)}
    for d in ("f", "b"):
        p[f"x{d}"] = new(2 * SIZE, 3 * HIDDEN, scale=0.25)
        p[f"h{d}"] = new(HIDDEN, 3 * HIDDEN, scale=0.3)
        p[f"c{d}"] = np.zeros(3 * HIDDEN, np.float32)
    p |= {"att": new(2 * HIDDEN, 2 * HIDDEN, scale=0.3), "query": new(2 * HIDDEN, scale=0.3), "out": new(2 * HIDDEN, scale=0.3), "bias": np.zeros(1, np.float32)}
    return p


def rows_of(known: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Rows of the word table, which has the sorted hashes ``known`` and a last row for other words."""
    at = np.searchsorted(known, key)
    return np.where(np.append(known, 0)[at] == key, at, len(known)) if len(known) else np.zeros(len(key), np.int64)


def embed(p: dict, rows: np.ndarray, words: Words) -> np.ndarray:
    """Vectors of the distinct words, whose rows in the word table are ``rows``."""
    if not len(rows):
        return np.zeros((0, 2 * SIZE), np.float32)
    n, out = np.diff(np.append(words.gram_at, len(words.gram))), np.empty((len(rows), 2 * SIZE), p["gram"].dtype)
    out[:, :SIZE] = p["word"][rows]
    for s in range(0, len(rows), 20_000):
        at = words.gram_at[s : s + 20_000]
        grams = words.gram[at[0] : at[-1] + n[s + len(at) - 1]]
        out[s : s + len(at), SIZE:] = np.add.reduceat(p["gram"][grams], at - at[0]) / n[s : s + len(at), None]
    return out


def _gru(p: dict, d: str, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
    """States of one direction. ``x``: input products of the distinct words (a last row for padding); ids, mask: step by window."""
    steps, n = ids.shape
    h, out = np.zeros((n, HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32)
    w, k = p[f"h{d}"], HIDDEN
    for t in range(steps) if d == "f" else reversed(range(steps)):
        a = x[ids[t]]
        g = _sigmoid(a[:, : 2 * k] + h @ w[:, : 2 * k])
        z, r = g[:, :k], g[:, k:]
        c = np.tanh(a[:, 2 * k :] + (r * h) @ w[:, 2 * k :])
        new = (h + z * (c - h)) * mask[t] if not mask[t].all() else h + z * (c - h)
        if keep is not None:
            keep.append((t, h, z, r, c))
        out[t] = h = new
    return out


def forward(p: dict, vectors: np.ndarray, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows; ``ids``: distinct word by step and window, the number of words marks padding."""
    mask = (ids < len(vectors)).astype(np.float32)[:, :, None]
    kept: dict[str, list | None] = {d: [] if keep is not None else None for d in "fb"}
    states = []
    for d in "fb":
        x = np.concatenate([vectors @ p[f"x{d}"] + p[f"c{d}"], np.zeros((1, 3 * HIDDEN), np.float32)])
        states.append(_gru(p, d, x, ids, mask, kept[d]))
    h = np.concatenate(states, axis=2)
    u = np.tanh(h @ p["att"])
    e = np.where(mask[:, :, 0] > 0, u @ p["query"], -np.inf)
    e = np.exp(e - e.max(axis=0))
    a = e / e.sum(axis=0)
    pooled = np.einsum("tn,tnk->nk", a, h)
    if keep is not None:
        keep |= {"h": h, "u": u, "a": a, "pooled": pooled, "mask": mask, **kept}
    return pooled @ p["out"] + p["bias"][0]


def soft_maximum(logit: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document the log of the mean of the windows' exponentials, and each window's share in it; documents count from 0 without gaps."""
    top = _highest(doc, logit, int(doc.max()) + 1)
    e = np.exp(logit - top[doc])
    total = np.bincount(doc, e)
    return top + np.log(total / np.bincount(doc)), e / total[doc]


def gradients(p: dict, rows: np.ndarray, words: Words, ids: np.ndarray, doc: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted log loss over documents, whose windows consist of the distinct words of ``words``."""
    keep: dict = {}
    vectors = embed(p, rows, words)
    logit = forward(p, vectors, ids, keep)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    whole, share = soft_maximum(logit, doc)
    dl = (((_sigmoid(whole) - y) * weight / len(y))[doc] * share).astype(vectors.dtype)
    h, u, a, mask = keep["h"], keep["u"], keep["a"], keep["mask"]
    g["out"], g["bias"] = keep["pooled"].T @ dl, dl.sum(keepdims=True)
    dp = dl[:, None] * p["out"]
    dh = a[:, :, None] * dp
    da = np.einsum("tnk,nk->tn", h, dp)
    de = a * (da - (a * da).sum(axis=0))
    g["query"] = np.einsum("tn,tnk->k", de, u)
    du = de[:, :, None] * p["query"] * (1 - u * u)
    g["att"] = np.einsum("tnk,tnj->kj", h, du)
    dh += du @ p["att"].T
    dv = np.zeros_like(vectors)
    k = HIDDEN
    for d, part in (("f", slice(0, k)), ("b", slice(k, 2 * k))):
        w, dw = p[f"h{d}"], g[f"h{d}"]
        dx = np.zeros((len(vectors) + 1, 3 * k), np.float32)
        carry = np.zeros((ids.shape[1], k), np.float32)
        steps = []
        for t, h0, z, r, c in reversed(keep[d]):
            dn = (dh[t][:, part] + carry) * mask[t]
            dc = dn * z * (1 - c * c)
            drh = dc @ w[:, 2 * k :].T
            dg = np.concatenate([dn * (c - h0) * z * (1 - z), drh * h0 * r * (1 - r)], axis=1)
            carry = dn * (1 - z) + drh * r + dg @ w[:, : 2 * k].T
            dw[:, : 2 * k] += h0.T @ dg
            dw[:, 2 * k :] += (r * h0).T @ dc
            steps.append((t, np.concatenate([dg, dc], axis=1)))
        order = np.concatenate([ids[t] for t, _ in steps])
        total = np.concatenate([s for _, s in steps])
        for j in range(3 * k):
            dx[:, j] = np.bincount(order, total[:, j], minlength=len(dx))
        dx = dx[:-1]
        g[f"x{d}"], g[f"c{d}"] = vectors.T @ dx, dx.sum(axis=0)
        dv += dx @ p[f"x{d}"].T
    n = np.diff(np.append(words.gram_at, len(words.gram)))
    share = np.repeat(dv[:, SIZE:] / n[:, None], n, axis=0)
    for j in range(SIZE):
        g["word"][:, j] = np.bincount(rows, dv[:, j], minlength=len(p["word"]))
        g["gram"][:, j] = np.bincount(words.gram, share[:, j], minlength=GRAMS)
    return g


def _window_ids(words: Words, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Distinct words by step and window, padded with their number."""
    step = np.arange(WINDOW)[:, None]
    at = np.minimum(first + step, max(0, len(words.which) - 1))
    return np.where(step < length, words.which[at], len(words.key))


def _logits(p: dict, rows: np.ndarray, words: Words, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    vectors = embed(p, rows, words)
    parts = [forward(p, vectors, _window_ids(words, first[s : s + 4096], length[s : s + 4096])) for s in range(0, len(first), 4096)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _highest(doc: np.ndarray, logit: np.ndarray, texts: int) -> np.ndarray:
    top = np.full(texts, -np.inf)
    np.maximum.at(top, doc, logit)
    return top


class Model(NamedTuple):
    weights: dict[str, np.ndarray]
    known: np.ndarray
    slope: float
    offset: float

    def score(self, texts: list[str]) -> np.ndarray:
        words = words_of(texts)
        doc, first, length = windows_of(words.first)
        top = _highest(doc, _logits(self.weights, rows_of(self.known, words.key), words, first, length), len(texts))
        return np.where(np.isfinite(top), _sigmoid(self.slope * np.where(np.isfinite(top), top, 0) + self.offset), 0.0)


def words_in_pieces(texts: list[str], most: int = 500_000) -> Words:
    """``words_of`` for many texts, a bounded piece of them at a time."""
    parts, own, size = [], [], 0
    for t in [*texts, None]:
        if own and (t is None or size + len(t) > most):
            parts.append(words_of(own))
            own, size = [], 0
        if t is not None:
            own.append(t)
            size += len(t)
    if not parts:
        return words_of([])
    key, sample, back = np.unique(np.concatenate([w.key for w in parts]), return_index=True, return_inverse=True)
    counts = np.concatenate([np.diff(np.append(w.gram_at, len(w.gram))) for w in parts])
    gram_at = np.concatenate([w.gram_at + n for w, n in zip(parts, np.cumsum([0, *(len(w.gram) for w in parts)]))])
    first = np.concatenate([[0], *(np.diff(w.first) for w in parts)])
    which = np.concatenate([back[w.which + n] for w, n in zip(parts, np.cumsum([0, *(len(w.key) for w in parts)]))])
    n, gram = counts[sample], np.concatenate([w.gram for w in parts])[_ranges(gram_at[sample], counts[sample])]
    return Words(np.cumsum(first), which, key, gram, np.cumsum(n) - n)


def leaning(words: Words, labels: np.ndarray, teach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How much more often toxic than clean documents have each word and each n-gram (a log ratio over its standard error), and which words enough of them have.

    Vectors start from it, which saves the network from finding rare words by chance.
    """
    word, gram = np.full((2, len(words.key)), 0.5), np.full((2, GRAMS), 0.5)
    n = np.diff(np.append(words.gram_at, len(words.gram)))
    for d in teach:
        own = np.unique(words.which[words.first[d] : words.first[d + 1]])
        word[labels[d], own] += 1
        gram[labels[d], np.unique(words.gram[_ranges(words.gram_at[own], n[own])])] += 1
    docs = np.bincount(labels[teach], minlength=2) + 1
    out = []
    for b, a in (word, gram):
        z = (np.log(a / docs[1]) - np.log(b / docs[0])) / np.sqrt(1 / a + 1 / b) / 2
        out.append(np.where(a + b >= LEAST_DOCUMENTS + 1, z, 0))
    return out[0], out[1], word.sum(axis=0) >= LEAST_DOCUMENTS + 1


def fit(
    texts: list[str],
    labels: np.ndarray,
    weight: np.ndarray,
    rounds: int = 6,
    batch: int = 512,
    rate: float = 0.01,
    decay: float = 0.01,
    blur: float = 0.3,
    least_steps: int = 250,
    seed: int = 5,
) -> Model | None:
    """A network and its calibration; ``weight`` undoes the sampling of the classes when calibrating.

    A step takes documents with about ``batch`` windows. ``blur``: the share of distinct words that a step treats as unknown.
    """
    if len(set(labels.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    words = words_in_pieces(texts)
    doc, first, length = windows_of(words.first)
    if not len(doc):
        return None
    own_windows = np.searchsorted(doc, np.arange(len(texts) + 1))
    aside = rng.random(len(texts)) < 0.2
    if labels[aside].sum() < 30:  # too few to judge by: learn and judge by all
        aside[:] = False
    gram_n = np.diff(np.append(words.gram_at, len(words.gram)))
    teach = np.flatnonzero(~aside & (np.diff(own_windows) > 0))
    word_lean, gram_lean, frequent = leaning(words, labels, teach)
    known = words.key[frequent]
    rows = rows_of(known, words.key)
    p = initial(len(known), seed)
    p["word"][:-1, 0], p["gram"][:, 0] = word_lean[frequent], gram_lean
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    best, best_loss, judges = p, np.inf, np.flatnonzero((aside if aside.any() else ~aside) & (np.diff(own_windows) > 0))
    balance = np.where(labels == 1, 0.5 / max(labels[teach].mean(), 1e-9), 0.5 / max(1 - labels[teach].mean(), 1e-9))
    rounds = max(rounds, -(-least_steps * batch // max(1, int(np.diff(own_windows)[teach].sum()))))
    for _ in range(rounds):
        order = rng.permutation(teach)
        cut = np.flatnonzero(np.diff(np.cumsum(np.diff(own_windows)[order]) // batch, prepend=0))
        for docs in np.split(order, cut):
            if not len(docs):
                continue
            n_own = np.diff(own_windows)[docs]
            at = _ranges(own_windows[docs], n_own)
            ids = _window_ids(words, first[at], length[at])
            used, local = np.unique(ids, return_inverse=True)
            used = used[used < len(words.key)]
            n = gram_n[used]
            small = Words(words.first, words.which, words.key[used], words.gram[_ranges(words.gram_at[used], n)], np.cumsum(n) - n)
            shown = np.where(rng.random(len(used)) < blur, len(known), rows[used])
            g = gradients(p, shown, small, local.reshape(ids.shape), np.repeat(np.arange(len(docs)), n_own), labels[docs], balance[docs])
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                p[k] -= (rate * ((m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8) + decay * p[k])).astype(np.float32)
        at = _ranges(own_windows[judges], np.diff(own_windows)[judges])
        whole, _ = soft_maximum(_logits(p, rows, words, first[at], length[at]), np.repeat(np.arange(len(judges)), np.diff(own_windows)[judges]))
        loss = np.average(np.logaddexp(0, np.where(labels[judges] == 1, -whole, whole)), weights=balance[judges])
        if loss < best_loss:
            best, best_loss = {k: x.copy() for k, x in p.items()}, loss
    p = best
    top = _highest(doc, _logits(p, rows, words, first, length), len(texts))
    checks = aside if len(set(labels[aside].tolist())) == 2 else ~aside
    return Model(p, known, *_calibrated(top[checks], labels[checks], weight[checks]))


def _calibrated(top: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the documents' highest logits, by ridged Newton steps."""
    ok = np.isfinite(top)
    x, y, w = np.stack([top[ok], np.ones(ok.sum())], 1), labels[ok].astype(float), weight[ok]
    b, ridge = np.array([0.3, 0.0]), np.array([0.3, 1e-4])  # a penalised slope puts the middle between the classes where they part
    for _ in range(200):
        q = _sigmoid(x @ b)
        grad = x.T @ (w * (q - y)) + ridge * b
        hess = (x * (w * q * (1 - q))[:, None]).T @ x + np.diag(ridge)
        move = np.linalg.solve(hess, grad)
        b -= move / max(1.0, np.abs(move).max())
    return float(max(b[0], 0.05)), float(b[1])


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_class: int = PER_CLASS,
    most_characters: int = MOST_CHARACTERS,
) -> Model | None:
    """A model of labelled documents that are not held out; None without both classes."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col))
    marks = marks.groupBy("id").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None
    share = F.when(F.col("y") == 1, min(1.0, per_class / sizes[1])).otherwise(min(1.0, CLEAN_TIMES * per_class / sizes[0]))
    chosen = F.broadcast(marks.filter(sampled("id", share)))  # about (1 + CLEAN_TIMES) * per_class rows, whatever the table
    text = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).filter(F.length("text") <= PIECE)
    one = text.join(chosen, "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    in_turn = Window.partitionBy("y").orderBy(F.xxhash64("id", F.lit(29)), "id")
    rows = one.withColumn("so_far", F.sum(F.length("text")).over(in_turn)).filter(F.col("so_far") <= most_characters).collect()
    rows.sort(key=lambda r: r["id"])
    y = np.array([r["y"] for r in rows], np.int64)
    drawn = np.bincount(y, minlength=2)
    weight = np.array([max(1.0, sizes[k] / drawn[k]) for k in y])
    return fit([r["text"] for r in rows], y, weight)


def scorer(model: Model | None):
    """Scores of a text column, piece by piece."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            parts = [np.zeros(0)]
            for at in range(0, len(batch), 1000):
                some = batch.iloc[at : at + 1000]
                table = pa.RecordBatch.from_arrays([pa.array(range(len(some))), pa.array(some, pa.string())], names=["i", "t"])
                parts += [model.score(texts) if model else np.zeros(len(texts)) for _, texts in chunks(iter([table]), PIECE)]
            yield pd.Series(np.concatenate(parts))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    score = scorer(learn(docs, labels, id_col, text_col, label_col, per_class))
    found = docs.select(F.col(id_col).alias("id"), score(F.col(text_col).cast("string")).alias("score"))
    return found.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    score = scorer(learn(docs, labels, id_col, text_col))
    return docs.filter(score(F.col(text_col).cast("string")) < THRESHOLD)
