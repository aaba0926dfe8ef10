"""The two trained scorers against versions that go word by word and number by number."""

import math
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest

from canvass.llm import language_id, toxicity

WHOLE = (1 << 64) - 1


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & WHOLE
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & WHOLE
    return x ^ x >> 31


# toxicity

def plain_words(text):
    out = [""]
    for c in text.lower():
        if unicodedata.category(c)[0] in "LM":
            out[-1] += c
        elif out[-1]:
            out.append("")
    return [w for w in out if w]


def plain_key(word):
    power, total = 1, 0
    for c in word:
        power = power * 0x9E3779B97F4A7C15 & WHOLE
        total += ord(c) * power
    return mixed(total & WHOLE)


def plain_grams(word):
    c = [0, *map(ord, word), 0]
    three = [c[i] * 0x10001 * 31 + c[i + 1] * 0x1003F + c[i + 2] & WHOLE for i in range(len(word))]
    four = [three[i] * 0x9E3779B1 + c[i + 3] & WHOLE for i in range(len(word) - 1)]
    return [mixed(g + (1 << 60) & WHOLE) % toxicity.GRAMS for g in three] + [mixed(g + (2 << 60) & WHOLE) % toxicity.GRAMS for g in four]


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def plain_window(model, words):
    p, k = model.weights, toxicity.HIDDEN
    known = {int(h): i for i, h in enumerate(model.known)}
    vectors = []
    for w in words:
        spelt = np.mean([p["gram"][g] for g in plain_grams(w)], axis=0)
        vectors.append(np.concatenate([p["word"][known.get(plain_key(w), len(known))], spelt]))
    states = {}
    for d in "fb":
        h, own = np.zeros(k), []
        for v in vectors if d == "f" else vectors[::-1]:
            a, w = v @ p[f"x{d}"] + p[f"c{d}"], p[f"h{d}"]
            z, r = np.split(sigmoid(a[: 2 * k] + h @ w[:, : 2 * k]), 2)
            h = (1 - z) * h + z * np.tanh(a[2 * k :] + (r * h) @ w[:, 2 * k :])
            own.append(h)
        states[d] = own if d == "f" else own[::-1]
    both = [np.concatenate(pair) for pair in zip(states["f"], states["b"])]
    weight = np.exp([np.tanh(h @ p["att"]) @ p["query"] for h in both])
    return sum(w * h for w, h in zip(weight / weight.sum(), both)) @ p["out"] + p["bias"][0]


def plain_score(model, text):
    words = plain_words(text)
    if not words:
        return 0.0
    starts = [0]
    while starts[-1] + toxicity.WINDOW < len(words):
        starts.append(starts[-1] + toxicity.STRIDE)
    return sigmoid(model.slope * max(plain_window(model, words[s : s + toxicity.WINDOW]) for s in starts) + model.offset)


def test_scores_word_by_word():
    rng = np.random.default_rng(4)
    pool = ["idiota", "¿idiota", "«idiota»", "ÉTÉ", "naïve", "हिन्दी", "добрый", "x", "don't", "3rd", "日本語", "ab×cd", "end."]
    texts = [" ".join(rng.choice(pool, n)) for n in (1, 2, 39, 40, 41, 70, 71, 130)] + ["", "12 34 !?", "¿«»"]
    known = np.sort(np.array([plain_key(w) for w in ("idiota", "été", "x", "don")], np.uint64))
    model = toxicity.Model(toxicity.initial(len(known), 9), known, 1.7, -0.4)
    assert model.score(texts) == pytest.approx([plain_score(model, t) for t in texts], abs=1e-5)


def test_words_are_runs_of_letters_and_their_marks():
    texts = ["¿idiota", "«idiota»", "idiota", "IDIOTA!", "idiota²", "idiota—idiota"]
    assert len(toxicity.words_of(texts).key) == 1
    for text in ("हिन्दी", "áb", "日本語", "ÀÉß", "\U0001d400\U0001d401"):
        assert len(toxicity.words_of([text]).which) == 1, text
    assert len(toxicity.words_of(["".join(map(chr, range(0x80, 0xAA)))]).which) == 0


def test_the_sample_is_bounded_in_rows_and_characters(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels, weight: seen.update(texts=texts, labels=labels, weight=weight))
    rows = [(1, f"b{i} word") for i in range(50)] + [(1, "a first")] + [(i, f"text {i:03d}") for i in range(3, 200)]
    docs = spark.createDataFrame([*rows, (2, "z" * (toxicity.PIECE + 1))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 1)) for i in range(200)] + [(5, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    toxicity.learn(docs, labels)
    assert "a first" in seen["texts"] and not any(t.startswith(("b", "z")) for t in seen["texts"])
    assert len(seen["texts"]) == len(set(seen["texts"]))
    toxicity.learn(docs, labels, per_class=20, most_characters=80)
    for k in (0, 1):
        own = [t for t, y in zip(seen["texts"], seen["labels"]) if y == k]
        assert 0 < sum(map(len, own)) <= 80
        sizes = {w for w, y in zip(seen["weight"], seen["labels"]) if y == k}
        assert len(sizes) == 1 and min(sizes) > 1


def test_text_ids(spark):
    texts = ["good day", "vile grub"] * 200
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)] + [(None, "vile grub")], "name string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(400)], "name string, toxic int")
    got = toxicity.toxicity(docs, labels, "name").collect()
    assert all(r.predicted == (1 if r.name is None else int(r.name[1:]) % 2) for r in got) and len(got) == 401


# languages

def plain_buckets(text):
    counts, codes, wide = Counter(), [ord(c) for c in text.lower()], 0xFFFFFFFF
    factors = [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D]
    for i in range(len(codes)):
        h = 0
        for n, factor in enumerate(factors):
            if i + n < len(codes):
                h = (h + codes[i + n]) * factor & wide
                h ^= h >> 15
                counts[(h * factors[0] & wide) >> 32 - language_id.BITS] += 1
    return counts


def plain_features(text, idf):
    x = {b: n * idf[b] for b, n in plain_buckets(text).items()}
    size = math.sqrt(sum(v * v for v in x.values())) or 1.0
    return {**{b: v / size for b, v in x.items()}, language_id.BUCKETS: 1.0}


def plain_softmax(z):
    e = [math.exp(v - max(z)) for v in z]
    return [v / sum(e) for v in e]


def test_grams_of_texts():
    texts = ["", "a", "ab", "Straße", "добрый день", "a" * 50, "x\U0001f600y"]
    for text, (at, n) in zip(texts, language_id.bucket_counts(texts)):
        assert dict(zip(at.tolist(), n.tolist())) == plain_buckets(text)


def test_leader_followed_number_by_number():
    texts = [("x", "abc abd"), ("y", "xyz xya"), ("z", "mno ab"), ("x", "abba"), ("y", "zyx")] * 3
    idf = 1 + np.arange(language_id.BUCKETS) % 7 / 7
    alpha, beta, l1, l2, epochs, batch, seed = 0.5, 1.0, 0.05, 0.01, 3, 4, 3
    rows = [(name, *next(language_id.bucket_counts([t]))) for name, t in texts]
    model = language_id.fit(rows, idf, alpha, beta, l1, l2, epochs, batch, seed)

    names, rng = ["x", "y", "z"], np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    learn = order[len(texts) // 5 :]
    ready = [(names.index(name), plain_features(t, idf)) for name, t in texts]
    z, n, w = defaultdict(float), defaultdict(float), defaultdict(float)
    for _ in range(epochs):
        for start in range(0, len(learn), batch):
            g = defaultdict(float)
            for i in learn[start : start + batch]:
                y, x = ready[i]
                p = plain_softmax([sum(v * w[b, k] for b, v in x.items()) for k in range(3)])
                for b, v in x.items():
                    for k in range(3):
                        g[b, k] += v * (p[k] - (k == y))
            for c, v in g.items():
                sigma = (math.sqrt(n[c] + v * v) - math.sqrt(n[c])) / alpha
                z[c] += v - sigma * w[c]
                n[c] += v * v
                w[c] = 0.0 if abs(z[c]) <= l1 else -(z[c] - math.copysign(l1, z[c])) / ((beta + math.sqrt(n[c])) / alpha + l2)
        rng.shuffle(learn)
    want = np.zeros_like(model.weights)
    for (b, k), v in w.items():
        want[b, k] = v
    assert model.languages == names
    np.testing.assert_allclose(model.weights, want, atol=1e-9)
    assert np.count_nonzero(want) < sum(len(x) for _, x in ready) * 3


def test_predictions_document_by_document(spark):
    said = {"en": "the cat and the dog are here", "de": "der hund und die katze sind hier", "fr": "le chat et le chien sont ici"}
    rows = [(i, " ".join(np.random.default_rng(i).permutation(t.split())), lang) for i, (lang, t) in enumerate(list(said.items()) * 40)]
    rows += [(900, "the CHAT und", None), (901, "", "en"), (902, None, "de"), (903, "123 456", "fr"), (904, "katze " * 3000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    got = {r.doc_id: r for r in language_id.language_id(docs).collect()}
    for i, text, _ in rows:
        if not any(c.isalpha() for c in text or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        x = plain_features(text, model.idf)
        p = plain_softmax([sum(v * model.weights[b, k] for b, v in x.items()) / model.temperature for k in range(3)])
        assert got[i].score == pytest.approx(max(p), abs=1e-9)
        assert got[i].lang_pred == model.languages[int(np.argmax(p))]
    learnt = [t for i, t, lang in rows if lang and not got[i].held_out]
    df = Counter(b for t in learnt for b in plain_buckets(t or ""))
    some = list(df)[:300]
    assert model.idf[some] == pytest.approx([math.log((1 + len(learnt)) / (1 + df[b])) + 1 for b in some])
