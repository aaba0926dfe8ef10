"""Secrets in documents, through a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived:
literal stretches demand their trigrams, alternatives are joined by ``or``,
everything else demands nothing. Each task indexes its documents in segments of
bounded size (postings: trigram to documents of the segment, for the trigrams
that some query names), intersects and unites the postings as the queries say,
and runs a rule's expression over its candidate documents only. A rule without
mandatory trigrams scans every document.

The index folds ASCII letters to lower case, so a query never misses a match in
another case; the expression itself decides. Segments live inside a task: no
shuffle, bounded memory, nothing to lose with an executor.

Offsets are code points, end exclusive. Nulls: a null text is empty. Repeated
rows are scanned alike. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import re._parser as sre
from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm.batches import chunks, joined


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int = 0  #: the group whose length counts
    least: int = 1  #: shorter matches are dropped


def _either_case(words: list[str]) -> str:
    return "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words)


#: The base rules.
BASE = [
    Rule("assign", "(" + _either_case(["password", "passwd", "secret", "token", "api_?key"]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]+", 0, 32),
]
#: Public formats of further credentials.
MORE = [
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("google", "AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", "[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}"),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]

ANY = True  #: the query that every document passes
MOST_STRINGS = 64


def all_of(parts: list) -> object:
    parts = [p for p in dict.fromkeys(parts) if p is not ANY]
    return ANY if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def any_of(parts: list) -> object:
    parts = list(dict.fromkeys(parts))
    return ANY if not parts or ANY in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _demand(strings: set[str]) -> object:
    return any_of([all_of([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(items) -> tuple[set[str] | None, object]:
    """The strings an expression stands for exactly, if they are few; else None and the query it demands."""
    open_, query, exact = {""}, [], True

    def cut() -> None:
        nonlocal open_, exact
        query.append(_demand(open_))
        open_, exact = {""}, False

    def extend(strings: set[str]) -> None:
        nonlocal open_
        if len(open_) * len(strings) > MOST_STRINGS:
            cut()
        open_ = {a + b for a, b in product(open_, strings)}

    for op, arg in items:
        name = str(op)
        if name == "LITERAL" and arg < 128:
            extend({chr(arg).lower()})
        elif name == "IN" and all(str(o) == "LITERAL" and a < 128 for o, a in arg) and len({chr(a).lower() for _, a in arg}) <= 5:
            extend({chr(a).lower() for _, a in arg})
        elif name == "AT":
            continue
        elif name == "SUBPATTERN" or name == "BRANCH":
            found = [_walk(alt) for alt in (arg[1] if name == "BRANCH" else [arg[-1]])]
            if all(s is not None for s, _ in found) and sum(len(s) for s, _ in found) <= MOST_STRINGS:
                extend(set().union(*(s for s, _ in found)))
            else:
                cut()
                query.append(any_of([q if s is None else _demand(s) for s, q in found]))
        elif name == "MAX_REPEAT":
            low, high, sub = arg
            strings, inner = _walk(sub)
            if strings is not None and (low, high) == (0, 1):
                extend(strings | {""})
            elif strings is not None and low >= 1 and low * len(strings) <= 8:
                for _ in range(low):
                    extend(strings)
                if high != low:
                    cut()
            else:
                cut()
                if low >= 1:
                    query.append(_demand(strings) if strings is not None else inner)
        else:
            cut()
    if exact:
        return open_, _demand(open_)
    return None, all_of([*query, _demand(open_)])


def trigram_query(pattern: str) -> object:
    """A trigram, ("and" | "or", parts), or ANY: what every text with a match must hold, letters in lower case."""
    return _walk(sre.parse(pattern))[1]


def trigrams(query: object) -> set[str]:
    if query is ANY:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


class Segment:
    """Postings of the wanted trigrams over a few documents."""

    def __init__(self, texts: list[str], wanted: list[str], table: np.ndarray):
        data, starts = joined([t.encode("utf-8", "surrogatepass").lower() for t in texts])
        wide = data.astype(np.int32)
        code = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:] if len(wide) > 2 else wide[:0]
        number = table[code]
        at = np.flatnonzero(number)
        doc, number = np.searchsorted(starts, at, "right") - 1, number[at]
        self.size = len(texts)
        self.postings = {w: np.unique(doc[number == k + 1]) for k, w in enumerate(wanted)}

    def candidates(self, query: object) -> np.ndarray:
        if query is ANY:
            return np.arange(self.size)
        if isinstance(query, str):
            return self.postings[query]
        found = [self.candidates(q) for q in query[1]]
        for other in found[1:]:
            found[0] = np.intersect1d(found[0], other, True) if query[0] == "and" else np.union1d(found[0], other)
        return found[0]


def index_table(wanted: list[str]) -> np.ndarray:
    table = np.zeros(1 << 24, np.uint8)
    for k, w in enumerate(wanted):
        a, b, c = w.encode()
        table[(a << 16) | (b << 8) | c] = k + 1
    return table


SCHEMA = "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_more long"


def scan_texts(texts: list[str], rules: list[Rule], queries: list, wanted: list[str], table: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Spans (start, rule number, end) of each text, in order."""
    segment = Segment(texts, wanted, table)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, query) in enumerate(zip(rules, queries)):
        run = re.compile(rule.pattern)
        for i in segment.candidates(query):
            for m in run.finditer(texts[i]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found[i].append((m.start(), k, m.end()))
    return [sorted(f) for f in found]


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: list[Rule] = MORE) -> DataFrame:
    """One row per document: id, counts of the base kinds, hash of the base spans, all spans, count of the other spans."""
    rules = BASE + list(more)
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted(set().union(*map(trigrams, queries)))
    if len(wanted) > 255:
        raise ValueError("the rules name more than 255 trigrams")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = index_table(wanted)
        for ids, texts in chunks(batches):
            out = []
            for i, spans in zip(ids, scan_texts(texts, rules, queries, wanted, table)):
                said = [f"{rules[k].kind}:{a}:{b}" for a, k, b in spans]
                base = ",".join(s for s, (_, k, _) in zip(said, spans) if k < len(BASE))
                counts = [sum(k == n for _, k, _ in spans) for n in range(len(BASE))]
                out.append((i, *counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(said), len(said) - sum(counts)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], names=NAMES)

    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, SCHEMA)
    return found.withColumnRenamed("id", id_col)


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
