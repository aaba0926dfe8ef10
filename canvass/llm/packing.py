"""Best-fit packing of tokenised documents into sequences of bounded length.

1. **Tokens.** A document is its token ids and a closing 0, cut into pieces of
   at most ``budget`` ids. Tasks keep a bounded table of words they have met,
   because encoding a word is far dearer than looking it up.
2. **Range-sorted documents and gaps.** Lengths are whole numbers up to the
   budget, so pieces sorted by length fall into at most ``budget`` runs of
   equal length and open sequences into as many runs of equal gaps, however
   many rows they stand for. The runs' sizes come from one aggregation.
3. **Sweeps.** Bulk-synchronous best fit over the runs, longest pieces first:
   a superstep offers all pieces of a length to the successor, the smallest gap
   that holds them; all sequences of that run are filled at once, pieces in
   conflict for a sequence are ordered by rank, gaps are updated, and what is
   left moves on to the next successor until no gap fits and new sequences
   open. This is exact best-fit decreasing. It yields placements
   (length, ranks from–to, first sequence, offset): a few per length.
4. **Placement.** Every piece gets its rank among equals from its task's own
   count and the counts of the tasks before, a join on (task, length) without
   any global sort, and reads its sequence and offset off the placements.

So documents cross the network as narrow rows only, no group of equal lengths
meets in one task, and what the driver sees is bounded by the budget.

Nulls: a null text is empty and becomes a piece of its closing 0 alone. A null
id is packed like any other. Repeated rows are packed each. An empty table
gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canvass.llm.batches import chunks
from canvass.llm.common import stored

BUDGET = 2048
#: Words that a Python worker remembers; beyond, it starts anew.
WORDS_KEPT = 700_000
_ENDINGS = ".,;:!?|%&$*#()[]{}\"+-=/<>@^_~`"
CLOSING = b"\0\0\0\0"
#: str.split() takes these for white space, the tokenizer gives them ids.
_CONTROLS = "\x1c\x1d\x1e\x1f"
_WORDS = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class Encoder:
    """Token ids, as little-endian bytes, of whole texts for a tokenizer that never joins text across white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.letters = _byte_letters()

    def _slow(self, word: str) -> bytes:
        return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """A word of Latin letters with final punctuation is one or two units for the model; others take the tokenizer's whole way."""
        core = word.rstrip(_ENDINGS)
        if core.isalpha() and max(core) <= "\xff" and unicodedata.is_normalized("NFC", core):
            units = [core.lower(), word[len(core) :]]
            out = b""
            for u in units:
                if u:
                    got = self.known.get(u)
                    if got is None:
                        spelt = "".join(self.letters[b] for b in u.encode())
                        got = self.known[u] = np.array([t.id for t in self.whole.model.tokenize(spelt)], "<u4").tobytes()
                    out += got
            return out
        return self._slow(word)

    def encode(self, text: str) -> bytes:
        words = _WORDS.findall(text) if any(c in text for c in _CONTROLS) else text.split()
        found = list(map(self.known.get, words))
        if None in found:
            if len(self.known) > WORDS_KEPT:
                self.known.clear()
            for i, ids in enumerate(found):
                if ids is None:
                    ids = self.known.get(words[i])
                    if ids is None:
                        ids = self.known[words[i]] = self._word(words[i])
                    found[i] = ids
        return b"".join(found)


def _byte_letters() -> list[str]:
    """The public byte-to-letter table of byte-level vocabularies: printable bytes stand for themselves, others for letters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


PIECES = "id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str | None, budget: int) -> DataFrame:
    """Pieces with their task and their number among the task's pieces of the same length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(tokenizer or default_tokenizer()), TaskContext.get().partitionId()
        met = np.zeros(budget + 1, np.int64)
        for ids, texts in chunks(batches):
            out = []
            for i, text in zip(ids, texts):
                data = enc.encode(text) + CLOSING
                for k, at in enumerate(range(0, len(data), 4 * budget)):
                    part = data[at : at + 4 * budget]
                    n = len(part) // 4
                    out.append((i, k, at // 4, n, zlib.crc32(part), task, met[n]))
                    met[n] += 1
            columns = [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()])]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PIECES.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECES)


Placement = tuple[int, int, int, int, int, int]


def sweep(runs: dict[int, int], budget: int = BUDGET) -> list[Placement]:
    """Best fit over runs (length to count): placements (length, first rank, count, first sequence, pieces a sequence, offset)."""
    gaps: list[int] = []  # sizes of the open gaps, in order
    open_: dict[int, list[tuple[int, int]]] = {}  # gap to (first sequence, count)
    placed: list[Placement] = []
    fresh = 0

    def leave(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in open_:
                open_[gap] = []
                insort(gaps, gap)
            open_[gap].append((first, count))

    for length in sorted(runs, reverse=True):
        left, rank = runs[length], 0
        while left:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, count = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap], gaps[at]
            else:
                gap, first, count = budget, fresh, -(-left // (budget // length))
                fresh += count
            each = gap // length
            full = min(count, left // each)
            if full:
                placed.append((length, rank, full * each, first, each, budget - gap))
                leave(gap - each * length, first, full)
                left, rank = left - full * each, rank + full * each
            if full < count and left:
                placed.append((length, rank, left, first + full, left, budget - gap))
                leave(gap - left * length, first + full, 1)
                leave(gap, first + full + 1, count - full - 1)
                left = 0
            elif full < count:
                leave(gap, first + full, count - full)
    return placed


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, budget: int = BUDGET) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = stored(pieces(docs, id_col, text_col, tokenizer, budget), "pieces")
    own = rows.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = stored(own.withColumn("before", F.coalesce(before, F.lit(0).cast("long"))), "ranks")
    # at most ``budget`` rows
    runs = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed = np.array(sorted(sweep(runs, budget)), np.int64).reshape(-1, 6)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (3, 5))
            key = length.astype(np.float64) * 2.0**40 + rank
            at = np.searchsorted(placed[:, 0].astype(np.float64) * 2.0**40 + placed[:, 1], key, "right") - 1
            _, first, _, sequence, each, offset = placed[at].T
            into = rank - first
            out = [*(batch.column(k) for k in range(5)), pa.array(sequence + into // each), pa.array(offset + into % each * length)]
            yield pa.RecordBatch.from_arrays(out, names=NAMES)

    ranked = rows.join(offsets.drop("n"), ["task", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)


NAMES = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
