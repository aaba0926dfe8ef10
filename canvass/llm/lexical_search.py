"""Ranked lexical search over bit-sliced Bloom signatures.

``build_index`` writes the documents once, in blocks of similar length. Each
document has a Bloom signature of its terms, one entry for every step of
``STEPS`` that a term's count reaches; a block holds these signatures sliced by
bit, so that a slice is a bitmap over the block's documents. Signatures have
eight to sixteen bits an entry, in a length common to the block, however long
its documents are. Beside the slices stand the exact counts of the block.

A search intersects the slices of each query term. The bitmaps show a term in
more documents than hold it but miss none, and a step whose bitmap is clear
bounds the count. The bitmaps weighted by the terms' weights, summed and
multiplied by what a step can add in a document of that length, bound every
score from above. Documents whose bound is below the k-th exact score that the
task has seen, or equals it at a larger id, are out; all others are scored
exactly, best bound first.

Queries go to the tasks in blocks of at most ``QUERY_TERMS`` different terms,
two passes over the index each: one adds up document frequencies (of the
block's terms only), one searches. A task gives out at most k rows a query.

A null text has no terms, neither has one without letters and digits; such
documents are never found and not counted, and such queries find nothing. Very
long texts are read in pieces and weaken no other document's bound. Every row
is a document or query of its own, whatever its id; ties go to the smaller id,
null last. Equal texts tie. Tables without rows give none. Columns beyond id and
text pass unseen.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from canvass.llm.batches import mixed
from canvass.llm.common import stored
from canvass.llm.ranking import Best, ranked
from canvass.session import scratch_path

#: Counts at which a term gets a further entry.
STEPS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64])
#: Slices per entry.
HASHES = 3
#: Bits of a signature per entry of the largest document its block may hold.
BITS_PER_ENTRY = 8
#: Text and documents that a task gathers before it forms blocks, and bytes of a block's slices.
GATHERED_BYTES, GATHERED_DOCS, SLICE_BYTES = 16_000_000, 8192, 2_000_000
#: Different terms in a block of queries, as long as it holds more than one query.
QUERY_TERMS = 20_000
#: Terms whose slices are intersected at once, and documents scored between two looks at the bounds.
AT_ONCE, SCORED = 512, 64
_PIECE = 4_000_000

#: ASCII letters in lower case and digits stand for themselves, other ASCII separates; all bytes of other characters belong to terms.
_LETTERS = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def term_counts(text: bytes | None) -> Counter:
    """How often each term occurs in a text in UTF-8."""
    text = (text or b"").translate(_LETTERS)
    if len(text) <= _PIECE:
        return Counter(text.split())
    found, at = Counter(), 0
    while at < len(text):
        end = text.find(b" ", at + _PIECE)
        end = len(text) if end < 0 else end
        found.update(text[at:end].split())
        at = end
    return found


def _hashes(terms: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=8).digest() for t in terms), "<u8")


def _slices_of(hashes: np.ndarray, step: np.ndarray | int, bits: int) -> np.ndarray:
    """The slices (entries × HASHES) of entries of terms at steps; ``bits`` is a power of two."""
    entry = mixed(hashes + (np.asarray(step, np.uint64) << np.uint64(56)))
    return np.stack([mixed(entry + np.uint64(j)) & np.uint64(bits - 1) for j in range(HASHES)], axis=-1).astype(np.int64)


INDEX = "docs int, tokens long, bits int, ids array<{id}>, lengths binary, slices binary, vocabulary binary, holders binary, starts binary, terms binary, counts binary"


class _Gathered:
    """Documents on their way into blocks: term numbers and counts in arrays."""

    def __init__(self):
        self.numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.ids, self.terms, self.counts, self.bytes = [], [], [], 0

    def add(self, i: object, text: bytes | None) -> None:
        found = term_counts(text)
        if found:
            self.ids.append(i)
            self.terms.append(np.fromiter(map(self.numbers.__getitem__, found), np.int32, len(found)))
            self.counts.append(np.fromiter(found.values(), np.int64, len(found)))
            self.bytes += len(text)

    def full(self) -> bool:
        return self.bytes >= GATHERED_BYTES or len(self.ids) >= GATHERED_DOCS

    def blocks(self) -> Iterator[list]:
        """Index rows: by size of the signatures, then in the order given."""
        vocabulary = list(self.numbers)
        hashes = _hashes(vocabulary)
        classes = defaultdict(list)
        for k, counts in enumerate(self.counts):
            entries = int(np.searchsorted(STEPS, counts, "right").sum())
            classes[(entries - 1).bit_length()].append(k)
        for size, members in sorted(classes.items()):
            bits = max(64, BITS_PER_ENTRY << size)
            most = max(8, 8 * SLICE_BYTES // bits)
            for at in range(0, len(members), most):
                yield self._block(members[at : at + most], bits, vocabulary, hashes)

    def _block(self, members: list[int], bits: int, vocabulary: list[bytes], hashes: np.ndarray) -> list:
        sizes = np.array([len(self.terms[k]) for k in members])
        starts = np.concatenate(([0], np.cumsum(sizes)))
        own, terms = np.unique(np.concatenate([self.terms[k] for k in members]), return_inverse=True)
        counts = np.concatenate([self.counts[k] for k in members])
        docs = np.repeat(np.arange(len(members), dtype=np.int32), sizes)
        table = np.zeros((bits, -(-len(members) // 8) * 8), bool)
        for step, least in enumerate(STEPS):
            here = np.flatnonzero(counts >= least)
            if not len(here):
                break
            for slices in _slices_of(hashes[own], step, bits).T:
                table[slices[terms[here]], docs[here]] = True
        holders, lengths = np.bincount(terms, minlength=len(own)), np.add.reduceat(counts, starts[:-1])
        packed = [a.astype(t).tobytes() for a, t in ((lengths, "<i8"), (np.packbits(table, axis=1), "u1"))]
        rest = [a.astype(t).tobytes() for a, t in ((holders, "<i4"), (starts, "<i8"), (terms, "<i4"), (counts, "<i8"))]
        return [len(members), int(lengths.sum()), bits, [self.ids[k] for k in members], *packed, b" ".join(vocabulary[k] for k in own), *rest]


def build_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per block of documents; it depends on no query."""
    schema = T.StructType.fromDDL(INDEX.format(id=docs.schema[id_col].dataType.simpleString()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, kind = _Gathered(), None

        def rows() -> Iterator[pa.RecordBatch]:
            types = [pa.int32(), pa.int64(), pa.int32(), pa.list_(kind), *[pa.binary()] * 7]
            for cells in gathered.blocks():
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types)], names=schema.names)

        for b in batches:
            kind = b.schema.field(0).type
            for i, text in zip(b.column(0), b.column(1)):
                gathered.add(i.as_py(), text.as_py())
                if gathered.full():
                    yield from rows()
                    gathered = _Gathered()
        if gathered.ids:
            yield from rows()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, schema)


class _Queries:
    """A block of queries: their terms, each with how often it is asked for."""

    def __init__(self, rows: list[tuple[object, Counter]]):
        self.ids = [i for i, _ in rows]
        numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.terms = [np.array([numbers[t] for t in c], np.int64) for _, c in rows]
        self.times = [np.array(list(c.values()), np.int64) for _, c in rows]
        self.vocabulary = list(numbers)
        self.hashes = _hashes(self.vocabulary)

    def weigh(self, n: int, holders: dict[int, int]) -> None:
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * holders.get(t, 0) + 1))) for t in range(len(self.vocabulary))], np.int64)
        self.weights = [weights[t] * times for t, times in zip(self.terms, self.times)]


def _frequencies(index: DataFrame, asked: _Queries) -> tuple[int, int, dict[int, int]]:
    """Documents, their terms with repeats, and how many documents hold each of the queries' terms."""
    vocabulary = asked.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, wanted = Counter(), {t: k for k, t in enumerate(vocabulary)}
        for row in _rows(batches):
            found[-1] += row["docs"]
            found[-2] += row["tokens"]
            for t, n in zip(bytes(row["vocabulary"]).split(b" "), np.frombuffer(row["holders"], "<i4").tolist()):
                if (k := wanted.get(t)) is not None:
                    found[k] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

    parts = index.select("docs", "tokens", "vocabulary", "holders").mapInArrow(run, "term long, n long")
    # as many rows as the block of queries has terms, and two
    total = {r.term: r.n for r in parts.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return total.pop(-1, 0), total.pop(-2, 0), total


def _lengths_factor(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of each document."""
    if 25 * int(lengths.max()) * n < 2**63:
        return 75 + (25 * lengths * n) // total
    return np.array([75 + 25 * int(x) * n // total for x in lengths], np.int64)


def _gain(counts: np.ndarray | int, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * counts) // (1000 * counts + 12 * m)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Index rows one at a time; binary cells are views into their batch."""
    for b in batches:
        for k in range(b.num_rows):
            yield {n: b.column(n)[k].as_buffer() if pa.types.is_binary(b.schema.field(n).type) else b.column(n)[k].as_py() for n in b.schema.names}


class _Block:
    """One row of the index, as a search reads it."""

    def __init__(self, row: dict, n: int, total: int):
        self.ids, self.bits = row["ids"], row["bits"]
        self.lengths = np.frombuffer(row["lengths"], "<i8")
        self.slices = np.frombuffer(row["slices"], "u1").reshape(self.bits, -1)
        self.m = _lengths_factor(self.lengths, n, total)
        self.row = row
        self.exact = None

    def bounds(self, asked: _Queries) -> np.ndarray:
        """What each query's score can be at most (queries × documents)."""
        docs = len(self.ids)
        out = np.zeros((len(asked.ids), docs), np.int64)
        alive = np.arange(len(asked.vocabulary))
        maps = np.full((len(alive), self.slices.shape[1]), 255, np.uint8)
        before = np.zeros(docs, np.int64)
        for step in range(len(STEPS)):
            kept = []
            for at in range(0, len(alive), AT_ONCE):
                some = alive[at : at + AT_ONCE]
                maps[some] &= np.bitwise_and.reduce(self.slices[_slices_of(asked.hashes[some], step, self.bits)], axis=1)
                kept.append(some[maps[some].any(axis=1)])
            alive = np.concatenate(kept) if kept else alive[:0]
            if not len(alive):
                break
            # a count that reaches this step and not the next is at most one below the next, and never above the length
            upper = self.lengths if step + 1 == len(STEPS) else np.minimum(STEPS[step + 1] - 1, self.lengths)
            gain = _gain(upper, self.m)
            live = np.zeros(len(asked.vocabulary), bool)
            live[alive] = True
            for q, (terms, weights) in enumerate(zip(asked.terms, asked.weights)):
                here = live[terms]
                if here.any():
                    found = np.unpackbits(maps[terms[here]], axis=1, count=docs)
                    # weights and their sums are whole numbers far below 2**53
                    sums = (weights[here].astype(float) @ found.astype(float)).astype(np.int64)
                    out[q] += sums * np.maximum(gain - before, 0)
            before = np.maximum(gain, before)
        return out

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Exact scores, for weights by the block's own term numbers."""
        _, starts, terms, counts = self.exact
        sizes = starts[docs + 1] - starts[docs]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(starts[docs] - (ends - sizes), sizes)
        parts = weight[terms[at]] * _gain(counts[at], np.repeat(self.m[docs], sizes))
        return np.add.reduceat(parts, ends - sizes)

    def load(self) -> None:
        names = {t: k for k, t in enumerate(bytes(self.row["vocabulary"]).split(b" "))}
        self.exact = names, *(np.frombuffer(self.row[c], t) for c, t in (("starts", "<i8"), ("terms", "<i4"), ("counts", "<i8")))

    def search(self, asked: _Queries, best: list[Best]) -> int:
        """Bring ``best`` up to date; how many exact scores it took."""
        done, weight = 0, None
        bounds = self.bounds(asked)
        for q, bound in enumerate(bounds):
            mine = best[q]
            docs = np.flatnonzero(bound >= max(1, mine.floor()))
            if not len(docs):
                continue
            if self.exact is None:
                self.load()
            weight = np.zeros(len(self.exact[0]), np.int64) if weight is None else weight
            known = [(self.exact[0].get(asked.vocabulary[t]), w) for t, w in zip(asked.terms[q], asked.weights[q])]
            places = np.array([k for k, _ in known if k is not None], np.int64)
            weight[places] = [w for k, w in known if k is not None]
            docs = docs[np.argsort(-bound[docs], kind="stable")]
            for at in range(0, len(docs), SCORED):
                some = docs[at : at + SCORED]
                some = some[bound[some] >= max(1, mine.floor())]
                if len(mine.rows) == mine.k:
                    _, none, last = mine.rows[-1]
                    some = np.array([d for d in some if bound[d] > mine.floor() or none or (self.ids[d] is not None and self.ids[d] < last)], np.int64)
                if len(some):
                    found = self.scores(some, weight)
                    done += len(some)
                    some, found = some[found > 0], found[found > 0]
                    mine.add(found.tolist(), [self.ids[d] for d in some])
                elif bound[docs[at]] < mine.floor():
                    break
            weight[places] = 0
        return done


def _search(index: DataFrame, asked: _Queries, n: int, total: int, k: int, item_type: T.DataType) -> DataFrame:
    """At most k rows a query and task, ranked."""
    kind = index.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("ask", T.IntegerType()), T.StructField("doc", kind), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in asked.ids]
        for row in _rows(batches):
            _Block(row, n, total).search(asked, best)
        found = [(q, i, -s) for q, x in enumerate(best) for s, _, i in x.rows]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in found], to_arrow_type(f.dataType)) for j, f in enumerate(schema)], names=schema.names)

    names = index.sparkSession.createDataFrame(list(enumerate(asked.ids)), T.StructType([T.StructField("ask", T.IntegerType()), T.StructField("item", item_type)]))
    columns = ["bits", "ids", "lengths", "slices", "vocabulary", "starts", "terms", "counts"]
    found = ranked(index.select(columns).mapInArrow(run, schema), "doc", k)
    return found.join(F.broadcast(names), "ask")  # no more rows than the block of queries


def _in_blocks(items: DataFrame) -> Iterator[list[tuple[object, Counter]]]:
    held, terms = [], set()
    for r in items.toLocalIterator():
        found = term_counts(bytes(r.text or b""))
        if not found:
            continue
        if held and len(terms | found.keys()) > QUERY_TERMS:
            yield held
            held, terms = [], set()
        held.append((r.id, found))
        terms |= found.keys()
    if held:
        yield held


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, document, score): each item's k documents of the highest positive scores."""
    spark = docs.sparkSession
    index = stored(build_index(docs, id_col, text_col), "lexical")
    asked = items.select(F.col(item_col).alias("id"), F.col(item_text).cast("string").cast("binary").alias("text"))
    item_type, kind = items.schema[item_col].dataType, docs.schema[id_col].dataType
    out = T.StructType([T.StructField(item_col, item_type), T.StructField("rank", T.IntegerType()), T.StructField(id_col, kind), T.StructField("score", T.LongType())])
    path = scratch_path(spark, "ranked")
    spark.createDataFrame([], out).write.parquet(path)
    for block in _in_blocks(asked):
        queries = _Queries(block)
        n, total, holders = _frequencies(index, queries)
        if not n:
            break
        queries.weigh(n, holders)
        found = _search(index, queries, n, total, k, item_type)
        found.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score").write.mode("append").parquet(path)
    return spark.read.schema(out).parquet(path)


ORACLE = r"""
with d as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from documents
), tf as (
  select doc_id, term, count(*) as tf from d group by doc_id, term
), size as (
  select doc_id, cast(sum(tf) as bigint) as n from tf group by doc_id
), total as (
  select cast(count(*) as bigint) as N, cast(sum(n) as bigint) as L from size
), df as (
  select term, count(*) as df from tf group by term
), q as (
  select item_id, term, count(*) as times
  from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark)
  group by item_id, term
), w as (
  select term, cast(floor(1000 * ln(cast(2 * N + 2 as double) / cast(2 * df + 1 as double))) as bigint) as w from df, total
), s as (
  select q.item_id, tf.doc_id,
         cast(sum(q.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * size.n * total.N) // total.L)))) as bigint) as score
  from q join tf using (term) join w using (term) join size using (doc_id), total
  group by q.item_id, tf.doc_id
)
select item_id, cast(row_number() over r as integer) as rank, doc_id, score
from s where score > 0
window r as (partition by item_id order by score desc, doc_id)
qualify row_number() over r <= 20
"""
