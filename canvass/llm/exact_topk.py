"""Exact top-k by inner product: branch and bound over vectors stored by dimension.

``vertical`` writes the vectors as blocks in which every dimension is one
contiguous run, with the mass (sum of squares) that each vector has left after
every stretch of dimensions. A search adds up inner products stretch by
stretch. After each, a vector's score is at most its partial sum plus the
product of what remains of both lengths (Cauchy and Schwarz); vectors that no
query of a small group can still use are left behind and the rest is compacted.
What a task has found so far is the threshold of its next block.

Queries go to the tasks in blocks of at most ``QUERY_BYTES``, one pass over the
vertical table each, so neither the driver nor a task holds more of them than
that. Every task gives out at most k rows a query, which Spark ranks.

Components count as floor(scale * x). Sums are exact: in doubles while no
product can pass 2**52, in whole numbers of any size beyond (a score outside 64
bits is set to the nearest end). Vectors that are null or hold a null, NaN or
infinite component take no part; an empty vector scores 0 with every other one,
and a vector shorter than another counts as filled up with zeros. A vector is
only kept from meeting itself: rows of equal ids or equal vectors are rows of
their own. Ties go to the smaller id, null ids last; a row without id is a
candidate but no query. Tables without rows give none. Columns beyond id and
vector pass unseen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.llm.common import stored
from canvass.llm.ranking import Best, ranked
from canvass.session import scratch_path

#: Vectors of a block, and bytes of its components at most.
BLOCK_ROWS, BLOCK_BYTES = 4096, 8_000_000
#: Bytes of queries that travel with a pass over the vertical table.
QUERY_BYTES = 8_000_000
#: Dimensions added between two looks at the bounds.
STRETCH = 16
#: Queries that share a compacted list of survivors.
TOGETHER = 16
#: Magnitude below which sums of products in doubles are exact.
_EXACT = 2.0**52
_LONG = (-(2**63), 2**63 - 1)

BLOCKS = "part int, number int, rows int, dims int, wide boolean, ids array<{id}>, asks array<boolean>, columns binary, texts array<string>"


def _whole(vectors: list, scale: float) -> tuple[list[int], np.ndarray | list]:
    """Which vectors take part, and their components as whole numbers: a float matrix, or lists where doubles lose digits."""
    kept, cells = [], []
    for k, v in enumerate(vectors):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append(k)
        cells.append(v)
    width = max(map(len, cells), default=0)
    full = np.zeros((len(cells), width))
    for row, v in zip(full, cells):
        row[: len(v)] = v
    with np.errstate(over="ignore"):
        full = np.floor(full * scale)
    return kept, full


def vertical(rows: DataFrame, id_col: str, vector_col: str, asks: Column, scale: float) -> DataFrame:
    """Blocks of vectors by dimension, for a table whose rows satisfying ``asks`` are queries."""
    kind = rows.schema[id_col].dataType
    chosen = rows.select(F.col(id_col).alias("id"), F.coalesce(asks & F.col(id_col).isNotNull(), F.lit(False)).alias("ask"), F.col(vector_col).cast("array<double>").alias("v"))
    schema = T.StructType.fromDDL(BLOCKS.format(id=kind.simpleString()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids, asked, vectors, size, kinds = [], [], [], 0, None

        def block() -> pa.RecordBatch:
            kept, full = _whole(vectors, scale)
            huge = not np.isfinite(full).all() or np.abs(full).max(initial=0) ** 2 * max(1, full.shape[1]) >= _EXACT
            texts = [" ".join(str(math.floor(scale * x) if abs(x) < 1e300 else int(x) * int(scale)) for x in vectors[k]) for k in kept] if huge else None
            cells = [part, number, len(kept), full.shape[1], bool(huge), [ids[k] for k in kept], [asked[k] for k in kept], None if huge else full.T.astype("<f8").tobytes(), texts]
            types = [pa.int32()] * 4 + [pa.bool_(), pa.list_(kinds), pa.list_(pa.bool_()), pa.binary(), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types)], names=schema.names)

        for b in batches:
            kinds = b.schema.field(0).type
            for i, a, v in zip(*(b.column(j).to_pylist() for j in range(3))):
                ids.append(i)
                asked.append(a)
                vectors.append(v)
                size += 8 * len(v or ())
                if len(ids) >= BLOCK_ROWS or size >= BLOCK_BYTES:
                    yield block()
                    ids, asked, vectors, size, number = [], [], [], 0, number + 1
        if ids:
            yield block()

    return chosen.mapInArrow(run, schema)


def _matrix(wide: bool, columns: bytes | None, texts: list | None, rows: int, dims: int) -> np.ndarray:
    """A block's components, dimensions first: doubles, or Python integers where those are too small."""
    if not wide:
        return np.frombuffer(columns, "<f8").reshape(dims, rows)
    out = np.zeros((dims, rows), object)
    for k, t in enumerate(texts):
        v = [int(x) for x in t.split()]
        out[: len(v), k] = v
    return out


def _queries(blocks: DataFrame) -> DataFrame:
    """(id, part, number, place, wide, cells): the queries' rows."""
    kind = blocks.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("id", kind), *T.StructType.fromDDL("part int, number int, place int, cells binary, digits string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = b.schema.field("ids").type.value_type
            for r in b.to_pylist():
                places = [k for k, a in enumerate(r["asks"]) if a]
                m = None if r["wide"] else _matrix(False, r["columns"], None, r["rows"], r["dims"])
                cells = [
                    pa.array([r["ids"][k] for k in places], kinds),
                    *(pa.array([r[n]] * len(places), pa.int32()) for n in ("part", "number")),
                    pa.array(places, pa.int32()),
                    pa.array([None if m is None else m[:, k].tobytes() for k in places], pa.binary()),
                    pa.array([r["texts"][k] if r["wide"] else None for k in places], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(cells, names=schema.names)

    return blocks.select("part", "number", "rows", "dims", "wide", "ids", "asks", "columns", "texts").mapInArrow(run, schema)


class _Asked:
    """A block of queries, ordered so that neighbours resemble each other."""

    def __init__(self, rows: list):
        vectors = [[int(x) for x in r.digits.split()] if r.digits is not None else np.frombuffer(r.cells, "<f8") for r in rows]
        self.wide = any(isinstance(v, list) for v in vectors)
        self.dims = max(map(len, vectors), default=0)
        self.cells = np.zeros((len(rows), self.dims), object if self.wide else float)
        for k, v in enumerate(vectors):
            self.cells[k, : len(v)] = [int(x) for x in v] if self.wide else v
        order = np.arange(len(rows))
        if not self.wide and len(rows) > 2 * TOGETHER:
            pivots = self.cells[:: max(1, math.isqrt(len(rows)))]
            order = np.argsort((self.cells @ pivots.T).argmax(axis=1), kind="stable")
        self.cells = self.cells[order]
        self.ids = [rows[k].id for k in order]
        self.place = {(rows[k].part, rows[k].number, rows[k].place): n for n, k in enumerate(order)}
        self.bytes = sum(8 * len(v) for v in vectors)


def _search_block(asked: _Asked, best: list[Best], part: int, number: int, m: np.ndarray, ids: list) -> int:
    """Bring ``best`` up to date with one block; the number of products that were added up."""
    rows = m.shape[1]
    own = {n: place for (p, b, place), n in asked.place.items() if p == part and b == number}
    dims = max(asked.dims, len(m))
    exact = asked.wide or m.dtype == object
    if not exact:
        most = np.abs(asked.cells).max(initial=0) * np.abs(m).max(initial=0) * max(1, dims)
        exact = most >= _EXACT
    if exact:
        whole = np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
        shared = min(asked.dims, len(m))
        for n in range(len(asked.ids)):
            sums = [sum(int(a) * b for a, b in zip(asked.cells[n, :shared], whole[:shared, j])) for j in range(rows) if own.get(n) != j]
            best[n].add([min(max(s, _LONG[0]), _LONG[1]) for s in sums], [i for j, i in enumerate(ids) if own.get(n) != j])
        return rows * len(asked.ids) * dims
    done = 0
    shared = min(asked.dims, len(m))
    for first in range(0, len(asked.ids), TOGETHER):
        group = range(first, min(first + TOGETHER, len(asked.ids)))
        q = asked.cells[first : group.stop]
        order = np.argsort(-(q[:, :shared] ** 2).sum(axis=0), kind="stable")
        q, left = q[:, order], np.arange(rows)
        floors = np.array([best[n].floor() for n in group])
        x = m[order]
        q_rest = np.sqrt(np.cumsum((q**2)[:, ::-1], axis=1)[:, ::-1])
        mass = (x**2).sum(axis=0)
        sums = np.zeros((len(group), rows))
        for at in range(0, shared, STRETCH):
            stretch = x[at : at + STRETCH]
            sums += q[:, at : at + STRETCH] @ stretch
            done += sums.size * len(stretch)
            if at + STRETCH >= shared:
                break
            mass = mass - (stretch**2).sum(axis=0)
            # masses are whole numbers below 2**52, roots are rounded by less than the added share
            bound = sums + np.outer(q_rest[:, at + STRETCH], np.sqrt(np.maximum(mass, 0))) * (1 + 1e-9)
            stay = (bound >= floors[:, None]).any(axis=0)
            if not stay.all():
                left, x, mass, sums = left[stay], x[:, stay], mass[stay], sums[:, stay]
        for n, row, floor in zip(group, sums, floors):
            hit = np.flatnonzero(row >= floor)
            if n in own:
                hit = hit[left[hit] != own[n]]
            if len(hit) > 8 * best[n].k:
                # no more than k rows above the k-th score count, and those at that score by id
                cut = np.partition(row[hit], len(hit) - best[n].k)[len(hit) - best[n].k]
                hit = hit[row[hit] >= cut]
            if len(hit):
                best[n].add([int(s) for s in row[hit]], [ids[j] for j in left[hit]])
    return done


def _search(blocks: DataFrame, asked: _Asked, k: int) -> DataFrame:
    """At most k rows a query and task: (query_id, ask, vec, score)."""
    kind = blocks.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("ask", T.LongType()), T.StructField("vec", kind), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kinds = [Best(k) for _ in asked.ids], None
        for b in batches:
            kinds = b.schema.field("ids").type.value_type
            for r in b.to_pylist():
                _search_block(asked, best, r["part"], r["number"], _matrix(r["wide"], r["columns"], r["texts"], r["rows"], r["dims"]), r["ids"])
        if kinds is None:
            return
        found = [(n, -s, i) for n, x in enumerate(best) for s, _, i in x.rows]
        cells = [[asked.ids[n] for n, _, _ in found], [n for n, _, _ in found], [i for _, _, i in found], [s for _, s, _ in found]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, [kinds, pa.int64(), kinds, pa.int64()])], names=schema.names)

    return ranked(blocks.mapInArrow(run, schema), "vec", k)


def _in_blocks(queries: DataFrame) -> Iterator[list]:
    held, size = [], 0
    for r in queries.toLocalIterator():
        held.append(r)
        size += len(r.cells if r.digits is None else r.digits) + 100
        if size >= QUERY_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def exact_topk(rows: DataFrame, asks: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, id, score): the k rows with the highest inner products, for each row that satisfies ``asks``."""
    spark = rows.sparkSession
    blocks = stored(vertical(rows, id_col, vector_col, asks, scale), "vertical")
    kind = blocks.schema["ids"].dataType.elementType
    path = scratch_path(spark, "topk")
    out = T.StructType([T.StructField("query_id", kind), T.StructField("rank", T.IntegerType()), T.StructField(id_col, kind), T.StructField("score", T.LongType())])
    spark.createDataFrame([], out).write.parquet(path)
    for block in _in_blocks(_queries(blocks)):
        found = _search(blocks, _Asked(block), k)
        found.select("query_id", "rank", F.col("vec").alias(id_col), "score").write.mode("append").parquet(path)
    return spark.read.schema(out).parquet(path)


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as query_id, b.vec_id as vec_id,
         cast(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) as bigint) as score
  from v a join v b on a.vec_id <> b.vec_id
  where a.vec_id % 50 = 0
)
select query_id, cast(row_number() over w as integer) as rank, vec_id, score
from s
window w as (partition by query_id order by score desc, vec_id)
qualify row_number() over w <= 5
"""
