"""Near-duplicates by BagMinHash signatures over weighted word shingles.

A document is the multiset of its runs of five words (ASCII white space
separates words, letters are lower-cased; a shorter text is one run). Two
documents are near-duplicates if the weighted Jaccard similarity of their
multisets, sum of minima over sum of maxima, is at least 0.8. Classes are the
connected components of such links.

**Signatures.** The weight axis of every shingle is cut at powers of two. Each
interval carries a Poisson process of points, generated from the shingle's hash
in ascending order with a rate equal to the interval's width; a point has a
slot and a level on the weight axis, and counts only up to the shingle's
weight. A slot keeps its smallest point, so two documents agree in a slot with
exactly their weighted Jaccard similarity. Points are generated only while they
can still change a slot, and a weight w costs log w processes.

**Banding.** 24 bands of 5 slots miss a pair of similarity 0.8 with
probability below 1e-4. Every bucket's members are verified against its most
central member, the one whose buckets are fullest, not against each other:
linear in rows, however large the bucket. Links make components. Texts that
buckets tie together without all being in one component get a second look: the
members outside the largest component are compared with all others by
signature, in blocks that deal the work out to many tasks, and pairs that agree
in 62 % of the slots (a pair of similarity 0.8 falls below that once in a
million) are verified unless their components have met. So no link is lost that
the bands found, and no task emits more links than it has members.

Texts with the same words collapse to one node first. Node, bucket and link
tables are cut in the shared folder.

Nulls: a null text is empty; a text without words has no shingle and is alone in
its class. Rows without id are compared like all others; such rows with the same
text are one document, and a class without any id has a null class_id and keeps
one of its documents. Ids of any type will do. Rows that repeat an id are one
document. Ties for the smallest id cannot arise; equal signatures are settled by
the multisets themselves. Very long texts are read whole, one at a time where
they are long. An empty table gives an empty result. Columns other than id and
text, whatever their names, pass unseen and leave ``keep_one`` as they came.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm.batches import chunks, joined, mixed, prefix_sums, range_hash, word_spans
from canvass.llm.common import keyed, stored, text_of, without
from canvass.llm.components import components

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 24, 5
SLOTS = BANDS * ROWS
AGREE = 0.62
#: Members outside the main component, and all members, that a task compares at a time.
BLOCK, CHUNK = 256, 1024

#: Characters whose shingles a task holds at a time, or one longer text.
PIECE = 700_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def bags(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Two hashes of each text's words, its distinct shingles' hashes in order, and their counts."""
    data, starts = joined([t.lower().encode("utf-8", "surrogatepass") for t in texts])
    begin, end, first = word_spans(data, starts)
    word = range_hash(prefix_sums(data), begin, end)
    run = word.copy()
    for k in range(1, SHINGLE):
        run = mixed(run[:-1] + _STEP) + word[k:] if len(run) > 1 else run[:0]
    sums = np.zeros(len(word) + 1, np.uint64)
    np.cumsum(mixed(word), out=sums[1:])
    for k in range(len(texts)):
        a, b = first[k], first[k + 1]
        n = b - a
        if n == 0:
            yield 0, 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)
            continue
        place = np.arange(1, n + 1, dtype=np.uint64) * _STEP
        one, two = (int(mixed(word[a:b] ^ (place + np.uint64(s))).sum()) for s in (1, 2))
        own = run[a : b - SHINGLE + 1] if n >= SHINGLE else np.array([one], np.uint64)
        yield one, two, *np.unique(own, return_counts=True)


def signature(shingle: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The smallest point of every slot."""
    h = np.full(SLOTS, np.inf)
    if not len(shingle):
        return h
    key, rate, limit, base = [], [], [], []
    for k in range(int(weight.max() - 1).bit_length() + 1):
        low = 0 if k == 0 else 1 << (k - 1)
        at = np.flatnonzero(weight > low)
        key.append(mixed(shingle[at] + np.uint64(k)))
        rate.append(np.full(len(at), float(max(1, low))))
        limit.append(weight[at])
        base.append(np.full(len(at), low))
    key, rate, limit, base = (np.concatenate(x) for x in (key, rate, limit, base))
    x, made = np.zeros(len(key)), 0
    many = int(min(64, max(1, np.ceil(4 * SLOTS / rate.sum()))))
    while len(key):
        r = mixed(key[:, None] + _STEP * np.arange(made + 1, made + many + 1, dtype=np.uint64))
        points = x[:, None] + np.cumsum(-np.log(((r >> np.uint64(32)).astype(np.float64) + 0.5) / 2.0**32), axis=1) / rate[:, None]
        counts = points < h.max()
        partial = limit < base + np.maximum(rate, 1)
        if partial.any():
            level = base[:, None] + 1 + np.floor((mixed(r) >> np.uint64(11)).astype(np.float64) / 2.0**53 * rate[:, None])
            counts &= level <= limit[:, None]
        np.minimum.at(h, ((r & np.uint64(0xFFFFFFFF)) % np.uint64(SLOTS)).astype(np.int64)[counts], points[counts])
        x, made, many = points[:, -1], made + many, 1 if many == 1 else min(64, 2 * many)
        on = x < h.max()
        key, rate, limit, base, x = (y[on] for y in (key, rate, limit, base, x))
    return h


def band_keys(h: np.ndarray) -> np.ndarray:
    """One hash per band, with the band's number in it."""
    out = np.arange(BANDS, dtype=np.uint64)
    for part in h.view(np.uint64).reshape(BANDS, ROWS).T:
        out = mixed(out + _STEP) + part
    return mixed(out)


def similarity(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> float:
    """Weighted Jaccard of two multisets with sorted elements."""
    if len(a) > len(b):
        a, na, b, nb = b, nb, a, na
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    hit = b[at] == a if len(b) else np.zeros(len(a), bool)
    low = np.minimum(na[hit], nb[at[hit]]).sum()
    total = na.sum() + nb.sum() - low
    return float(low / total) if total else 0.0


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in chunks(batches, PIECE):
        one, two, keys = [], [], []
        for a, b, shingle, weight in bags(texts):
            one.append(a)
            two.append(b)
            keys.append(band_keys(signature(shingle, weight)).view(np.int64) if len(shingle) else np.zeros(0, np.int64))
        longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (one, two)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *longs, pa.array(keys, pa.list_(pa.int64()))], names=["id", "one", "two", "keys"])


def _bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in chunks(batches, PIECE):
        found = list(bags(texts))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([f[2].view(np.int64) for f in found], pa.list_(pa.int64())), pa.array([f[3].astype(np.int32) for f in found], pa.list_(pa.int32()))],
            names=["node", "bag", "n"],
        )


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return np.split(flat, (at - at[0])[1:-1]) if len(column) else []


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = [_lists(batch.column(k)) for k in range(2, 6)]
        ok = np.array([similarity(a.view(np.uint64), na, b.view(np.uint64), nb) >= SIMILAR for a, na, b, nb in zip(*sides)], bool)
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok)) for k in (0, 1)], names=["u", "v"])


def verified(pairs: DataFrame, bag: DataFrame) -> DataFrame:
    """The pairs (u, v) that are similar enough."""
    left = bag.select(F.col("node").alias("u"), F.col("bag").alias("bu"), F.col("n").alias("nu"))
    right = bag.select(F.col("node").alias("v"), F.col("bag").alias("bv"), F.col("n").alias("nv"))
    return pairs.join(right, "v").join(left, "u").select("u", "v", "bu", "nu", "bv", "nv").mapInArrow(_similar, "u long, v long")


def _bridges(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between the components of some members outside the main one and those of a chunk of all members.

    Candidates are pairs whose signatures agree; the likeliest are verified
    first, and a pair whose components have met meanwhile needs no look.
    """
    left, right = (pdf[pdf["side"] == k].sort_values("node") for k in (0, 1))
    out: list[tuple[int, int]] = []
    if len(left) and len(right):
        sig = [np.stack([np.frombuffer(s, np.float64) for s in p["sig"]]) for p in (left, right)]
        same = np.zeros((len(left), len(right)), np.int16)
        for k in range(SLOTS):
            same += sig[0][:, k][:, None] == sig[1][:, k][None, :]
        (n, c, bag, times), (n2, c2, bag2, times2) = ([p[k].to_numpy() for k in ("node", "comp", "bag", "n")] for p in (left, right))
        once = right["outside"].to_numpy()[None, :] & (n[:, None] >= n2[None, :])  # two outside members meet in either order
        i, j = np.nonzero((same >= AGREE * SLOTS) & (c[:, None] != c2[None, :]) & ~once)
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        for k in np.argsort(-same[i, j], kind="stable"):
            x, y = i[k], j[k]
            u, v = top(c[x]), top(c2[y])
            if u != v and similarity(bag[x].view(np.uint64), times[x], bag2[y].view(np.uint64), times2[y]) >= SIMILAR:
                up[max(u, v)] = min(u, v)
                out.append((n[x], n2[y]))
    return pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def _resigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sigs = [signature(a.view(np.uint64), n).tobytes() for a, n in zip(_lists(batch.column(1)), _lists(batch.column(2)))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigs, pa.binary())], names=["node", "bag", "n", "sig"])


def _rest(pairs: DataFrame, comps: DataFrame, bag: DataFrame) -> DataFrame:
    """Links across components that the first ones left apart, among texts that buckets tie together.

    A neighbourhood is a component of the bucket pairs, similar or not. Its
    largest component of links is its main one; every member outside that is
    compared with all members, in blocks of bounded size.
    """
    around = components(pairs).select("node", F.col("comp").alias("around"))
    known = around.join(comps, "node", "left").select("node", "around", F.coalesce("comp", "node").alias("comp"))
    parts = stored(known.groupBy("around", "comp").agg(F.count(F.lit(1)).alias("n")), "parts")
    sizes = parts.groupBy("around").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all")).filter("all > most")
    split = known.join(sizes, "around").withColumn("outside", F.col("comp") != F.col("main"))
    split = split.withColumns({
        "blocks": F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int"),
        "chunks": F.ceil(F.col("all") / CHUNK).cast("int"),
    })
    spot = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    split = stored(split, "split")
    all_ = split.select("around", "node", "comp", "outside", upto("blocks").alias("block"), spot(F.col("chunks")).alias("chunk"), F.lit(1).alias("side"))
    out = split.filter("outside").select("around", "node", "comp", "outside", spot(F.col("blocks")).alias("block"), upto("chunks").alias("chunk"), F.lit(0).alias("side"))
    signed = stored(bag.join(split.select("node"), "node", "left_semi").select("node", "bag", "n").mapInArrow(_resigned, "node long, bag array<long>, n array<int>, sig binary"), "resigned")
    return all_.unionAll(out).join(signed, "node").groupBy("around", "block", "chunk").applyInPandas(_bridges, "u long, v long")


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: id, bare (see ``keyed``), class_id (the smallest id of its class), class_size, kept."""
    own = keyed(docs, id_col, text_col)
    source = own.select(F.col("key").alias("id"), "text")
    signed = stored(source.mapInArrow(_signed, "id long, one long, two long, keys array<long>"), "signatures")
    worded = signed.filter(F.size("keys") > 0)
    first = worded.groupBy("one", "two").agg(F.min("id").alias("node"))
    member = stored(worded.join(first, ["one", "two"]).select("id", "node", F.when(F.col("id") == F.col("node"), F.col("keys")).alias("keys")), "members")
    rows = member.filter("keys is not null").select("node", F.explode("keys").alias("key")).distinct()
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = stored(rows.join(sizes, "key"), "buckets")
    central = shared.groupBy("node").agg(F.sum("size").alias("score"))
    ranked = stored(shared.select("key", "node").join(central, "node"), "ranked")
    leaders = ranked.groupBy("key").agg(F.max_by("node", F.struct("score", -F.col("node"))).alias("leader"))
    apart = ranked.join(leaders, "key").filter("node <> leader")
    pairs = stored(apart.select(F.least("node", "leader").alias("u"), F.greatest("node", "leader").alias("v")).distinct(), "pairs")
    wanted = shared.select("node").distinct().hint("merge")  # the ids of most documents may be among them: never a side to broadcast
    bag = stored(source.join(wanted, source["id"] == wanted["node"], "left_semi").mapInArrow(_bagged, "node long, bag array<long>, n array<int>"), "bags")
    links = stored(verified(pairs, bag), "links")
    comps = components(links)
    more = stored(_rest(pairs, comps, bag), "bridges")
    across = more.join(comps.select(F.col("node").alias("u"), F.col("comp").alias("cu")), "u", "left").join(comps.select(F.col("node").alias("v"), F.col("comp").alias("cv")), "v", "left")
    bridges = components(across.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))).select(F.col("node").alias("c"), F.col("comp").alias("bridged"))
    whole = member.select("id", "node").distinct().join(comps, "node", "left").withColumn("c", F.coalesce("comp", "node"))
    placed = whole.join(bridges, "c", "left").select("id", F.coalesce("bridged", "c").alias("class_id")).groupBy("id").agg(F.min("class_id").alias("class_id"))
    out = own.select("key", "id", "bare").join(placed.withColumnRenamed("id", "placed"), F.col("key") == F.col("placed"), "left")
    out = stored(out.select("key", "id", "bare", F.coalesce("class_id", "key").alias("class")), "classes")
    first = [F.min("id").alias("class_id"), F.min(F.when(F.col("id").isNull(), F.col("key"))).alias("nameless"), F.count(F.lit(1)).alias("class_size")]
    heads = out.groupBy(F.col("class").alias("c")).agg(*first)
    found = out.join(heads, F.col("class") == F.col("c"))
    kept = F.when(F.col("id").isNotNull(), F.col("id") == F.col("class_id")).otherwise(F.col("class_id").isNull() & (F.col("key") == F.col("nameless")))
    return found.select("id", "bare", "class_id", "class_size", kept.alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, class_id (the smallest id of its class), class_size, kept (is it that one?)."""
    return _classes(docs, id_col, text_col).select(F.col("id").alias(id_col), "class_id", "class_size", "kept")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: the document with the smallest id of each class, with all its columns."""
    gone = _classes(docs, id_col, text_col).filter("not kept").select("id", "bare")
    bare = F.when(F.col(id_col).isNull(), F.sha2(text_of(text_col), 256))
    return without(docs, gone, id=F.col(id_col), bare=bare)
