"""Removal of byte strings that occurred before, by merged Burrows-Wheeler transforms.

Every byte of a text (UTF-8) that lies in a ``LENGTH``-byte string which also
starts earlier, in a smaller document id or at a smaller place of the same
document, is removed. Strings never cross documents and are judged on the input.

**Dealing out.** A window of ``LENGTH`` bytes is sent to the task of its anchor,
the 32-byte string in it with the smallest hash: equal windows have equal
anchors, so each task can decide alone. Windows that follow each other and share
an anchor travel as one segment, of which only hashes and places are sent.
Segments that occur once are done. Of equal segments all but the first are
removed whole: those that meet in one batch settle it before the shuffle, so a
passage that a third of all documents share sends one row a batch, and the
others stream through the anchor's task in sorted order. Only different segments
around a common anchor go on with their bytes. A window that two of them share
holds one of a few strings of ``NEAR`` bytes at fixed distances from the anchor;
segments none of whose strings has an equal among them share nothing and stay
out of the merge.

**Merging.** A task takes them in pieces of whole anchor groups, cuts a piece into shards, and
builds each shard's transform. The transforms are merged by interleave
refinement: which shard each place of the merged order comes from is refined by
up to five symbols a round, reading the shards' transforms in order, until the
interleave is right for ``LENGTH`` symbols. Suffixes are never sorted across
shards. The round in which neighbours part gives their common prefix; places
never parted share ``LENGTH`` bytes, and such an interval's first occurrence
stays while the others are removed.

An anchor with more than ``MOST_SEGMENTS`` different segments is dealt out
further: its windows are grouped by their own hash, combined inside tasks.

Nulls: a null text is empty; a null id counts as the smallest. Rows that repeat
an id and text are one document and get the same result each; rows that repeat
an id with other texts are ordered by a hash of the text. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.llm.batches import joined, mixed, prefix_sums, range_hash
from canvass.llm.common import stored, text_of

LENGTH, ANCHOR = 100, 32
TILE = 8192  #: windows whose anchors are found together
PLACE_BITS = 14  #: of an anchor's place in its tile, kept below its hash so that the leftmost of equal anchors is the smallest
MOST_SEGMENTS = 20_000
SHARDS = 2
END = 0xFF  #: a byte that UTF-8 never uses
PIECE = 500_000  #: bytes that a merge takes at once, unless one anchor's segments are more
TOGETHER = 2500  #: texts whose segments a task holds at once
STRIDE = 9  #: between the strings by which segments are told to share a window
NEAR = LENGTH - STRIDE + 1


def segments(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, start, number of windows, content hash and the anchor's distance from the start, of each segment of one text.

    The leftmost of equal anchors counts, so no segment holds a window twice.
    """
    windows = len(data) - LENGTH + 1
    if windows < 1:
        return (np.zeros(0, np.int64),) * 5
    sums, span = prefix_sums(data), LENGTH - ANCHOR + 1
    anchors, starts, places = [], [], []
    for low in range(0, windows, TILE):
        at = np.arange(low, min(low + TILE, windows) + span - 1)
        key = range_hash(sums, at, at + ANCHOR) & ~np.uint64((1 << PLACE_BITS) - 1)
        key |= (at - low).astype(np.uint64)
        width = 1
        while 2 * width <= span:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < span:
            key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        anchors.append(key[start] >> np.uint64(PLACE_BITS))
        starts.append(start + low)
        places.append((key[start] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64) + low)
    start = np.concatenate(starts)
    n = np.diff(np.append(start, windows))
    return np.concatenate(anchors).astype(np.int64), start, n, range_hash(sums, start, start + n + LENGTH - 1).view(np.int64), np.concatenate(places) - start


def _texts(batches: Iterator[pa.RecordBatch], column: int = 2, rows: int = 500) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches with the bytes of a text column."""
    for batch in batches:
        for s in range(0, batch.num_rows, rows):
            part = batch.slice(s, rows)
            yield part, [np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) for t in part.column(column).to_pylist()]


def _longs(values) -> pa.Array:
    return pa.array(np.concatenate([np.zeros(0, np.int64), *values]).astype(np.int64, copy=False))


FOUND = "anchor long, content long, id long, tag long, place long"
#: Of a segment's anchor's distance, and of its number of windows, both kept below its start in ``place``.
SMALL_BITS = 7


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All segments of the texts. Of equal ones in some thousand texts only the first goes on to be compared; the others, without anchor, are settled."""
    for batch in (b.slice(at, TOGETHER) for b in batches for at in range(0, b.num_rows, TOGETHER)):
        out = []
        for part, texts in _texts(iter([batch])):
            for i, tag, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts):
                anchor, start, n, content, ahead = segments(text)
                out.append((anchor, content, np.full(len(n), i, np.int64), np.full(len(n), tag, np.int64), (start << SMALL_BITS | ahead) << SMALL_BITS | n))
        if not out:
            continue
        anchor, content, i, tag, place = (np.concatenate(c) for c in zip(*out))
        order = np.lexsort((place, tag, i, content, anchor))
        anchor, content, i, tag, place = (c[order] for c in (anchor, content, i, tag, place))
        again = np.zeros(len(anchor), bool)
        again[1:] = (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1]) & ((i[1:] != i[:-1]) | (tag[1:] != tag[:-1]) | (place[1:] != place[:-1]))
        columns = [pa.array(anchor, mask=again), pa.array(content, mask=again), *(pa.array(c) for c in (i, tag, place))]
        yield pa.RecordBatch.from_arrays(columns, names=["anchor", "content", "id", "tag", "place"])


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of segments sorted by anchor, content, document and place: the repeated ones, without anchor, and the
    first of each content where an anchor has several, which are still to be compared.

    One row is carried from batch to batch, so an anchor of any size streams through.
    """
    names = ["anchor", "id", "tag", "place"]
    last = pending = None  # the last segment seen; the last first of a content, and whether its anchor had one before

    def rows(found: list[tuple[np.ndarray, ...]], mask: np.ndarray) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*found)]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], mask=mask), *map(pa.array, columns[1:])], names=names)

    for batch in batches:
        settled = batch.filter(pc.is_null(batch.column(0)))
        open_ = batch.filter(pc.is_valid(batch.column(0)))
        ready, masks = [], []
        if settled.num_rows:
            ready.append((np.zeros(settled.num_rows, np.int64), *(settled.column(k).to_numpy() for k in (2, 3, 4))))
            masks.append(np.ones(settled.num_rows, bool))
        if open_.num_rows:
            anchor, content, *rest = (c.to_numpy() for c in open_.columns)
            before = (np.concatenate(([last[0] if last else ~anchor[0]], anchor[:-1])), np.concatenate(([last[1] if last else 0], content[:-1])))
            first = (anchor != before[0]) | (content != before[1])
            same = np.zeros(len(anchor), bool)  # one document listed twice repeats nothing
            for k, c in enumerate(rest):
                same |= c != np.concatenate(([last[2 + k] if last else ~c[0]], c[:-1]))
            again = ~first & same
            ready.append(tuple(c[again] for c in (anchor, *rest)))
            masks.append(np.ones(int(again.sum()), bool))
            firsts = [c[first] for c in (anchor, *rest)]
            if pending:
                firsts = [np.concatenate(([v], c)) for v, c in zip(pending[0], firsts)]
            if len(firsts[0]):
                tied = np.concatenate(([pending[1] if pending else False], firsts[0][1:] == firsts[0][:-1]))
                edge = tied[:-1] | tied[1:]
                ready.append(tuple(c[:-1][edge] for c in firsts))
                masks.append(np.zeros(int(edge.sum()), bool))
                pending = (tuple(c[-1] for c in firsts), bool(tied[-1]))
            last = (anchor[-1], content[-1], *(c[-1] for c in rest))
        if ready:
            yield rows(ready, np.concatenate(masks))
    if pending and pending[1]:
        yield rows([tuple(np.array([v], np.int64) for v in pending[0])], np.zeros(1, bool))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of segments (lists of anchor, start, ahead, n) of each text."""
    for part, texts in _texts(batches):
        rows = []
        for i, tag, own, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist(), texts):
            rows += [(s["anchor"], i, tag, s["start"], s["ahead"], text[s["start"] : s["start"] + s["n"] + LENGTH - 1].tobytes()) for s in own]
        columns = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.binary())], names=["anchor", "id", "tag", "start", "ahead", "data"])


#: Symbols that a round of the merge puts in front, the most first; each divides ``LENGTH``.
AT_ONCE = (5, 4, 2)


class Shard:
    """Rotations of some strings, each closed by ``END``, in order by ``LENGTH`` symbols at least, and the symbols before each: the shard's transform."""

    def __init__(self, data: np.ndarray, first: np.ndarray, size: np.ndarray):
        string = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(data)) - first[string]
        start, size_of = first[string], size[string]
        ahead = lambda k: start + (place + k) % size_of
        rank = np.zeros(len(data), np.uint64)
        for k in range(8):
            rank = (rank << np.uint64(8)) | data[ahead(k)]
        width = 8
        while True:
            values, rank = np.unique(rank, return_inverse=True)
            # rotations that agree in more than LENGTH symbols are as good in one order as in another
            if len(values) == len(data) or width >= LENGTH:
                break
            rank = rank.astype(np.uint64) * np.uint64(len(values)) + rank[ahead(width)].astype(np.uint64)
            width *= 2
        self.order = np.argsort(rank, kind="stable")
        before = np.zeros(len(data), np.uint64)
        for k in range(AT_ONCE[0], 0, -1):
            before = (before << np.uint64(8)) | data[ahead(-k)]
        self.before = before[self.order]


def merged(shards: list[Shard]) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of the shards' rotations that is right for ``LENGTH`` symbols, and the number of each place's interval of equal ones.

    A round puts some symbols in front of every rotation: a stable deal by those
    symbols, which every shard hands out in its transform's order, turns an
    interleave right for k symbols into one right for that many more. As many
    go at once as have few enough combinations for a deal by 16 bits.
    """
    of = np.concatenate([np.full(len(s.order), k, np.uint8) for k, s in enumerate(shards)])
    interval = np.zeros(len(of), np.int32)
    whole = np.concatenate([s.before for s in shards])
    for once in AT_ONCE:
        values, symbols = np.unique(whole & np.uint64((1 << 8 * once) - 1), return_inverse=True)
        if len(values) <= 1 << 16:
            break
    symbols = symbols.astype(np.uint16)
    bounds = np.cumsum([0, *(len(s.order) for s in shards)])
    symbol = np.empty(len(of), np.uint16)
    for _ in range(LENGTH // once):
        for k in range(len(shards)):
            symbol[of == k] = symbols[bounds[k] : bounds[k + 1]]
        deal = np.argsort(symbol, kind="stable")
        of, last, drawn = of[deal], interval[deal], symbol[deal]
        parted = (last[1:] != last[:-1]) | (drawn[1:] != drawn[:-1])
        interval = np.concatenate(([0], np.cumsum(parted, dtype=np.int32))).astype(np.int32)
    return of, interval


def repeats(strings: list[bytes], rank: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """For each string the starts of windows that occur before. ``rank`` orders the documents, ``start`` is the string's place in its document.

    No two strings are equal.
    """
    size = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
    first = np.cumsum(size) - size
    data = np.frombuffer(bytes([END]).join([*strings, b""]), np.uint8)
    cuts = np.unique(np.searchsorted(first, np.linspace(0, len(data), SHARDS + 1)[1:-1]))
    bounds = [0, *(int(c) for c in cuts if 0 < c < len(strings)), len(strings)]
    shards, place = [], []
    for a, b in zip(bounds, bounds[1:]):
        low, high = first[a], first[b - 1] + size[b - 1]
        shards.append(Shard(data[low:high], first[a:b] - low, size[a:b]))
        place.append(shards[-1].order + low)
    of, interval = merged(shards)
    where = np.empty(len(data), np.int64)
    for k, p in enumerate(place):
        where[of == k] = p
    string = np.repeat(np.arange(len(strings)), size)[where]
    offset = where - first[string]
    window = offset + LENGTH < size[string]
    interval, string, offset = interval[window], string[window], offset[window]
    when = (rank[string] << 33) + start[string] + offset
    order = np.lexsort((when, interval))
    later = np.zeros(len(order), bool)
    later[order[1:]] = interval[order[1:]] == interval[order[:-1]]
    string, offset = string[later], offset[later]
    order = np.lexsort((offset, string))
    return np.split(offset[order], np.searchsorted(string[order], np.arange(1, len(strings))))


def runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges that windows at these sorted starts cover."""
    cut = np.flatnonzero(np.diff(starts) > LENGTH)
    return starts[np.concatenate(([0], cut + 1))], starts[np.concatenate((cut, [len(starts) - 1]))] + LENGTH


def sharing(anchor: np.ndarray, ahead: np.ndarray, strings: list[bytes]) -> np.ndarray:
    """Which strings may share a window with another one of their anchor; the others certainly do not.

    A common window reaches l bytes to the left of the anchor in both. With g
    the multiple of ``STRIDE`` just below l, the ``NEAR`` bytes from g to the
    left of the anchor lie inside that window, and are equal.
    """
    data, first = joined(strings, b"")
    sums = prefix_sums(data)
    owner, keys = [], []
    for g in range(0, LENGTH - ANCHOR + 1, STRIDE):
        low = first[:-1] + ahead - g
        fits = np.flatnonzero((low >= first[:-1]) & (low + NEAR <= first[1:]))
        owner.append(fits)
        keys.append(mixed(range_hash(sums, low[fits], low[fits] + NEAR) ^ mixed(anchor[fits].view(np.uint64) + np.uint64(g))))
    owner, keys = np.concatenate(owner), np.concatenate(keys)
    order = np.argsort(keys)
    equal = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(strings), bool)
    out[owner[order[1:][equal]]] = True
    out[owner[order[:-1][equal]]] = True
    return out


RANGE = "id long, tag long, a long, b long"


def _merge_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats among segments (anchor, id, tag, start, ahead, data), sorted by anchor, every anchor whole in the partition."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        rows = list({r[1:4]: r for r in rows}.values())  # one document may be listed twice
        near = sharing(*(np.array([r[k] for r in rows], np.int64) for k in (0, 4)), [r[5] for r in rows])
        rows = [r for r, some in zip(rows, near) if some]
        if not rows:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, names=["id", "tag", "a", "b"])
        docs = {d: k for k, d in enumerate(sorted({(r[1], r[2]) for r in rows}))}
        rank = np.array([docs[r[1], r[2]] for r in rows], np.int64)
        out = []
        for r, found in zip(rows, repeats([r[5] for r in rows], rank, np.array([r[3] for r in rows], np.int64))):
            if len(found):
                out += [(r[1], r[2], a + r[3], b + r[3]) for a, b in zip(*(x.tolist() for x in runs(found)))]
        columns = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "tag", "a", "b"])

    rows, size, last = [], 0, None
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if size >= PIECE and r[0] != last:
                yield solve(rows)
                rows, size = [], 0
            rows.append(r)
            size += len(r[5])
            last = r[0]
    if rows:
        yield solve(rows)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of segments (anchor, id, tag, start, ahead, data) with two hashes."""
    for batch in batches:
        out = []
        for _, i, tag, start, _, data in zip(*(c.to_pylist() for c in batch.columns)):
            b = np.frombuffer(data, np.uint8)
            at = np.arange(len(b) - LENGTH + 1)
            one, two = (range_hash(prefix_sums(x), at, at + LENGTH).view(np.int64) for x in (b, b ^ np.uint8(0x55)))
            out.append((one, two, np.full(len(at), i, np.int64), np.full(len(at), tag, np.int64), at + start))
        yield pa.RecordBatch.from_arrays([_longs(c) for c in zip(*out)], names=["one", "two", "id", "tag", "start"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text (third column) without its ranges (fourth)."""
    for part, texts in _texts(batches):
        out = []
        for i, tag, text, ranges in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, part.column(3).to_pylist()):
            keep, at, spans, removed, data = hashlib.sha256(), 0, 0, 0, text.tobytes()
            end = -1
            for r in sorted((r["a"], r["b"]) for r in ranges):
                if r[0] > end:
                    keep.update(data[at : r[0]])
                    spans += 1
                    removed += r[1] - r[0]
                elif r[1] > end:
                    removed += r[1] - end
                end = at = max(end, r[1])
            keep.update(data[at:])
            out.append((i, tag, removed, spans, keep.hexdigest()))
        columns = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())], names=["id", "tag", "n_removed", "n_spans", "sha"])


def _ends(place: str = "place") -> list:
    start = F.shiftright(place, 2 * SMALL_BITS)
    return [start.alias("a"), (start + _small(F.col(place)) + (LENGTH - 1)).alias("b")]


def _small(c: Column) -> Column:
    return c.bitwiseAND(F.lit((1 << SMALL_BITS) - 1))


def removed_ranges(source: DataFrame) -> DataFrame:
    """Byte ranges (id, tag, a, b) to remove, maybe overlapping, of texts (id, tag, text)."""
    found = source.filter(F.octet_length("text") >= LENGTH).mapInArrow(_found, FOUND)
    dealt = found.repartition(F.coalesce("anchor", F.xxhash64("id", "place"))).sortWithinPartitions("anchor", "content", "id", "tag", "place")
    decided = stored(dealt.mapInArrow(_decided, "anchor long, id long, tag long, place long"), "decided")
    whole = decided.filter("anchor is null").select("id", "tag", *_ends())
    edge = decided.filter("anchor is not null")
    contexts = edge.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    start, ahead, n = F.shiftright("place", 2 * SMALL_BITS), _small(F.shiftright("place", SMALL_BITS)), _small(F.col("place"))
    per_doc = edge.groupBy("id", "tag").agg(F.collect_list(F.struct("anchor", start.alias("start"), ahead.alias("ahead"), n.alias("n"))).alias("own"))
    cut = source.join(per_doc, ["id", "tag"]).select("id", "tag", "text", "own").mapInArrow(_cut, "anchor long, id long, tag long, start long, ahead long, data binary")
    cut = stored(cut, "edges")
    crowded = stored(contexts.filter(F.col("n") > MOST_SEGMENTS).select("anchor"), "crowded")
    if crowded.isEmpty():
        return whole.unionAll(cut.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_merge_groups, RANGE))
    usual = cut.join(crowded, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor")
    single = stored(cut.join(crowded, "anchor", "left_semi").mapInArrow(_windows, "one long, two long, id long, tag long, start long"), "windows")
    earliest = single.groupBy("one", "two").agg(F.min(F.struct("id", "tag", "start")).alias("f"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    later = single.join(earliest, ["one", "two"]).filter(F.struct("id", "tag", "start") != F.col("f"))
    return whole.unionAll(usual.mapInArrow(_merge_groups, RANGE)).unionAll(later.select("id", "tag", F.col("start").alias("a"), (F.col("start") + LENGTH).alias("b")))


NO_ID = -(1 << 63)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256."""
    text = text_of(text_col)
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    per_doc = removed_ranges(source).groupBy("id", "tag").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    left = source.join(per_doc, ["id", "tag"]).select("id", "tag", "text", "ranges").mapInArrow(_without, "id long, tag long, n_removed long, n_spans long, sha string")
    left = left.dropDuplicates(["id", "tag"])
    plain = source.select("id", "tag", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    out = plain.join(left, ["id", "tag"], "left")
    return out.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col),
        "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("sha", "whole").alias("kept_sha256"),
    )
