"""Exact deduplication with an extendible-hash index on shared files.

Texts are equal when identical after every run of ASCII white space became
one space. The index maps the first bits of a text's hash through a directory
to a bucket. A bucket that would hold more than ``capacity`` distinct hashes is
split on the next bit, and the directory doubles when a bucket needs more bits
than it has, however often that takes. Every bucket is a folder of the index,
written by the task that owns its key range. Inside a bucket, texts that share a
hash form a chain: entries are told apart by their bytes, so a collision of
hashes merges nothing.

Rows find their group by looking it up: the directory tells a row's bucket, and
the bucket's entries under the row's hash are followed to the one with its text;
without the index no row finds anything. Texts are compared byte by byte where
entries are made; entries and rows then carry the SHA-256 of the text instead.

A group of copies costs one entry however large it is: copies are merged
inside the tasks that read them before anything is shuffled, and the lookup is
a join whose skewed partitions adaptive execution splits. A directory of up to
``FEW_SLOTS`` slots travels with the tasks, a larger one is a table to join.

Nulls: a null text is empty; a null id is never the smallest one and such a row
is kept only if its whole group has null ids. Rows that repeat an id, or have
none, stay or go together where their texts are equal; each of their other
texts is judged for itself. Very long texts are shuffled once, as they are.
Empty table: empty result. Columns other than id and text, whatever their
names, pass unseen and leave ``keep_first`` as they came.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass.llm.common import literal_longs, stored, text_of, without
from canvass.session import local_table

#: Slots of a directory that travel with the tasks.
FEW_SLOTS = 65_536
SPARE_BITS = 3


def normalised(text: str) -> Column:
    return F.regexp_replace(text_of(text), r"[\x20\x09-\x0D]+", " ")


def _prefix(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def split_buckets(counts: dict[int, int], bits: int, capacity: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Buckets as (prefix, local depth), split until none is overfull, and the prefixes of ``bits`` bits that still are."""
    level, sums = [counts], counts
    for _ in range(bits):
        up: dict[int, int] = {}
        for prefix, n in sums.items():
            up[prefix >> 1] = up.get(prefix >> 1, 0) + n
        level.append(sums := up)
    level.reverse()
    done, overfull, todo = [], [], [(0, 0)]
    while todo:
        prefix, depth = todo.pop()
        if level[depth].get(prefix, 0) <= capacity or depth == bits:
            done.append((prefix, depth))
            if level[depth].get(prefix, 0) > capacity:
                overfull.append(prefix)
        else:
            todo += [(2 * prefix, depth + 1), (2 * prefix + 1, depth + 1)]
    return done, overfull


def directory(hashes: DataFrame, capacity: int) -> tuple[int, list[int]]:
    """Global depth and the bucket number of each slot, for a table of distinct hashes ``h``.

    The driver sees counts by the first bits: some ten for each bucket, which is one folder of the index.
    """
    total = hashes.count()
    bits = max(0, math.ceil(math.log2(max(1, total / capacity)))) + SPARE_BITS
    while True:
        rows = hashes.groupBy(_prefix(F.col("h"), bits).alias("p")).count().collect()
        buckets, overfull = split_buckets({r["p"]: r["count"] for r in rows}, bits, capacity)
        if not overfull or bits >= 64:
            break
        bits += 1
    depth = max(d for _, d in buckets)
    slots = [0] * (1 << depth)
    for number, (prefix, local) in enumerate(sorted(buckets, key=lambda b: b[0] << (64 - b[1]))):
        first = prefix << (depth - local)
        slots[first : first + (1 << (depth - local))] = [number] * (1 << (depth - local))
    return depth, slots


def with_bucket(rows: DataFrame, depth: int, slots: list[int]) -> DataFrame:
    """``rows`` with the bucket that the directory names for their hash ``h``."""
    slot = _prefix(F.col("h"), depth)
    if len(slots) <= FEW_SLOTS:
        return rows.withColumn("bucket", F.get(literal_longs(slots), slot.cast("int")))
    table = local_table(rows.sparkSession, list(enumerate(slots)), "slot bigint, bucket bigint")
    return rows.withColumn("slot", slot).join(table, "slot").drop("slot")


def build_index(texts: DataFrame, depth: int, slots: list[int]) -> DataFrame:
    """Index entries (bucket, h, chain, sha, keep_id, group_size), a folder for each bucket.

    ``texts`` has id, norm and h; grouping by the text itself compares bytes.
    """
    entries = texts.groupBy("h", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    entries = with_bucket(entries.select("h", F.sha2("norm", 256).alias("sha"), "keep_id", "group_size"), depth, slots)
    chain = Window.partitionBy("bucket", "h").orderBy(F.col("keep_id").asc_nulls_last(), "sha")
    owned = entries.repartitionByRange("bucket").withColumn("chain", F.row_number().over(chain))
    return stored(owned, "dedup-index", "bucket")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 65_536, hash_bits: int = 64) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, bucket and chain position.

    ``hash_bits`` below 64 makes hashes collide, for tests of the chains.
    """
    norm = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
    h = F.xxhash64("norm") if hash_bits >= 64 else F.shiftleft(F.shiftrightunsigned(F.xxhash64("norm"), 64 - hash_bits), 64 - hash_bits)
    texts = norm.withColumn("h", h)
    keys = stored(texts.select("id", "h", F.sha2("norm", 256).alias("sha")), "dedup-keys")
    depth, slots = directory(keys.select("h").distinct(), capacity)
    index = build_index(texts, depth, slots)
    return with_bucket(keys, depth, slots).join(index, ["bucket", "h", "sha"]).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "bucket",
        "chain",
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 65_536) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    marks = exact_dedup(docs, id_col, text_col, capacity)
    # an id may stand for several texts, of which only copies go
    gone = marks.filter(~F.col("kept")).select(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha"))
    return without(docs, gone, id=F.col(id_col), sha=F.sha2(normalised(text_col), 256))


ORACLE = r"""
with t as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents
)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = min(doc_id) over w as kept, text_sha256
from t window w as (partition by text_sha256)
"""
