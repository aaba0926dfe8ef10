"""Benchmark decontamination by spaced seeds.

Words are runs of letters and digits, lower-cased. A mask looks at some
positions of a short stretch of words and ignores the others, so a substituted
word at an ignored position does not hide a copy. Hashes of all masked
stretches of the documents are joined with those of the benchmark; a hit fixes
how document and item lie against each other, and the words around it are then
compared one by one. A document is contaminated if some ``WINDOW`` consecutive
words of an item (all of a shorter one) stand in it with at least four fifths
of the words in place.

The two masks miss nothing: whichever 2 of 13 words are substituted, one of
them still fits somewhere between the substitutions (a test tries all pairs).
An item of 5 to 12 words is cut into two parts more than substitutions are
allowed, and its masks look at all but that many parts: some mask sees no
substitution. An item of 1 to 4 words allows none and is sought as it stands.

Benchmark seeds are broadcast up to ``BROADCAST_SEEDS`` rows, whose number is
checked first; beyond, the same join shuffles by seed. Hits are reduced to one
row per document, item and offset inside the reading tasks, so a passage that
a third of all documents share is an ordinary row of each.

Nulls: a null text has no words. Documents without id are judged by their
texts, one row with a null id per contaminated text. An item without id protects
its words like any other and is left out of the list ``items`` only. Rows that
repeat an id count as one document with several texts, and items that repeat
one as items of their own. Of equally good windows the first counts. Very long
texts are judged whole. Empty tables give an empty result. Columns other than id
and text, whatever their names, pass unseen and leave ``keep_clean`` as they came.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.llm.common import stored, text_of, without

#: Positions that a mask looks at.
MASKS = [(0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8)]
WINDOW, FIFTHS = 13, 4
BROADCAST_SEEDS = 500_000


def word_hashes(text: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def allowed(length: int) -> int:
    """Substitutions that a window of so many words may hold."""
    return length - -(-FIFTHS * length // 5)


def masks_for(length: int) -> list[tuple[int, ...]]:
    """Positions of an item of less than ``WINDOW`` words: whatever substitutions are allowed, one mask sees none of them."""
    bad = allowed(length)
    parts = bad + 2 if bad else 1
    bounds = [length * k // parts for k in range(parts + 1)]
    groups = [range(a, b) for a, b in zip(bounds, bounds[1:])]
    return [tuple(i for g in kept for i in g) for kept in combinations(groups, parts - bad)]


def _seeds(words: Column, mask: tuple[int, ...]) -> Column:
    """Hash of the masked words at every position, the mask's shape included."""
    stretch = F.size(words) - max(mask)
    at = lambda i: F.xxhash64(F.lit(str(mask)), *[F.get(words, i + F.lit(k)) for k in mask])
    return F.when(stretch > 0, F.transform(F.sequence(F.lit(0), stretch - 1), at)).otherwise(F.array().cast("array<bigint>"))


def _positions(rows: DataFrame, words: str, masks: list[tuple[int, ...]], *keep: str) -> DataFrame:
    """Columns ``keep``, seed and pos of every masked stretch."""
    by_mask = rows.select(*keep, F.explode(F.array(*[_seeds(F.col(words), m) for m in masks])).alias("s"))
    return by_mask.select(*keep, F.posexplode("s").alias("pos", "seed"))


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (id, item, shift): item word k would stand at document word k + shift. ``docs``: id, words; ``items``: item, words."""
    n = F.size("words")
    lengths = [r["n"] for r in items.filter(n.between(1, WINDOW - 1)).select(n.alias("n")).distinct().collect()]  # 12 values at most
    groups = [(items.filter(n >= WINDOW), m) for m in MASKS] + [(items.filter(n == k), m) for k in sorted(lengths) for m in masks_for(k)]
    parts = [_positions(rows, "words", [mask], "item") for rows, mask in groups]
    seeds = parts[0]
    for p in parts[1:]:
        seeds = seeds.unionAll(p)
    seeds = stored(seeds.select("seed", "item", F.col("pos").alias("item_pos")).distinct(), "seeds")
    side = F.broadcast(seeds) if seeds.count() <= BROADCAST_SEEDS else seeds
    masks = list(dict.fromkeys(m for _, m in groups))
    found = _positions(docs, "words", masks, "id").join(side, "seed")
    return found.select("id", "item", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()


def overlaps(found: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """Verified (id, name, equal, window, start): the best window of each hit that has enough equal words."""
    there = found.join(items.withColumnRenamed("words", "b"), "item").join(docs.withColumnRenamed("words", "d"), "id")
    low = F.greatest(F.lit(0), -F.col("shift"))
    n = F.least(F.size("b"), F.size("d") - F.col("shift")) - low
    laid = there.withColumn("low", low).withColumn("n", n).withColumn("window", F.least(F.size("b"), F.lit(WINDOW))).filter("n >= window")
    same = F.zip_with(F.slice("d", F.col("shift") + F.col("low") + 1, F.col("n")), F.slice("b", F.col("low") + 1, F.col("n")), lambda x, y: (x == y).cast("int"))
    sums = lambda i: F.aggregate(F.slice(F.col("same"), i + 1, F.col("window")), F.lit(0), lambda a, x: a + x)
    best = laid.select("id", "name", "window", "shift", "low", same.alias("same"), "n").withColumn(
        "sums", F.transform(F.sequence(F.lit(0), F.col("n") - F.col("window")), sums)
    )
    scored = best.withColumn("equal", F.array_max("sums")).filter(F.col("equal") * 5 >= F.col("window") * FIFTHS)
    start = F.col("shift") + F.col("low") + F.array_position("sums", F.col("equal")).cast("int") - 1
    return scored.select("id", "name", "equal", "window", start.alias("start"))


def _judged(source: DataFrame, items: DataFrame) -> DataFrame:
    """One row per contaminated id of ``source`` (id, words): id, contaminated, items, overlap, start."""
    found = stored(hits(source, items), "hits")
    sure = overlaps(found, source, items)
    best = F.max(F.struct((F.col("equal") / F.col("window")).alias("overlap"), (-F.col("start")).alias("from")))
    per_doc = sure.groupBy("id").agg(F.sort_array(F.collect_set("name")).alias("items"), best.alias("best"))
    return per_doc.select("id", F.lit(True).alias("contaminated"), "items", F.col("best.overlap").alias("overlap"), (-F.col("best.from")).alias("start"))


def _both(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> tuple[DataFrame, DataFrame | None]:
    """The contaminated documents by id, and those without id by the hash of their text (None if every row has an id)."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    items = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("name"), word_hashes(text_of(item_text)).alias("words"))
    items = stored(items, "items")
    named = _judged(rows.filter("id is not null").select("id", word_hashes(F.col("text")).alias("words")), items)
    bare = rows.filter("id is null")
    if bare.select("id").isEmpty():
        return named, None
    # one row per text, copies merged inside the reading tasks
    texts = bare.groupBy(F.sha2("text", 256).alias("id")).agg(F.first("text").alias("text"))
    return named, stored(_judged(stored(texts.select("id", word_hashes(F.col("text")).alias("words")), "bare"), items), "bare-judged")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per contaminated document: id, contaminated, items (sorted), overlap (share of equal words in the best window), start (its first word)."""
    named, bare = _both(docs, benchmark, id_col, text_col, item_col, item_text)
    if bare is not None:
        named = named.unionAll(bare.withColumn("id", F.lit(None).cast(docs.schema[id_col].dataType)))
    return named.withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    named, bare = _both(docs, benchmark, id_col, text_col, "item_id", "text")
    kept = without(docs, named, id=F.col(id_col))
    if bare is None:
        return kept
    clean = without(docs.filter(F.col(id_col).isNull()), bare, id=F.sha2(text_of(text_col), 256))
    return kept.filter(F.col(id_col).isNotNull()).unionAll(clean)
