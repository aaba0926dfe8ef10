"""CSV records with line breaks inside quoted cells, read by as many tasks as the file has blocks.

Whether a block of a file begins inside a quoted cell follows from the number
of quotes before it, of which only the last bit counts. A first pass adds up
the quotes of each block; a running sum over blocks tells every block how it
begins; the second pass cuts records inside the tasks. What a block leaves
unfinished, and what the next one completes, are pieces, joined at the end:
two a block at most. Quotes must be doubled inside quoted cells and absent from
others, as every CSV writer leaves them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Blocks whose beginnings may be broadcast (some 200 bytes each); beyond, lines are joined and sorted by block.
FEW_BLOCKS = 100_000
_PIECE = "file string, block long, starts boolean, ends boolean, header boolean, record string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    line = F.when(F.endswith("value", F.lit("\r")), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        line.alias("value"), F.monotonically_increasing_id().alias("seq"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records and pieces, from lines in order with ``inside`` telling how their block begins."""
    names = [c.split()[0] for c in _PIECE.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]
    at: tuple | None = None
    held: list[str] = []
    open_, begun, first = False, True, False

    def rest() -> list[tuple]:
        return [(*at, begun, False, first and begun, "\n".join(held))] if held else []

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    for b in batches:
        value, block, inside = b.column(b.schema.get_field_index("value")), b.column(1).to_numpy(), b.column(b.schema.get_field_index("inside")).to_numpy()
        files = pc.dictionary_encode(b.column(0))
        index = files.indices.to_numpy()
        edges = np.flatnonzero((np.diff(block) != 0) | (np.diff(index) != 0)) + 1
        for lo, hi in zip([0, *edges], [*edges, b.num_rows]):
            if lo == hi:
                continue
            here = (files.dictionary[int(index[lo])].as_py(), int(block[lo]))
            if here != at:
                if found := rest():
                    yield batch(found)
                at, held, open_, first = here, [], bool(inside[lo]), int(block[lo]) == 0
                begun = not open_
            part = value.slice(lo, hi - lo)
            odd = pc.count_substring(part, '"').to_numpy(zero_copy_only=False) % 2 == 1
            if not open_ and not odd.any():
                flags = np.zeros(hi - lo, bool)
                flags[0], first = first, False
                yield pa.RecordBatch.from_arrays([pa.array([at[0]] * (hi - lo)), pa.array(block[lo:hi]), *[pa.array(np.ones(hi - lo, bool))] * 2, pa.array(flags), part], names=names)
                continue
            rows = []
            for line, turns in zip(part.to_pylist(), odd):
                if not held:
                    begun = not open_
                open_ ^= bool(turns)
                held.append(line)
                if not open_:
                    rows.append((*at, begun, True, first and begun, "\n".join(held)))
                    first, held = first and not begun, []
            if rows:
                yield batch(rows)
    if found := rest():
        yield batch(found)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, header, record): every record of the files under ``path``; the first one of a file is its header.

    Adding up the quotes of the blocks is a job of its own. Empty lines outside cells are left out.
    """
    lines = _lines(spark, path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    blocks = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = blocks.withColumn("inside", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int"))
    begins = begins.select("file", "block", "inside", ((F.col("inside") + F.col("odd")) % 2 == 1).alias("unfinished"))
    known = begins.limit(FEW_BLOCKS + 1).toArrow()
    if known.num_rows <= FEW_BLOCKS:
        small = spark.createDataFrame(known, begins.schema)
        inside = lines.join(F.broadcast(small), ["file", "block"])
        crossing = any(known.column("unfinished").to_pylist())
    else:
        inside = lines.join(begins.hint("merge"), ["file", "block"])
        inside = inside.repartition("file", "block").sortWithinPartitions("file", "block", "seq")
        crossing = True
    columns = ["file", "block", "value", "inside"]
    whole = inside.select(columns).mapInArrow(_cut, _PIECE).filter("starts and ends")
    if not crossing:
        return whole.filter("record <> ''").select("file", "block", "header", "record")
    around = inside.filter("inside = 1 or unfinished")
    pieces = around.select(columns).mapInArrow(_cut, _PIECE).filter("not (starts and ends)")
    chain = F.sum(F.col("starts").cast("int")).over(Window.partitionBy("file").orderBy("block", "starts"))
    joined = pieces.withColumn("chain", chain).groupBy("file", "chain").agg(
        F.min("block").alias("block"), F.max("header").alias("header"), F.array_sort(F.collect_list(F.struct("block", "starts", "record"))).alias("parts"))
    joined = joined.select("file", "block", "header", F.array_join("parts.record", "\n").alias("record"))
    return whole.select("file", "block", "header", "record").unionByName(joined).filter("record <> ''")


def parsed(found: DataFrame, columns: Sequence[str], record: str = "record", **options: str) -> DataFrame:
    """The records' cells as text under the names of ``columns``; headers are checked and left out."""
    schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(columns))])
    cells = found.select("header", F.from_csv(record, schema.simpleString()[7:-1].replace(":", " "), {"quote": '"', "escape": '"', **options}).alias("c"))
    wrong = F.raise_error(F.concat(F.lit("a file's header differs from the declared columns: "), F.to_json("c"))).cast("boolean")
    same = F.lit(True)
    for k, name in enumerate(columns):
        same = same & (F.col(f"c.c{k}") == name)
    body = F.when(~F.col("header"), True).when(same, False).otherwise(wrong)
    return cells.filter(body).select(*[F.col(f"c.c{k}").alias(name) for k, name in enumerate(columns)])


def read_cells(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """All cells of CSV files with a header as text; ``columns`` declares the header, else the first file's is taken."""
    if columns is None:
        columns = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True).columns
    return parsed(records(spark, path), columns)
