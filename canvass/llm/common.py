"""Reading tables and cutting lineage in the shared folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.functions.names import unused
from canvass.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """``df`` as a table in the shared folder, with a folder for each value of the columns ``folders``.

    It outlives lost executors, and what is read later is what was written,
    even where a rerun of the plan might deal rows out differently. The folder
    is the checkpoint folder, whose owner clears it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*folders).parquet(path) if folders else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def literal_longs(values: list[int]) -> Column:
    """A constant array; written as text it folds into one literal instead of one expression per element."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, id, bare, text): a long for every document, whatever its id.

    A whole number is its own key. Where ids are of another type, or some are missing, distinct documents are
    numbered instead; rows without id are told apart by ``bare``, the hash of their text, which is NULL for others.
    """
    text = F.col(text_col).cast("string")
    bare = F.when(F.col(id_col).isNull(), F.sha2(F.coalesce(text, F.lit("")), 256))
    source = docs.select(F.col(id_col).alias("id"), bare.alias("bare"), text.alias("text"))
    if isinstance(docs.schema[id_col].dataType, T.IntegralType) and source.filter("id is null").isEmpty():
        return source.select(F.col("id").cast("long").alias("key"), "id", "bare", "text")
    names = stored(source.select("id", "bare").distinct().withColumn("key", F.monotonically_increasing_id()), "names")
    names = names.select("key", F.col("id").alias("n_id"), F.col("bare").alias("n_bare"))
    same = F.col("id").eqNullSafe(F.col("n_id")) & F.col("bare").eqNullSafe(F.col("n_bare"))
    return source.join(names.hint("merge"), same).select("key", "id", "bare", "text")


def without(docs: DataFrame, gone: DataFrame, **columns: Column) -> DataFrame:
    """The rows of ``docs`` whose ``columns`` (by the names that ``gone`` has for them) equal no row of ``gone``, NULLs included.

    Columns for passing use get names that no column of ``docs`` has. A share of all documents may go, so neither
    side is one to broadcast.
    """
    own = {k: unused([*docs.columns, *columns], f"own_{k}") for k in columns}
    theirs = {k: unused([*docs.columns, *own.values()], f"gone_{k}") for k in columns}
    rows = docs.withColumns({own[k]: c for k, c in columns.items()})
    lost = gone.select(*[F.col(k).alias(theirs[k]) for k in columns]).hint("merge")
    same = [F.col(own[k]).eqNullSafe(F.col(theirs[k])) for k in columns]
    return rows.join(lost, reduce(lambda a, b: a & b, same), "left_anti").drop(*own.values())
