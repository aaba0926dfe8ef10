"""Writing result tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.operators.probit import ProbitBatch
from canvass.operators.reshape import stack_by_name
from canvass.session import local_table
from canvass.sources.records import parsed, records


MISSING = "NA"
#: Marks a text spelled like a missing cell while a table is read; one more mark is put before texts that begin with it.
_MARK = "\x01"
_LIKE_MISSING = f"^{_MARK}*{MISSING}$"


def _cell(field: T.StructField, quote_all: bool) -> Column:
    """A cell as CSV text. A quoted ``NA`` is a text, a bare one a missing cell, a quoted blank a blank text."""
    c = F.col(f"`{field.name}`")
    text = c.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    if not quote_all:
        needed = (text == "") | text.rlike(f'[",\\n\\r]|^\\s|\\s$|{_LIKE_MISSING}') if isinstance(field.dataType, T.StringType) else F.lit(False)
        quoted = F.when(needed, quoted).otherwise(text)
    return F.coalesce(quoted, F.lit(MISSING))


def _write(df: DataFrame, path: str, quote_all: bool) -> None:
    header = ",".join(f'"{n.replace(chr(34), chr(34) * 2)}"' if quote_all or any(c in n for c in '",\n\r') else n for n in df.columns)
    line = F.concat_ws(",", *[_cell(f, quote_all) for f in df.schema.fields])
    # the first row of a task's partition brings its file's header
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    df.select(F.when(first, F.concat(F.lit(header + "\n"), line)).otherwise(line).alias("value")).write.text(path)
    spark = df.sparkSession
    if spark.read.text(path).isEmpty():
        local_table(spark, [(header,)], "value string").coalesce(1).write.mode("append").text(path)


def write_table(df: DataFrame, path: str) -> None:
    """CSV with a header, missing as ``NA``, quotes only where needed; a text spelled ``NA`` needs them."""
    _write(df, path, False)


def write_quoted_table(df: DataFrame, path: str) -> None:
    """CSV with a header, missing as a bare ``NA``, every other cell quoted; no row names."""
    _write(df, path, True)


def read_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Read back a table written by either CSV sink, under the schema it had.

    Line breaks inside cells are fine, and missing, blank and ``NA`` texts come back as what they were.
    """
    marked = F.regexp_replace("record", f'(^|,)"({_MARK}*{MISSING})"(?=,|$)', f'$1"{_MARK}$2"')
    cells = parsed(records(spark, path).withColumn("record", marked), like.columns, nullValue=MISSING, emptyValue="")
    out = []
    for f in like.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(c.rlike(f"^{_MARK}+{MISSING}$"), F.substring(c, 2, 1 << 30)).otherwise(c)
        out.append(c.cast(f.dataType).alias(f.name))
    return cells.select(*out)


def write_bundle(tables: Mapping[str, DataFrame], path: str) -> None:
    """Several named tables as one dataset: ``path/table=<name>`` each."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/table={name}")


def read_bundle(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/table={name}")


def bundle_manifest(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """``(name, rows, cols)`` of every table in a bundle, counted by Spark."""
    parts = []
    for name in names:
        df = read_bundle(spark, path, name)
        parts.append(df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("name"), "rows", F.lit(len(df.columns)).alias("cols")))
    return stack_by_name(*parts)


def write_models(batch: ProbitBatch, path: str) -> None:
    """Fit summaries and marginal effects, one folder per family in each."""
    for name in ("coefficients", "effects", "fits"):
        getattr(batch, name).write.partitionBy("family").parquet(f"{path}/{name}")


def write_reports(reports: Mapping[str, DataFrame], path: str) -> None:
    """Coefficient reports, one CSV table per family, rows in report order."""
    for family, df in reports.items():
        write_quoted_table(df.orderBy("row_ord").drop("row_ord"), f"{path}/{family}")
