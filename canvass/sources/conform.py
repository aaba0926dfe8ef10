"""Reading raw tables and settling what is missing, what is blank and what is a number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from canvass.functions.numbers import strict_number
from canvass.sources import schema
from canvass.sources.infer import inferred_types, typed
from canvass.sources.records import read_cells

MISSING_TEXT = "NA"


def text_cell(name: str) -> str:
    """The text ``NA`` is missing; an empty cell is a blank answer, not a missing one."""
    return f"case when `{name}` = '{MISSING_TEXT}' then null else coalesce(`{name}`, '') end"


def number_cell(name: str) -> str:
    """A number, missing when the text is none; an undefined number (NaN) counts as missing too."""
    return strict_number(f"`{name}`")


def _name(column: str) -> str:
    return column.replace(".", "_").lower()


def conform(raw: DataFrame, numeric: Sequence[str] = schema.NUMERIC) -> DataFrame:
    """Snake-case names, numbers as double, text under the blank / missing rule.

    Columns that already arrive typed are left as they are.
    """
    out = []
    for f in raw.schema.fields:
        name = _name(f.name)
        cell = f"`{f.name}`"
        if isinstance(f.dataType, T.StringType):
            cell = number_cell(f.name) if name in numeric else text_cell(f.name)
        out.append(f"{cell} as {name}")
    return raw.selectExpr(*out)


def read_survey(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, multi_line: bool = False, infer: bool = False
) -> DataFrame:
    """A survey CSV with a header, every cell read as text, conformed.

    ``columns`` declares the header in file order (dots or underscores), and a
    file whose header differs is an error; without it the header line is looked at. ``multi_line`` allows line breaks
    inside quoted cells, at the price of a pass that counts quotes; a large file is still read by many tasks. ``infer``
    finds logical, whole, real and text columns in the cells by one more pass, instead of the questionnaire's kinds.
    """
    if multi_line:
        cells = read_cells(spark, path, columns)
    else:
        reader = spark.read.options(header=True, quote='"', escape='"', enforceSchema=False)
        if columns is not None:
            reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
        cells = reader.csv(path)
    return typed(cells, inferred_types(cells), [_name(c) for c in cells.columns]) if infer else conform(cells)


def read_region_map(spark: SparkSession, path: str) -> DataFrame:
    """``region_epa, state_abb`` from a quoted CSV, found by the names in its header."""
    cells = spark.read.csv(path, header=True, quote='"', escape='"')
    return conform(cells).select("region_epa", "state_abb")


def read_region_attributes(spark: SparkSession, path: str) -> DataFrame:
    """Region dimension with its geometry as opaque text."""
    return spark.read.schema("name string, geometry_wkt string").parquet(path)
