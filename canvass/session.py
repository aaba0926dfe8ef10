"""Session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def local_session(app: str = "canvass", cores: str = "8", **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CANVASS_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        # the survey has more than the default 100 columns: beyond, projections leave whole-stage code generation
        .config("spark.sql.codegen.maxFields", "1000")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``, or the session by ``setCheckpointDir``. Only a local master may
    fall back to the machine's own temporary folder: on a cluster a lost
    executor would take its part of the table with it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_fallback()


@cache
def _local_fallback() -> str:
    return tempfile.mkdtemp(prefix="canvass-")


def local_table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A small constant table with a declared schema.

    Handed over as Arrow it becomes a local relation: its size is known to the
    planner, and no Python worker takes part in reading it.
    """
    schema = T.StructType.fromDDL(columns)
    arrow = {T.StringType: pa.string(), T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.DoubleType: pa.float64()}
    cells = list(zip(*rows)) if rows else [()] * len(schema)
    arrays = [pa.array(c, arrow[type(f.dataType)]) for c, f in zip(cells, schema.fields)]
    return spark.createDataFrame(pa.table(arrays, names=schema.names), schema)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table this library wrote, through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(target, True)


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern and hold a finished table."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return sorted(f.getPath().getParent().toString() for f in found or [])


@contextmanager
def materialized(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """Write ``df`` as parquet in the shared folder for work that reads it many times.

    Unlike a cache it survives lost executors, and unlike ``checkpoint()`` it
    stays columnar, so each reader only loads the columns it needs.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        drop_path(spark, path)
