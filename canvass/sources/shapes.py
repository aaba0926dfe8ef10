"""Shapefiles, read by many tasks: geometries as WKT next to their attributes.

A record's place stands in the index file (``.shx``) at eight bytes a record, and the attribute table (``.dbf``) has
rows of one width, so a task reads any run of records without looking at those before. A folder holds any number of
shapefiles with the same attributes; ``write_shapes`` makes such a folder, as many files as its tasks need.

Geometries are points, multipoints, lines and polygons; heights and measures are left aside. A ring that turns
counter-clockwise is a hole of the smallest ring around it, or an outer ring of its own if none is. A record without
geometry has a NULL one, rows marked as deleted are skipped, and blank cells are NULL, as the format cannot tell an
empty text from a missing one. Files are opened through Arrow's file systems, on the driver (headers only) and in tasks.
"""

from __future__ import annotations

import datetime
import json
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

import canvass
from canvass.functions.names import unused

cloudpickle.register_pickle_by_value(canvass)

SPLIT_BYTES = 32 << 20  #: of geometry that a task reads
BLOCK_BYTES = 8 << 20  #: of geometry held at a time, or one longer record
FILE_BYTES = 64 << 20  #: of geometry in a written file
HEAD = 100  #: bytes before the first record
MOST_TEXT, MOST_DIGITS = 254, 18
#: Shape types, less tens for heights and measures.
POINT, LINE, POLYGON, MULTIPOINT = 1, 3, 5, 8


class Field(NamedTuple):
    name: str
    kind: str  #: C, N, F, L or D
    width: int
    decimals: int

    def type(self) -> T.DataType:
        if self.kind in "NF":
            return T.LongType() if self.decimals == 0 and self.width <= MOST_DIGITS and self.kind == "N" else T.DoubleType()
        return {"L": T.BooleanType(), "D": T.DateType()}.get(self.kind, T.StringType())

    def values(self, cells: list[bytes], encoding: str) -> list:
        texts = [c.decode(encoding).rstrip(" \0") for c in cells]
        if self.kind in "NF":
            number = int if isinstance(self.type(), T.LongType) else float
            return [number(t) if t.strip(" *\0") else None for t in texts]
        if self.kind == "L":
            return [True if t in ("T", "t", "Y", "y") else False if t in ("F", "f", "N", "n") else None for t in texts]
        if self.kind == "D":
            return [datetime.date(int(t[:4]), int(t[4:6]), int(t[6:8])) if t.strip("0 ") else None for t in texts]
        return [t or None for t in texts]


class Attributes(NamedTuple):
    rows: int
    first: int  #: where rows begin
    width: int
    fields: tuple[Field, ...]


def located(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def _exists(files: fs.FileSystem, path: str) -> bool:
    return files.get_file_info(path).type == fs.FileType.File


def _content(files: fs.FileSystem, path: str) -> bytes:
    with files.open_input_stream(path) as f:
        return f.read()


def stems(files: fs.FileSystem, path: str) -> list[str]:
    """Shapefiles of a path, less their endings: one file, what a finished ``write_shapes`` lists, or all in a folder."""
    if path.lower().endswith(".shp"):
        return [path[:-4]]
    if _exists(files, f"{path}/_parts"):
        return [f"{path}/{p}" for p in json.loads(_content(files, f"{path}/_parts"))]
    return sorted(i.path[:-4] for i in files.get_file_info(fs.FileSelector(path)) if i.path.endswith(".shx"))


def attributes(files: fs.FileSystem, stem: str) -> Attributes | None:
    if not _exists(files, f"{stem}.dbf"):
        return None
    with files.open_input_file(f"{stem}.dbf") as f:
        rows, first, width = struct.unpack("<4xIHH", f.read(12))
        f.seek(32)
        head = f.read(first - 32)
    fields = []
    for at in range(0, len(head) - 31, 32):
        if head[at] == 0x0D:
            break
        name, kind, size, decimals = struct.unpack("<11sc4xBB", head[at : at + 18])
        fields.append(Field(name.split(b"\0")[0].decode("latin-1").strip(), kind.decode(), size, decimals))
    return Attributes(rows, first, width, tuple(fields))


def _columns(table: Attributes | None, geometry: str) -> list[T.StructField]:
    out: list[T.StructField] = []
    for f in table.fields if table else ():
        out.append(T.StructField(unused([c.name for c in out], f.name), f.type()))
    return [*out, T.StructField(unused([c.name for c in out], geometry), T.StringType())]


# --- geometries ------------------------------------------------------------


def _number(x: float) -> str:
    text = repr(float(x))
    return text[:-2] if text.endswith(".0") else text


def _path(points: np.ndarray) -> str:
    return "(" + ", ".join(f"{_number(x)} {_number(y)}" for x, y in points) + ")"


def turning(ring: np.ndarray) -> float:
    """Twice the area, negative if clockwise."""
    x, y = (ring - ring[0]).T
    return float(np.dot(x[:-1], y[1:]) - np.dot(x[1:], y[:-1]))


def _within(ring: np.ndarray, points: np.ndarray) -> bool:
    """Whether most of the points lie in a ring."""
    (x, y), (x2, y2) = ring[:-1].T, ring[1:].T
    inside = 0
    for px, py in points:
        over = (y > py) != (y2 > py)
        inside += int((px < (x2 - x)[over] * (py - y[over]) / (y2 - y)[over] + x[over]).sum()) % 2
    return 2 * inside > len(points)


def polygons(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Outer rings, each followed by its holes, in the order of the file."""
    area = [turning(r) for r in rings]
    outer = {k: [r] for k, r in enumerate(rings) if area[k] <= 0}
    alone = {}
    for k, ring in enumerate(rings):
        if area[k] > 0:
            around = [j for j in outer if _within(rings[j], ring[:-1])]
            if around:
                outer[min(around, key=lambda j: -area[j])].append(ring)
            else:
                alone[k] = [ring]
    return [own for _, own in sorted({**outer, **alone}.items())]


def wkt(content: bytes) -> str | None:
    """The text form of a record's content; None without geometry."""
    kind = struct.unpack_from("<i", content)[0] % 10
    if kind == 0:
        return None
    if kind == POINT:
        return "POINT " + _path([struct.unpack_from("<2d", content, 4)])
    if kind == MULTIPOINT:
        (n,) = struct.unpack_from("<i", content, 36)
        return "MULTIPOINT (" + ", ".join(_path([p]) for p in np.frombuffer(content, "<f8", 2 * n, 40).reshape(-1, 2)) + ")"
    if kind not in (LINE, POLYGON):
        raise ValueError(f"unknown shape type {kind}")
    parts, n = struct.unpack_from("<2i", content, 36)
    starts = np.frombuffer(content, "<i4", parts, 44)
    paths = np.split(np.frombuffer(content, "<f8", 2 * n, 44 + 4 * parts).reshape(-1, 2), starts[1:])
    if kind == LINE:
        texts, name = [_path(p) for p in paths], "LINESTRING"
    else:
        texts, name = ["(" + ", ".join(map(_path, own)) + ")" for own in polygons(paths)], "POLYGON"
    return f"{name} {texts[0]}" if len(texts) == 1 else f"MULTI{name} ({', '.join(texts)})"


# --- reading ---------------------------------------------------------------


class Run(InputPartition):
    def __init__(self, stem: str, first: int, last: int):
        self.stem, self.first, self.last = stem, first, last


class ShapeReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.names, self.options = schema.names, options
        self.types = [f.dataType for f in schema.fields]

    def partitions(self) -> list[Run]:
        files, path = located(self.options["path"])
        runs, split = [], int(self.options.get("splitbytes", SPLIT_BYTES))
        for stem in stems(files, path):
            shapes, index = files.get_file_info([f"{stem}.shp", f"{stem}.shx"])
            n = (index.size - HEAD) // 8
            own = max(1, -(-n // max(1, -(-shapes.size // split))))
            runs += [Run(stem, at, min(n, at + own)) for at in range(0, n, own)]
        return runs or [Run("", 0, 0)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.last:
            return
        files, _ = located(self.options["path"])
        stem, table = partition.stem, attributes(files, partition.stem)
        if [c.dataType for c in _columns(table, self.names[-1])] != self.types:
            raise ValueError(f"{stem}.dbf has other columns than the first file")
        encoding = self.options.get("encoding")
        if encoding is None:
            encoding = _content(files, f"{stem}.cpg").decode().strip() if _exists(files, f"{stem}.cpg") else "latin-1"
        with files.open_input_file(f"{stem}.shx") as f:
            f.seek(HEAD + 8 * partition.first)
            index = np.frombuffer(f.read(8 * (partition.last - partition.first)), ">i4").reshape(-1, 2).astype(np.int64) * 2
        if table and table.rows < partition.last:
            raise ValueError(f"{stem}: {table.rows} rows of attributes, at least {partition.last} shapes")
        block = np.cumsum(index[:, 1]) // BLOCK_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(index)]
        with files.open_input_file(f"{stem}.shp") as shapes:
            rows = files.open_input_file(f"{stem}.dbf") if table else None
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    yield self._batch(shapes, rows, table, index[a:b], partition.first + a, encoding)
            if rows:
                rows.close()

    def _batch(self, shapes, rows, table, index, first, encoding) -> pa.RecordBatch:
        start, end = index[:, 0].min(), (index[:, 0] + index[:, 1]).max() + 8
        if end - start <= 2 * (index[:, 1].sum() + 8 * len(index)):
            shapes.seek(int(start))
            data = shapes.read(int(end - start))
            contents = [data[o - start + 8 : o - start + 8 + n] for o, n in index]
        else:  # records out of order
            contents = []
            for o, n in index:
                shapes.seek(int(o) + 8)
                contents.append(shapes.read(int(n)))
        columns, kept = [], range(len(index))
        if table:
            rows.seek(table.first + first * table.width)
            data = rows.read(table.width * len(index))
            records = [data[k : k + table.width] for k in range(0, len(data), table.width)]
            kept = [k for k, r in enumerate(records) if r[:1] != b"*"]
            at = 1
            for field in table.fields:
                columns.append(field.values([records[k][at : at + field.width] for k in kept], encoding))
                at += field.width
        columns.append([wkt(contents[k]) for k in kept])
        arrow = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.BooleanType(): pa.bool_(), T.DateType(): pa.date32()}
        return pa.RecordBatch.from_arrays([pa.array(c, arrow.get(t, pa.string())) for c, t in zip(columns, self.types)], names=self.names)


class ShapeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> T.StructType:
        files, path = located(self.options["path"])
        found = stems(files, path)
        if not found:
            raise ValueError(f"no shapefile in {path}")
        return T.StructType(_columns(attributes(files, found[0]), self.options.get("geometry", "geometry_wkt")))

    def reader(self, schema: T.StructType) -> ShapeReader:
        return ShapeReader(schema, dict(self.options))


def read_shapes(spark: SparkSession, path: str, encoding: str | None = None, geometry: str = "geometry_wkt", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The attributes of a shapefile, or of a folder of them, and a column of geometries as WKT.

    ``encoding`` of the texts: that of the ``.cpg`` file, else Latin-1. Whole numbers of up to 18 digits are longs.
    """
    spark.dataSource.register(ShapeSource)
    options = {"geometry": geometry, "splitBytes": str(split_bytes), **({"encoding": encoding} if encoding else {})}
    return spark.read.format("shapefile").options(**options).load(path)


# --- writing ---------------------------------------------------------------


def _polygon(rings: list[list[list[float]]]) -> tuple[bytes, np.ndarray]:
    paths = [np.array(r, "<f8") for r in rings]
    paths = [p if (turning(p) > 0) == bool(k) else p[::-1] for k, p in enumerate(paths)]
    points = np.concatenate(paths)
    starts = np.cumsum([0, *map(len, paths[:-1])])
    box = np.concatenate([points.min(axis=0), points.max(axis=0)])
    return struct.pack("<i4d2i", POLYGON, *box, len(paths), len(points)) + starts.astype("<i4").tobytes() + np.ascontiguousarray(points).tobytes(), box


def _cells(name: str, kind: T.DataType, values: list) -> tuple[Field, list[bytes]]:
    if isinstance(kind, T.BooleanType):
        return Field(name, "L", 1, 0), [b"?" if v is None else b"T" if v else b"F" for v in values]
    if isinstance(kind, T.DateType):
        return Field(name, "D", 8, 0), [b" " * 8 if v is None else v.strftime("%Y%m%d").zfill(8).encode() for v in values]
    if isinstance(kind, T.StringType):
        cells, most, letter, decimals = [(v or "").encode() for v in values], MOST_TEXT, "C", 0
    elif isinstance(kind, T.IntegralType):
        cells, most, letter, decimals = [b"" if v is None else b"%d" % v for v in values], MOST_DIGITS, "N", 0
    else:
        if any(v is not None and not np.isfinite(v) for v in values):
            raise ValueError(f"{name}: the format has no infinite or undefined numbers")
        cells, most, letter, decimals = [b"" if v is None else repr(float(v)).encode() for v in values], 24, "N", 15
    width = max(map(len, cells), default=1) or 1
    if width > most:
        raise ValueError(f"{name}: a cell of {width} bytes, the format allows {most}")
    return Field(name, letter, width, decimals), [c.ljust(width) if letter == "C" else c.rjust(width) for c in cells]


def _write_file(files: fs.FileSystem, stem: str, shapes: list, table: dict[str, list], kinds: dict[str, T.DataType]) -> None:
    records, index, at, boxes = [], [], HEAD // 2, []
    for k, rings in enumerate(shapes, 1):
        content, box = _polygon(rings) if rings else (struct.pack("<i", 0), None)
        boxes += [] if box is None else [box]
        records.append(struct.pack(">2i", k, len(content) // 2) + content)
        index.append(struct.pack(">2i", at, len(content) // 2))
        at += len(records[-1]) // 2
    box = np.concatenate([np.min(boxes, axis=0)[:2], np.max(boxes, axis=0)[2:]]) if boxes else np.zeros(4)
    head = lambda words: struct.pack(">i20xi", 9994, words) + struct.pack("<2i8d", 1000, POLYGON, *box, 0, 0, 0, 0)
    columns = [_cells(c, kinds[c], v) for c, v in table.items()]
    width = 1 + sum(f.width for f, _ in columns)
    dbf = [struct.pack("<4BIHH20x", 3, 95, 7, 26, len(shapes), 33 + 32 * len(columns), width)]
    dbf += [struct.pack("<11sc4xBB14x", f.name.encode(), f.kind.encode(), f.width, f.decimals) for f, _ in columns] + [b"\r"]
    dbf += [b" " + b"".join(row) for row in zip(*(c for _, c in columns))] if columns else [b" "] * len(shapes)
    parts = {"shp": [head(at), *records], "shx": [head(HEAD // 2 + 4 * len(index)), *index], "dbf": [*dbf, b"\x1a"], "cpg": [b"UTF-8"]}
    for ending, data in parts.items():
        with files.open_output_stream(f"{stem}.{ending}") as f:
            f.write(b"".join(data))


def write_shapes(df: DataFrame, path: str, rings: str = "rings", file_bytes: int = FILE_BYTES) -> None:
    """A folder of shapefiles with the polygons of a column of rings (arrays of x, y arrays, the outer one first) and the other columns.

    Tasks write files of their own under new names; the folder's list names those of the tasks that finished, so a task
    that ran twice leaves no row twice. What the format cannot hold is an error: names over ten bytes, texts over
    254 bytes, whole numbers over 18 digits, infinite numbers, further column types. Rings are turned as the format asks.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields if f.name != rings}
    known = (T.StringType, T.IntegralType, T.DoubleType, T.FloatType, T.BooleanType, T.DateType)
    for name, kind in kinds.items():
        if len(name.encode()) > 10 or not name.isascii():
            raise ValueError(f"{name}: names have at most ten ASCII letters")
        if not isinstance(kind, known):
            raise ValueError(f"{name}: no column type for {kind.simpleString()}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = located(path)
        shapes, table, size, made = [], {c: [] for c in kinds}, 0, []

        def flush() -> None:
            nonlocal shapes, table, size
            made.append(f"part-{uuid.uuid4().hex}")
            _write_file(files, f"{folder}/{made[-1]}", shapes, table, kinds)
            shapes, table, size = [], {c: [] for c in kinds}, 0

        for batch in batches:
            for row in batch.to_pylist():
                own = 60 + 16 * sum(map(len, row[rings] or ()))
                if shapes and size + own > file_bytes:
                    flush()
                shapes.append(row[rings])
                for c in kinds:
                    table[c].append(row[c])
                size += own
        if shapes:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["part"])

    files, folder = located(path)
    files.create_dir(folder)
    parts = sorted(r["part"] for r in df.mapInArrow(write, "part string").collect())  # a name a file
    if not parts:
        parts = ["part-none"]
        _write_file(files, f"{folder}/{parts[0]}", [], {c: [] for c in kinds}, kinds)
    with files.open_output_stream(f"{folder}/_parts") as f:
        f.write(json.dumps(parts).encode())
